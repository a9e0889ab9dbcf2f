"""Text preparation over whole texts."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import words
from .registry import query

B = r"\s\x0B\x1C-\x1F\x85\pZ"
CLEAN = f"regexp_replace(lower(text), '[^a-z{B}]', '', 'g')"
WORDS = f"list_filter(regexp_split_to_array({{x}}, '[{B}]+'), lambda w: w <> '')"
STRIP = f"regexp_replace(regexp_replace({{x}}, '^[{B}]+', ''), '[{B}]+$', '')"
# Turns of a conversation as the pages of one document, an empty line between them.
CORPUS = f"(SELECT conv_id, {STRIP.format(x='string_agg(text, chr(10) || chr(10) ORDER BY turn, text)')} AS text FROM conversations GROUP BY conv_id)"


@query("clean_text", f"SELECT doc_id, {CLEAN} AS text FROM documents")
def clean_text(t):
    return t.documents.select("doc_id", X.clean_text("text").alias("text"))


@query("tokenize", f"""
WITH w AS (SELECT doc_id, {WORDS.format(x='text')} AS w FROM documents)
SELECT doc_id, len(w)::INT AS n_words, md5(array_to_string(w, ' ')) AS digest FROM w
""")
def tokenize(t):
    return t.documents.select("doc_id", X.tokenize("text").alias("w")).select(
        "doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))


VOCAB_SQL = f"""
WITH t AS (SELECT unnest({WORDS.format(x=CLEAN)}) AS word FROM documents),
v AS (SELECT word, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, word) + 1)::INT AS word_id FROM t GROUP BY word),
vocab AS (SELECT * FROM v WHERE word_id < 5000)
"""


@query("vocabulary", VOCAB_SQL + "SELECT word, n, word_id FROM vocab")
def vocabulary(t):
    return words.fit_vocabulary(t.documents, "text")


@query("encode_tokens", VOCAB_SQL + f""",
c AS (SELECT conv_id, turn, {WORDS.format(x=CLEAN)} AS w FROM conversations),
e AS (SELECT conv_id, turn, unnest(w) AS word, unnest(range(len(w))) AS pos FROM c)
SELECT conv_id, turn, string_agg(COALESCE(word_id, 1)::VARCHAR, ' ' ORDER BY pos) AS ids
FROM e LEFT JOIN vocab ON e.word = vocab.word GROUP BY conv_id, turn
UNION ALL SELECT conv_id, turn, '' FROM c WHERE coalesce(len(w), 0) = 0
""")
def encode_tokens(t):
    """Vocabulary from the documents, applied to every word of every message; messages without words stay."""
    turns = t.conversations.withColumn("key", F.struct("conv_id", "turn"))
    ids = words.encode_tokens(turns, "key", "text", words.fit_vocabulary(t.documents, "text"))
    return ids.select(
        "key.conv_id", "key.turn", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("encode_pad", VOCAB_SQL + f""",
c AS (SELECT conv_id, turn, list_slice({WORDS.format(x=CLEAN)}, 1, 10) AS w FROM conversations),
e AS (SELECT conv_id, turn, unnest(w) AS word, unnest(range(len(w))) AS pos FROM c),
i AS (SELECT conv_id, turn, list(COALESCE(word_id, 1) ORDER BY pos) AS ids FROM e LEFT JOIN vocab ON e.word = vocab.word GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, array_to_string(list_slice(COALESCE(ids, []) || [0, 0, 0, 0, 0, 0, 0, 0, 0, 0], 1, 10), ' ') AS ids
FROM c LEFT JOIN i ON c.conv_id = i.conv_id AND c.turn = i.turn
""")
def encode_pad(t):
    turns = t.conversations.withColumn("key", F.struct("conv_id", "turn"))
    ids = words.encode_tokens(turns, "key", "text", words.fit_vocabulary(t.documents, "text"), length=10)
    return ids.select("key.conv_id", "key.turn", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("corpus", f"SELECT conv_id, text FROM {CORPUS}")
def corpus(t):
    return words.load_corpus(t.conversations, "conv_id", "turn", "text", sep="\n\n")


@query("count_profile", f"""
SELECT conv_id, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '[^{B}]')))::INT AS n_paragraphs,
       len({WORDS.format(x='text')})::INT AS n_words FROM {CORPUS}
""")
def count_profile(t):
    return words.count_profile(corpus(t), "conv_id", "text")


@query("split_paragraphs", f"""
WITH p AS (SELECT conv_id, list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '[^{B}]')) AS p FROM {CORPUS})
SELECT conv_id, unnest(range(len(p)))::INT AS paragraph_no, unnest(p) AS paragraph FROM p
""")
def split_paragraphs(t):
    return words.split_paragraphs(corpus(t), "conv_id", "text")


@query("contains_phrase", "SELECT doc_id, contains(text, 'the and') AS has_phrase FROM documents")
def contains_phrase(t):
    return t.documents.select("doc_id", X.contains_phrase("text", "the and").alias("has_phrase"))


@query("strip_text", f"SELECT conv_id, turn, {STRIP.format(x="' ' || text || chr(10)")} AS text FROM conversations")
def strip_text(t):
    return t.conversations.select("conv_id", "turn", X.strip(F.concat(F.lit(" "), "text", F.lit("\n"))).alias("text"))


@query("rewrite_prompt", """
SELECT conv_id, turn, 'You write as a ' || role || '. Give three versions of the text: a simple one, a professional one and '
  || 'a translation into French. Begin their lines with Simple:, Professional: and Translation:.' || chr(10) || 'Text: ' || text AS prompt
FROM conversations
""")
def rewrite_prompt(t):
    prompt = X.render_prompt(X.REWRITE, {"role": "role", "language": F.lit("French"), "text": "text"})
    return t.conversations.where(X.not_blank("text")).select("conv_id", "turn", prompt.alias("prompt"))


# ---------------------------------------------------------------- quarantine

@query("quarantine", """
SELECT regexp_extract(url, '^https?://(?:[^/]+\\.)?(example\\.[a-z]+)/', 1) AS folder,
       count(*) FILTER (ends_with(rtrim(html), '</html>')) AS n_good,
       count(*) FILTER (NOT ends_with(rtrim(html), '</html>')) AS n_bad FROM pages GROUP BY 1
""")
def quarantine(t):
    from ..sources.files import quarantine_counts

    folder = F.regexp_extract("url", r"^https?://(?:[^/]+\.)?(example\.[a-z]+)/", 1)
    return quarantine_counts(t.pages, folder, F.endswith(F.rtrim("html"), F.lit("</html>")))


@query("render_json", """
SELECT doc_id, '{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}' AS record FROM labels
""")
def render_json(t):
    from ..sources.files import as_json

    labels = t.labels
    return as_json(labels).select(F.get_json_object("record", "$.doc_id").cast("bigint").alias("doc_id"), "record")
