"""The queries of the numbered operators, each with production parameters over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import bpe, exact, lexical, lines, mixing, negatives, neighbours, quality, secrets, simhash, tokens, toxicity, warc
from .common import bounded_batches, text_of
from .training import labelled_rows, labelled_sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def sha256(column) -> F.Column:
    return F.sha2(column, 256)


BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        "doc_id", bpe.encode_and_decode(text_of("text"), BPE, public_tokenizers.PATTERN).alias("t"))
    return rows.select("doc_id", F.size("t.ids").cast("long").alias("n_tokens"), F.col("t.digest").alias("ids_sha256"),
                       sha256("t.decoded").alias("decoded_sha256"))


@query("op3_secrets")
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", secrets.scan(text_of("text")).alias("found"))
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = secrets.spans_text("found")
    return rows.select("doc_id", *[number(rule.kind) for rule in secrets.RULES], sha256(spans).alias("base_sha256"), spans.alias("spans"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    pieces = tokens.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rows = table(spark, folder, "documents").select("doc_id", tokens.token_counts(text_of("text"), pieces).alias("n"))
    return rows.select("doc_id", "n.n_pretokens", "n.n_tokens")


@query("op4_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
""")
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    place = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_monolithic(table(spark, folder, "pages"), "page_id", "url", "html", f"{place}/whole")
    warc.normalise(spark, f"{place}/whole", f"{place}/members")
    found = warc.read_records(warc.read_index(spark, f"{place}/members"))
    return found.select(warc.key_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        warc.key_of("refers_to").alias("refers_to"))


@query("op5_exact_dedup", r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
""")
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.copies(table(spark, folder, "documents"), "doc_id", "text")


@query("op9_simhash")
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(table(spark, folder, "documents"), "doc_id", "text")


@query("op2_quality")
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    known = labelled_rows(docs, table(spark, folder, "labels"), "doc_id", "text", "quality", where=~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), quality.fit(known).score(text_of("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    chain = toxicity.fit(labelled_sample(docs, table(spark, folder, "labels"), "doc_id", "text", "toxic"))
    rows = docs.select("doc_id", chain.probabilities(text_of("text")).alias("p"))
    return rows.select("doc_id", *[F.col(f"p.{n}").alias(f"p_{n}") for n in chain.names[:-1]], F.col("p.toxic").alias("score"),
                       (F.col("p.toxic") >= chain.threshold).cast("int").alias("toxic"))


@query("op10_mixing", r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, coalesce(source, chr(0)) AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
           ('0x' || substr(md5('mix:block:' || doc_id), 1, 8))::BIGINT AS drawn, md5('mix:0:' || doc_id) AS doc_key FROM documents),
s AS MATERIALIZED (SELECT s, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY s),
t AS MATERIALIZED (SELECT sum(tokens)::DOUBLE AS total, count(*) AS kinds FROM s WHERE tokens > 0),
b AS (
    SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 1.0::DOUBLE AS tried
    UNION ALL
    SELECT step + 1, CASE WHEN large OR step = 0 AND tried = 1 AND NOT large THEN low ELSE tried END,
           CASE WHEN large THEN tried ELSE high END,
           CASE WHEN step = 0 AND NOT large THEN 2.0
                WHEN large THEN (low + tried) / 2 ELSE (tried + high) / 2 END
    FROM (SELECT b.*, (SELECT ln(sum(p)) - sum(p * ln(p)) / sum(p) < 0.95 * ln(any_value(kinds)) AND max(p / tokens) / sum(p) * any_value(total) < 4
                       FROM (SELECT tokens, kinds, total, pow(tokens / total, b.tried) AS p FROM s, t WHERE tokens > 0)) AS large FROM b)
    WHERE step < 41 AND tried <= 1),
a AS MATERIALIZED (SELECT CASE WHEN max(tried) > 1 THEN 1.0 ELSE max(low) END AS alpha FROM b),
w AS MATERIALIZED (SELECT s.*, pow(tokens / total, alpha) / sum(pow(tokens / total, alpha)) OVER () AS weight, total FROM s, t, a WHERE tokens > 0),
g AS MATERIALIZED (SELECT *, least(floor(weight * total + 0.5), tokens * 4)::BIGINT AS budget FROM w),
p AS MATERIALIZED (SELECT *, budget // tokens AS passes, budget % tokens AS rest FROM g),
x AS MATERIALIZED (SELECT d.*, p.passes, p.rest, d.drawn % ceil(p.docs / 1000.0)::BIGINT AS block,
           md5('mix:0:' || d.s || ':' || (d.drawn % ceil(p.docs / 1000.0)::BIGINT)) AS block_key FROM d JOIN p USING (s)),
k AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY block_key) AS upto
      FROM (SELECT s, block_key, sum(n_tokens) AS n, any_value(rest) AS rest FROM x GROUP BY s, block_key)),
y AS (SELECT x.*, k.upto AS block_upto, k.n AS block_n, sum(x.n_tokens) OVER (PARTITION BY x.s, x.block_key ORDER BY x.doc_key) AS doc_upto
      FROM x JOIN k USING (s, block_key)),
z AS (SELECT *, rest > 0 AND block_upto - block_n + doc_upto <= rest AS part FROM y),
r AS (SELECT *, unnest(range(CASE WHEN part THEN 0 ELSE 1 END, passes + 1)) AS pass FROM z)
SELECT doc_id, source, n_tokens, pass::INTEGER AS pass,
       substr(md5('mix:' || pass || ':' || s || ':' || block), 1, 12) || substr(md5('mix:' || pass || ':' || doc_id), 1, 12) AS place
FROM r
""")
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.token_count("text").alias("n_tokens"))
    plans = mixing.plan(docs, "doc_id", "source", "n_tokens")
    return mixing.realise(docs, "doc_id", "source", plans)


@query("op7_nearest")
def op7_nearest(spark: SparkSession, folder: str) -> DataFrame:
    found = neighbours.nearest_neighbours(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op11_lexical", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
c AS MATERIALIZED (SELECT doc_id, len(terms)::BIGINT AS n, terms FROM d WHERE len(terms) > 0),
s AS MATERIALIZED (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM c),
q AS MATERIALIZED (SELECT item_id, term, count(*)::BIGINT AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
p AS MATERIALIZED (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM c)
                   WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
r AS (SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))))::BIGINT AS score
      FROM p JOIN w USING (term) JOIN q USING (term), s GROUP BY item_id, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
""")
def op11_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text", k=20)


@query("op12_negatives", """
WITH r AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
           list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)])::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> anchor_label AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""")
def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), "vec_id", "embedding", label, F.col("id") % 100 == 0)


@query("op13_line_dedup", r"""
WITH d AS MATERIALIZED (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS MATERIALIZED (
    SELECT doc_id, line, place, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d)),
f AS (SELECT key, max(doc_id) AS largest FROM (SELECT DISTINCT doc_id, key FROM l WHERE length(key) >= 20)
      GROUP BY key HAVING count(*) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (largest <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (largest IS NULL OR largest = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN f USING (key) GROUP BY doc_id
""")
def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.drop_repeated_lines(table(spark, folder, "documents"), "doc_id", "text")
    return found.select("doc_id", "n_lines", "n_dropped", sha256("kept").alias("kept_sha256"))
