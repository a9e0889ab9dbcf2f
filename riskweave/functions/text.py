"""Text expressions: cleaning, words, paragraphs and prompt rendering."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column

# The characters a Unicode-aware whitespace split treats as blank.
BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
BLANK_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NOT_LETTER_OR_BLANK = r"[^a-z\s\x0B\x1C-\x1F\x85\p{Z}]"


def clean_text(c: Column | str) -> Column:
    """Lower-case, then keep only a-z and blanks."""
    return F.regexp_replace(F.lower(as_column(c)), NOT_LETTER_OR_BLANK, "")


def strip(c: Column | str) -> Column:
    """Remove blanks of any kind from both ends; only the ends are looked at."""
    return F.btrim(as_column(c), F.lit(BLANK_CHARS))


def tokenize(c: Column | str) -> Column:
    """Blank-separated words; an empty text has none."""
    return F.filter(F.split(as_column(c), f"{BLANK}+"), lambda w: w != "")


def paragraphs(c: Column | str) -> Column:
    """Parts between empty lines, without the blank ones."""
    return F.filter(F.split(as_column(c), "\n\n"), lambda p: F.length(strip(p)) > 0)


def word_profile(c: Column | str, buckets: int = 16) -> Column:
    """How a text's words spread over ``buckets`` (at most 16) by the first digit of their md5: thousandths, rounded down.
    Whole numbers, so distances between profiles are exact. An empty text has zeros."""
    # A text's digits are one string, bound once: each bucket then only counts characters.
    first = F.array_join(F.transform(tokenize(c), lambda w: F.substring(F.md5(w), 1, 1)), "")

    def shares(digits: Column) -> Column:
        n = F.greatest(F.length(digits), F.lit(1))

        def share(bucket: int) -> Column:
            rest = digits
            for digit in range(bucket, 16, buckets):
                rest = F.replace(rest, F.lit(f"{digit:x}"), F.lit(""))
            return F.floor((F.length(digits) - F.length(rest)).cast("bigint") * 1000 / n).cast("float")

        return F.array(*[share(b) for b in range(buckets)])

    return F.transform(F.array(first), shares)[0]


def count_words(c: Column | str) -> Column:
    return F.size(tokenize(c))


def count_paragraphs(c: Column | str) -> Column:
    return F.size(paragraphs(c))


def pad_truncate(ids: Column | str, length: int) -> Column:
    """The first ``length`` ids, filled with zeros at the end."""
    ids = as_column(ids)
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)


def contains_phrase(c: Column | str, phrase: str) -> Column:
    return F.contains(as_column(c), F.lit(phrase))


def not_blank(c: Column | str) -> Column:
    return F.length(strip(c)) > 0


# Prompt wording is our own; the three strengths go from context-only to unconstrained.
REFUSAL = "Not found in context"
COMPLIANCE_REFUSAL = "Not enough information"

STRICT = (
    "Use the passage and nothing else.\n"
    "Passage:\n{context}\n"
    "Question:\n{question}\n"
    f"If the passage does not hold the answer, reply only: {REFUSAL}."
)
MEDIUM = (
    "Passage:\n{context}\n"
    "Question:\n{question}\n"
    f"Prefer the passage. If it is silent, you may reply: {REFUSAL}."
)
LOOSE = "Background:\n{context}\nQuestion:\n{question}"
COMPLIANCE = (
    "Answer for a compliance officer from this policy text.\n"
    "Policy:\n{context}\n"
    "Question: {question}\n"
    f"When the policy is silent, reply: {COMPLIANCE_REFUSAL}."
)
REWRITE = (
    "You write as a {role}. Give three versions of the text: a simple one, a professional one and "
    "a translation into {language}. Begin their lines with Simple:, Professional: and Translation:.\n"
    "Text: {text}"
)

GROUNDING_TEMPLATES: dict[str, str] = {"Strict RAG": STRICT, "Medium RAG": MEDIUM, "Loose": LOOSE}


def render_prompt(template: str, fields: Mapping[str, Column | str]) -> Column:
    """Fill ``{name}`` slots with columns. Split at plan time, so rows only concatenate."""
    parts: list[Column] = []
    rest = template
    while rest:
        start = rest.find("{")
        if start < 0:
            parts.append(F.lit(rest))
            break
        end = rest.index("}", start)
        if start:
            parts.append(F.lit(rest[:start]))
        name = rest[start + 1:end]
        if name not in fields:
            raise KeyError(f"no column given for slot {name!r}")
        parts.append(F.coalesce(as_column(fields[name]).cast("string"), F.lit("")))
        rest = rest[end + 1:]
    return F.concat(*parts)
