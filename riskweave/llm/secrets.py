"""Secret scans over a trigram inverted index.

Each rule's regex is turned into a Boolean query over the trigrams that every match must hold. An index of a block of
texts lists, for every trigram that some rule asks for, the texts that hold it. Intersecting the postings leaves the
candidates of a rule, and only those meet the regex. A rule without mandatory trigrams scans every text. Blocks are
indexed where their rows are, so nothing is shuffled and memory follows the block.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
EXACT_STRINGS = 64  # larger sets of alternatives are cut into separate conditions
SPAN = "array<struct<kind:string,start:int,end:int>>"

Query = list[set[frozenset[bytes]]]  # all of: any of: all of these trigrams


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` of a match must have; other matches are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.pattern, re.IGNORECASE | re.ASCII if self.any_case else re.ASCII)


# The kinds and their patterns, in the order in which ties are listed.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)


# ---------------------------------------------------------------- regex to trigrams

def trigram_query(pattern: str) -> Query:
    """Conditions on the lower-cased UTF-8 bytes that every match of the pattern meets; none: no trigram is mandatory."""
    conditions: Query = []
    exact = _walk(_parser.parse(pattern), {""}, conditions)
    _flush(exact, conditions)
    return conditions


def _walk(items, exact: set[str], conditions: Query) -> set[str]:
    """Strings that a match up to here may end in, all known from the last cut on."""
    for op, arg in items:
        options = _strings(op, arg)
        if options is None or len(exact) * len(options) > EXACT_STRINGS:
            _flush(exact, conditions)
            exact = {""}
            if options is not None:
                exact = options
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] > 0:
                _flush(_walk(arg[2], {""}, conditions), conditions)
            elif op is K.SUBPATTERN:
                exact = _walk(arg[3], {""}, conditions)
        else:
            exact = {a + b for a, b in product(exact, options)}
    return exact


def _strings(op, arg) -> set[str] | None:
    """Every string that the item can match, if they are few."""
    if op is K.LITERAL:
        return {chr(arg)}
    if op is K.AT or op in (K.ASSERT, K.ASSERT_NOT):
        return {""}
    if op is K.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is K.LITERAL:
                chars.add(chr(value))
            elif kind is K.RANGE and value[1] - value[0] < 4:
                chars |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return chars
    if op is K.SUBPATTERN:
        return _product(arg[3])
    if op is K.BRANCH:
        parts = [_product(branch) for branch in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[1] is not K.MAXREPEAT and arg[1] <= 3:
        one = _product(arg[2])
        if one is not None and len(one) ** arg[1] <= EXACT_STRINGS:
            return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
    return None


def _product(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        options = _strings(op, arg)
        if options is None or len(out) * len(options) > EXACT_STRINGS:
            return None
        out = {a + b for a, b in product(out, options)}
    return out


def _flush(exact: set[str], conditions: Query) -> None:
    """One of the strings must be there. A string too short for a trigram makes the condition void."""
    sets = {frozenset(b[i : i + 3] for i in range(len(b) - 2)) for b in (s.encode().lower() for s in exact)}
    if frozenset() not in sets:
        conditions.append({s for s in sets if not any(o < s for o in sets)})


# ---------------------------------------------------------------- index of a block

def needed(queries: Iterable[Query]) -> list[bytes]:
    return sorted({t for query in queries for condition in query for option in condition for t in option})


class Index:
    """Postings of blocks of texts, for chosen trigrams."""

    def __init__(self, trigrams: list[bytes]):
        self.trigrams = trigrams
        self.number = np.zeros(1 << 24, np.uint16)  # 0: not asked for
        for i, t in enumerate(trigrams, 1):
            self.number[int.from_bytes(t, "big")] = i
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[65:91] += 32

    def postings(self, data: np.ndarray, ends: np.ndarray) -> dict[bytes, np.ndarray]:
        """Ascending text numbers by trigram. ``data``: the texts' bytes one after the other; ``ends``: where each ends."""
        if len(data) < 3:
            return {}
        low = self.lower[data]
        number = self.number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(number)
        text = np.searchsorted(ends, at, "right")
        inside = at + 2 < ends[text]  # not across two texts
        pairs = np.unique(number[at[inside]].astype(np.int64) * len(ends) + text[inside])
        which, text = pairs // len(ends), pairs % len(ends)
        cuts = np.searchsorted(which, np.arange(1, len(self.trigrams) + 2))
        return {t: text[cuts[i] : cuts[i + 1]] for i, t in enumerate(self.trigrams) if cuts[i] < cuts[i + 1]}

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, int, dict[bytes, np.ndarray]]]:
        """First and last row (exclusive) of each block and its postings."""
        if not len(texts):
            return
        wide = pa.types.is_large_string(texts.type)
        _, offsets, values = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
            last = min(last, len(texts))
            yield first, last, self.postings(data[offsets[first] : offsets[last]], offsets[first + 1 : last + 1] - offsets[first])
            first = last


def candidates(query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Text numbers of a block that meet the query."""
    none = np.empty(0, np.int64)
    found = np.arange(n)
    for condition in query:
        options = []
        for trigrams in condition:
            rows = None
            for t in sorted(trigrams, key=lambda t: len(postings.get(t, none))):
                rows = postings.get(t, none) if rows is None else np.intersect1d(rows, postings.get(t, none), True)
            options.append(rows)
        found = np.intersect1d(found, np.unique(np.concatenate(options)), True)
    return found


def _scanner(rule: Rule) -> re.Pattern[str]:
    """A run of one character class is matched whole or not at all, so its least length may enter the regex;
    the matches stay the same and short runs cost no call."""
    parsed = _parser.parse(rule.pattern)
    if rule.group == 0 and not rule.any_case and len(parsed) == 1 and parsed[0][0] is K.MAX_REPEAT and rule.pattern.endswith("]+"):
        return re.compile(rule.pattern[:-1] + f"{{{max(1, rule.least)},}}", re.ASCII)
    return rule.compiled()


# ---------------------------------------------------------------- operators

def scan(text: str | Column, rules: Iterable[Rule] = RULES) -> Column:
    """Spans of secrets: an array of (kind, start, end) in code points, end exclusive, by start and then in the rules'
    order. Matches are leftmost and do not overlap within a kind.

    Null and empty texts have no spans; texts of any length are read whole; equal texts have equal spans.
    """
    rules = tuple(rules)
    queries = [trigram_query(rule.pattern) for rule in rules]
    state = {}

    @F.arrow_udf(SPAN)
    def spans(texts: pa.Array) -> pa.Array:
        if not state:
            state["index"], state["scanners"] = Index(needed(queries)), [_scanner(rule) for rule in rules]
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        texts = texts.fill_null("")
        for first, last, postings in state["index"].blocks(texts):
            for order, (rule, query, scanner) in enumerate(zip(rules, queries, state["scanners"])):
                for row in first + candidates(query, postings, last - first):
                    for match in scanner.finditer(texts[int(row)].as_py()):
                        if match.end(rule.group) - match.start(rule.group) >= rule.least:
                            found[row].append((match.start(), order, match.end()))
        rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(row)] for row in found]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return spans(text)


def trigram_index(df: DataFrame, key: str, text: str, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The index itself: (trigram, keys) with one row per trigram and block of texts; null texts hold none."""
    trigrams = needed(trigram_query(rule.pattern) for rule in rules)
    kind = df.schema[key].dataType.simpleString()

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(trigrams)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).fill_null("")
            for first, _, postings in index.blocks(texts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t.decode("utf-8", "replace") for t in postings], pa.string()),
                     pa.array([keys.take(pa.array(rows + first)).to_pylist() for rows in postings.values()], pa.list_(keys.type))],
                    ["trigram", "keys"])

    return df.select(key, text).mapInArrow(build, f"trigram string, keys array<{kind}>")


def spans_text(spans: str | Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
