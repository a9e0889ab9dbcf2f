"""Toxicity by a chain of linear classifiers.

The chain predicts one category after the other and the overall verdict last. Each link is a logistic regression
on the words of a text and their beginnings, and on the probabilities of the links before it. While fitting, those probabilities come from
models that have not seen the row (out of fold), as they will when texts are scored.

Labels tell only whether a text is toxic. Categories are labelled weakly: a toxic text that holds a word of the
category's list belongs to it. The lists only make labels for fitting; what a link looks at is learnt. Toxic texts without
a listed word, among them all in languages that the lists do not cover, say nothing about categories: their links leave
them out of fitting, while the verdict is fitted on all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import exp, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import materialize

# Words that mark a category of toxic texts.
CATEGORIES = {
    "insult": ("idiot", "moron", "stupid", "fool", "loser", "clown", "jerk", "dumb"),
    "contempt": ("pathetic", "worthless", "disgusting", "scum", "trash", "filth", "vermin", "garbage"),
}
FOLDS = 3
WORDS = 4096  # words that a link can look at, the most telling ones
ERROR = 0.01  # chance that any of them is there by accident
PENALTY = 1e-3
SAME = 0.8  # similarity of words from which training rows count as one
STEMS = range(3, 7)  # letters of a beginning
MARKS_HELD = 200_000  # marks counted by a task before it sends on their sums
WORD = re.compile(r"[^\W\d_]+")


def marks(text: str) -> list[str]:
    """What the distinct lower-case words (runs of letters) of a text offer to look at: the words, each with a full stop
    behind it, and their beginnings, by which compounds and inflected forms resemble each other."""
    found = set(WORD.findall(text.lower()))
    return sorted({w + "." for w in found} | {w[:k] for w in found for k in STEMS if len(w) >= k})


def strength(text: str, known: Container[str], heads: Container[str]) -> dict[str, float]:
    """The known marks that a text holds, with log2(1 + occurrences). ``heads``: how the known marks begin."""
    counts: dict[str, int] = {}
    for word in WORD.findall(text.lower()):
        whole = word + "."
        if whole[: STEMS[0]] in heads:
            for mark in (whole, *[word[:k] for k in STEMS if len(word) >= k]):
                if mark in known:
                    counts[mark] = counts.get(mark, 0) + 1
    return {m: log2(1 + counts[m]) for m in sorted(counts)}


Split = Callable[[str], list[str]]


def numbers_of(text: str, split: Split) -> np.ndarray:
    """Hashes of a text's marks, sorted."""
    return np.sort(np.array([xxh64_intdigest(m.encode("utf-8"), 42) for m in split(text)], np.uint64).view(np.int64))


def outline(text: str | Column, split: Split) -> Column:
    """Of a text's marks the digest and the three smallest hashes."""

    @F.arrow_udf("struct<digest:bigint,mark:array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        found = [numbers_of(t.as_py() or "", split) for t in texts]
        return pa.StructArray.from_arrays([pa.array([xxh64_intdigest(f.tobytes()) >> 1 for f in found], pa.int64()),
                                           pa.array([f[:3] for f in found], pa.list_(pa.int64()))], ["digest", "mark"])

    return sketch(text)


def numbers(text: str | Column, split: Split) -> Column:
    @F.arrow_udf("array<bigint>")
    def hashes(texts: pa.Array) -> pa.Array:
        return pa.array([numbers_of(t.as_py() or "", split) for t in texts], pa.list_(pa.int64()))

    return hashes(text)


@dataclass(frozen=True)
class Chain:
    """``weights``: for every mark its weight in each link; ``before``: for every link the weights of the earlier ones."""

    names: tuple[str, ...]
    weights: Mapping[str, tuple[float, ...]]
    before: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]
    threshold: float

    def probabilities(self, text: str | Column) -> Column:
        """Struct of one probability per link, the verdict's last; null and empty texts are scored as texts without words."""
        weights, before, intercepts, names = dict(self.weights), self.before, self.intercepts, self.names
        heads = {m[: STEMS[0]] for m in weights}

        @F.arrow_udf("struct<" + ",".join(f"{n}:double" for n in names) + ">")
        def score(texts: pa.Array) -> pa.Array:
            columns = [[] for _ in names]
            for t in texts:
                raw = list(intercepts)
                for mark, much in strength(t.as_py() or "", weights, heads).items():
                    for c, w in enumerate(weights[mark]):
                        raw[c] += much * w
                p = []
                for c, column in enumerate(columns):
                    s = raw[c] + sum(w * q for w, q in zip(before[c], p))
                    p.append(1 / (1 + exp(-min(30.0, max(-30.0, s)))))
                    column.append(p[-1])
            return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], names)

        return score(text)


def held_marks(text: str | Column, vocabulary: Sequence[str]) -> Column:
    """Numbers and strengths of the vocabulary's marks in whole texts."""
    number = {m: i for i, m in enumerate(vocabulary)}
    heads = {m[: STEMS[0]] for m in vocabulary}

    @F.arrow_udf("array<struct<i:int,much:double>>")
    def held(texts: pa.Array) -> pa.Array:
        rows = [[{"i": number[m], "much": x} for m, x in strength(t.as_py() or "", number, heads).items()] for t in texts]
        return pa.array(rows, pa.list_(pa.struct([("i", pa.int32()), ("much", pa.float64())])))

    return held(text)


def listed(text: str | Column, categories: Mapping[str, Sequence[str]]) -> Column:
    """For each category 1 if the text holds a word of its list, else 0."""
    lists = [frozenset(seeds) for seeds in categories.values()]

    @F.arrow_udf("array<int>")
    def look(texts: pa.Array) -> pa.Array:
        held = [frozenset(WORD.findall((t.as_py() or "").lower())) for t in texts]
        return pa.array([[int(not seeds.isdisjoint(h)) for seeds in lists] for h in held], pa.list_(pa.int32()))

    return look(text)


def without_copies(rows: DataFrame, split: Split = marks) -> DataFrame:
    """Near copies count once: of rows whose three smallest word hashes and labels agree the first stays, and so do those
    whose words have a Jaccard similarity below SAME with it. Agreeing hashes alone say little about unlike texts.

    ``rows`` are a bounded sample with the columns row (unique), key, label and text. Only hashes are grouped; the words,
    as numbers, are looked at again for the first row of a group and the rows that differ from it.
    """
    short = rows.select("row", "key", "label", outline("text", split).alias("o"))
    short = materialize(short.select(F.struct("key", "o.digest", "row").alias("me"), "label", "o.mark"))
    firsts = short.groupBy("mark", "label").agg(F.min("me").alias("first"), F.count("*").alias("n")).where("n > 1")
    others = short.join(F.broadcast(firsts), ["mark", "label"]).where("me <> first")  # at most as many groups as sampled rows
    same = others.where("me.digest = first.digest").select(F.col("me.row").alias("row"))
    unlike = others.where("me.digest <> first.digest").select(F.col("me.row").alias("row"), F.col("first.row").alias("led_by"))
    wanted = unlike.select("row", "led_by").union(unlike.select("led_by", F.lit(None).cast("long")).distinct())
    held = rows.select("row", "text").join(F.broadcast(wanted), "row").select("row", "led_by", numbers("text", split).alias("words"))
    led = held.where("led_by IS NOT NULL").join(held.where("led_by IS NULL").select(F.col("row").alias("led_by"), F.col("words").alias("led")), "led_by")
    common = F.size(F.array_intersect("words", "led"))
    gone = same.union(led.where(common >= SAME * (F.size("words") + F.size("led") - common)).select("row"))
    return rows.join(F.broadcast(materialize(gone)), "row", "left_anti")


def mark_counts(rows: DataFrame) -> DataFrame:
    """(word, k, t): how many rows (label, text) hold a mark, and how many of them are toxic. A task sends on its sums."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, toxic = Counter(), Counter()

        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64()),
                                               pa.array([toxic[w] for w in held], pa.int64())], ["word", "k", "t"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = marks(text.as_py() or "")
                held.update(found)
                if label:
                    toxic.update(found)
                if len(held) > MARKS_HELD:
                    yield sums()
                    held.clear()
                    toxic.clear()
        yield sums()

    parts = rows.select("label", "text").mapInArrow(count, "word string, k bigint, t bigint")
    return parts.groupBy("word").agg(F.sum("k").alias("k"), F.sum("t").alias("t"))


def telling_words(rows: DataFrame, limit: int = WORDS) -> list[str]:
    """Words that toxic rows hold more often or less often than chance explains.

    If a word had nothing to do with the label, the toxic share t / k of its k rows would differ from the overall share
    as much as it does with a chance of at most exp(-k KL). Words are kept if that chance, times the number of words
    looked at, is below ERROR.
    """
    n, toxic = rows.agg(F.count("*"), F.sum("label")).first()
    if not toxic or toxic == n:
        return []
    held = materialize(mark_counts(rows))
    share = F.col("t") / F.col("k")
    term = lambda x, p: F.when(x > 0, x * F.log(x / F.lit(p))).otherwise(0.0)
    held = held.withColumn("bits", F.col("k") * (term(share, toxic / n) + term(1 - share, 1 - toxic / n)))
    tried = held.agg(F.count("*")).first()[0]
    held = held.where(F.col("bits") >= log(max(1, tried) / ERROR)).orderBy(F.desc("bits"), "word").limit(limit)
    return sorted(r["word"] for r in held.collect())


def fit(sample: DataFrame, categories: Mapping[str, Sequence[str]] = CATEGORIES, folds: int = FOLDS, penalty: float = PENALTY) -> Chain:
    """A chain from rows (key, text, label) as ``training.labelled_sample`` draws them.

    The words are counted and chosen by Spark. What the links are fitted on is bounded by the sample: per row the few
    telling words that it holds, rows of equal content counted together. Toxic rows without a word of any category take part
    in fitting the verdict only. A category without rows of both kinds, and a
    verdict without labels of both kinds, always gets the probability 0 or 1 that its rows say (0 without rows), and
    nothing depends on it.
    """
    names = (*categories, "toxic")
    rows = materialize(sample.select(F.monotonically_increasing_id().alias("row"), "key", "label", "text",
                                     F.pmod(F.xxhash64("key"), F.lit(folds)).cast("int").alias("fold")))
    rows = without_copies(rows)
    vocabulary = telling_words(rows)
    marked = rows.select(held_marks("text", vocabulary).alias("held"), listed("text", categories).alias("listed"), "fold", "label")
    belongs = [(F.col("label") * F.col("listed")[c]).alias(f"y{c}") for c in range(len(categories))]
    counted = marked.select("held", "fold", *belongs, F.col("label").alias(f"y{len(belongs)}"))
    found = sorted(counted.groupBy(*counted.columns).agg(F.count("*").alias("n")).collect())
    data = Sample(found, len(vocabulary), len(names))
    weights, before, intercepts = np.zeros((len(vocabulary), len(names))), [], []
    chained, out_of_fold = [], np.zeros((len(data.n), 0))
    for c in range(len(names)):
        before.append([0.0] * c)
        y = data.y[:, c]
        told = data.n if c == len(names) - 1 else data.n * (data.y[:, :-1].any(axis=1) | (data.y[:, -1] == 0))
        if not vocabulary or len(set(y[told > 0].tolist())) < 2:
            intercepts.append(30.0 if y[told > 0].any() else -30.0)
            continue
        w, v, b = data.logistic(out_of_fold, y, told, penalty)
        weights[:, c] = w
        for e, x in zip(chained, v):
            before[c][e] = float(x)
        intercepts.append(float(b))
        p = np.empty(len(y))
        for k in range(folds):
            w, v, b = data.logistic(out_of_fold, y, told * (data.fold != k), penalty)
            p[data.fold == k] = sigmoid(data.raw(out_of_fold, w, v, b))[data.fold == k]
        chained.append(c)
        out_of_fold = np.column_stack([out_of_fold, p])
    verdict = len(names) - 1
    threshold = best_threshold(out_of_fold[:, -1], data.y[:, verdict], data.n) if verdict in chained else 0.5
    return Chain(names, {w: tuple(map(float, r)) for w, r in zip(vocabulary, weights)}, tuple(map(tuple, before)), tuple(intercepts), threshold)


def sigmoid(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


class Sample:
    """Rows of the bounded sample: the numbers of their words, their labels in every link, folds and multiplicities."""

    def __init__(self, rows, width: int, links: int):
        self.width = width
        self.row = np.repeat(np.arange(len(rows)), [len(r["held"]) for r in rows])
        self.word = np.array([h["i"] for r in rows for h in r["held"]], np.int64)
        self.much = np.array([h["much"] for r in rows for h in r["held"]], np.float64)
        self.y = np.array([[r[f"y{c}"] for c in range(links)] for r in rows], np.float64).reshape(-1, links)
        self.n = np.array([r["n"] for r in rows], np.float64)
        self.fold = np.array([r["fold"] for r in rows])

    def raw(self, extra: np.ndarray, w: np.ndarray, v: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(self.row, w[self.word] * self.much, len(self.n)) + extra @ v

    def logistic(self, extra: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float, steps: int = 600):
        """Weights of words, of ``extra`` columns and intercept of a ridge logistic regression, by accelerated gradient."""
        total = max(1.0, n.sum())
        widest = np.bincount(self.row, self.much**2, len(n)).max(initial=0) + extra.shape[1] + 1
        rate = 1 / (widest / 4 + penalty)
        now = old = np.zeros(self.width + extra.shape[1] + 1)
        for step in range(steps):
            ahead = now + step / (step + 3) * (now - old)
            w, v, b = ahead[: self.width], ahead[self.width : -1], ahead[-1]
            off = (sigmoid(self.raw(extra, w, v, b)) - y) * n / total
            slope = np.concatenate([np.bincount(self.word, off[self.row] * self.much, self.width) + penalty * w, off @ extra + penalty * v, [off.sum()]])
            now, old = ahead - rate * slope, now
        return now[: self.width], now[self.width : -1], now[-1]


def best_threshold(p: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The hundredth at which out-of-fold verdicts have the best F1; of equal ones the middle."""
    steps = np.arange(1, 100) / 100
    f1 = [2 * (n * y)[p >= t].sum() / max(1.0, (n * y).sum() + n[p >= t].sum()) for t in steps]
    top = np.flatnonzero(np.isclose(f1, max(f1)))
    return float(steps[top[len(top) // 2]])
