"""Ranked lexical search by term at a time with a limited set of accumulators.

Documents are dealt over the tasks, so every score is made whole in one place and no list of a common word is ever
gathered. A first pass turns each document into its length and the counts of the words that items ask for; from it
come the statistics of all documents. Then every task takes its documents in blocks, inverts a block into lists per
word, and answers every item word by word, rarest first. A list's documents get accumulators until what the words left
can add at most is below the k-th best partial score: a document without one cannot be among the best any more. From
there on the lists only update the accumulators there are, exactly to the end. A task keeps the best k of each item,
which also tell its later blocks what a document has to reach.

Scores are integers: a word's weight times its saturated count, both rounded down by fixed rules.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

# Over UTF-8: ASCII letters and digits and all characters beyond ASCII belong to a term, what lies between becomes a space.
TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
SCALE, FREE, SLOPE = 1_000_000_000, 75, 25  # fixed values of the score: units, length-free and length-bound percent
K1 = 12  # tenths of the saturation, times a percentage
ITEM_TERMS = 200_000  # occurrences of terms in the items that are answered together
BLOCK_POSTINGS = 2_000_000  # postings of a task that are inverted together
COUNTED = "doc bigint, n bigint, terms array<int>, counts array<int>"
HITS = "item_id bigint, doc_id bigint, score bigint"


def terms_of(text: bytes | None) -> list[bytes]:
    """All terms of a text in UTF-8, with repeats; only A-Z change case. Null and empty texts have none."""
    return (text or b"").translate(TERM_BYTES).split()


# ---------------------------------------------------------------- items

@dataclass(frozen=True)
class Items:
    """A bounded set of items: ``ids``, the numbered ``vocabulary``, and per item the (term number, repeats) it asks for."""

    ids: tuple[int, ...]
    vocabulary: Mapping[bytes, int]
    asked: tuple[tuple[tuple[int, int], ...], ...]


def item_blocks(items: DataFrame, key: str, text: str, limit: int = ITEM_TERMS) -> Iterator[Items]:
    """The items in runs of about ``limit`` term occurrences, by key; only one run is on the driver at a time.

    Items with a null key are left out; of rows that repeat a key the one with the smallest text (null first) counts.
    """
    rows = items.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("item")).agg(
        F.min(F.struct(F.col(text).isNotNull().alias("some"), F.col(text).cast("binary").alias("t")))["t"].alias("t"))
    ids, texts, held = [], [], 0
    for row in rows.orderBy("item").toLocalIterator():
        terms = Counter(terms_of(row["t"]))
        if ids and held + terms.total() > limit:
            yield _numbered(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row["item"])
        texts.append(terms)
        held += terms.total()
    if ids:
        yield _numbered(ids, texts)


def _numbered(ids: Sequence[int], texts: Sequence[Counter]) -> Items:
    number = {t: i for i, t in enumerate(sorted(set().union(*texts)))}
    return Items(tuple(ids), number, tuple(tuple(sorted((number[t], n) for t, n in c.items())) for c in texts))


# ---------------------------------------------------------------- documents

def counted(docs: DataFrame, key: str, text: str, vocabulary: Mapping[bytes, int]) -> DataFrame:
    """(doc, n, terms, counts): the number of terms of every document that has any, and how often it holds those of the
    vocabulary. Null keys stay null."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n, terms, counts = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(t.as_py())
                if found:
                    held = [(vocabulary[w], c) for w, c in Counter(found).items() if w in vocabulary]
                    doc.append(k)
                    n.append(len(found))
                    terms.append([w for w, _ in held])
                    counts.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                              pa.array(counts, pa.list_(pa.int32()))], ["doc", "n", "terms", "counts"])

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("text")).mapInArrow(count, COUNTED)


@dataclass(frozen=True)
class Statistics:
    docs: int
    length: int
    weights: np.ndarray  # per number of the vocabulary


def statistics(rows: DataFrame, terms: int) -> Statistics:
    """Over all rows of ``counted``; the weights of terms that no document holds are never used."""
    docs, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # bounded by the vocabulary
    weights = np.zeros(terms, np.int64)
    for r in held:
        weights[r["term"]] = floor(1000 * log((2 * docs + 2) / (2 * r["count"] + 1)))
    return Statistics(docs, length, weights)


# ---------------------------------------------------------------- scores

class Block:
    """Documents of one task, inverted: per term the places of its documents and what it adds to their scores."""

    def __init__(self, docs: np.ndarray, n: np.ndarray, size: np.ndarray, terms: np.ndarray, counts: np.ndarray, stats: Statistics):
        self.docs = docs
        order = np.argsort(terms, kind="stable")
        self.place = np.repeat(np.arange(len(docs)), size)[order]
        terms, counts = terms[order], counts[order].astype(np.int64)
        m = FREE + SLOPE * n * stats.docs // max(1, stats.length)
        self.adds = stats.weights[terms] * (SCALE * counts // (1000 * counts + K1 * m[self.place]))
        edges = np.searchsorted(terms, np.arange(len(stats.weights) + 1))
        self.spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        most = np.zeros(len(stats.weights), np.int64)
        np.maximum.at(most, terms, self.adds)
        self.most = most.tolist()

    def best(self, asked: Sequence[tuple[int, int]], weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the documents that may be among the best ``k``, scores above 0. ``least``: a score that ``k``
        documents elsewhere reach already."""
        lists = [(t, r) for t, r in sorted(asked, key=lambda a: (-weights[a[0]], a[0])) if self.spans[t][0] < self.spans[t][1]]
        left = [0, *np.cumsum([self.most[t] * r for t, r in reversed(lists)]).tolist()][::-1]
        score, has, open_ = np.zeros(len(self.docs), np.int64), np.zeros(len(self.docs), bool), True
        for i, (t, repeats) in enumerate(lists):
            a, b = self.spans[t]
            places, adds = self.place[a:b], self.adds[a:b]
            if open_ and left[i] < max(least, kth(score[has], k)):
                open_ = False
            if open_:
                has[places] = True
            else:
                stays = has[places]
                places, adds = places[stays], adds[stays]
            score[places] += adds * repeats
        found = np.flatnonzero(score > 0)
        found = found[score[found] >= max(least, kth(score[found], k))]
        return found, score[found]


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest, 0 where there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _score(batches: Iterable[pa.RecordBatch], items: Items, stats: Statistics, k: int, block_postings: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` documents of each item among the rows of one task."""
    best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items.ids]

    def answer(held: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        doc, n = table["doc"].to_numpy(), table["n"].to_numpy()
        lists = [table[c].combine_chunks() for c in ("terms", "counts")]
        size = np.diff(lists[0].offsets.to_numpy())
        block = Block(doc, n, size, *[x.flatten().to_numpy() for x in lists], stats)
        for i, asked in enumerate(items.asked):
            docs, scores = best[i]
            places, more = block.best(asked, stats.weights, k, kth(scores, k))
            docs, scores = np.concatenate([docs, doc[places]]), np.concatenate([scores, more])
            first = np.lexsort((docs, -scores))[:k]
            best[i] = docs[first], scores[first]

    held, postings = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            postings += len(batch.column(2).flatten())
        if postings >= block_postings:
            answer(held)
            held, postings = [], 0
    if held:
        answer(held)
    for i, (docs, scores) in enumerate(best):
        if len(docs):
            yield pa.RecordBatch.from_arrays([pa.array([items.ids[i]] * len(docs), pa.int64()), pa.array(docs), pa.array(scores)], ["item_id", "doc_id", "score"])


def search(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, k: int = 20,
           item_terms: int = ITEM_TERMS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item with a score above 0, fewer where there are
    no more; ranks start at 1, equal scores are ordered by ascending key.

    Every row of ``docs`` with at least one term is a document of its own, also if it repeats another. Null and empty
    texts have no terms. Rows with a null key count in the statistics, but are not ranked. Texts of any length are read
    whole. Items: see ``item_blocks``; one without terms, or whose terms no document holds, gets no rows, and so does
    every item if either table is empty. Other columns of either table do not matter.
    """
    spark, found = docs.sparkSession, []
    for block in item_blocks(items, item_key, item_text, item_terms):
        rows = materialize(counted(docs, key, text, block.vocabulary))
        stats = statistics(rows, len(block.vocabulary))
        ranked = rows.where(F.col("doc").isNotNull()).mapInArrow(
            lambda batches, block=block, stats=stats: _score(batches, block, stats, k, block_postings), HITS)
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
        found.append(ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
