"""Line deduplication with a sharded minimal perfect hash.

Lines are known by 128-bit hashes of their keys. Counting them is a grouping with partial sums in every task. The hashes
found in enough documents are dealt into shards by their first bits, and each shard becomes a minimal perfect hash that
numbers its hashes without gaps, and arrays in that order: 64-bit fingerprints, counts (one byte, larger ones as 255) and
the largest document that holds the line. A minimal perfect hash gives every hash some number; the fingerprint, bits
that the numbering does not use, tells whether the line is the one numbered.

Documents probe these arrays instead of joining their lines to others. The arrays' size is known beforehand. Within
SENT_BYTES all shards go to every task and no text is shuffled; beyond, hashes with their document's key go to the
tasks that hold their shard, and those to drop come back to the documents.

Numbering: a hash sets the bit that it falls on in a first bit array; where several fall on one bit it stays unset, and
they go on to the next, smaller array. A hash's number is the count of set bits before its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from ..session import materialize

BLANK = " \t\n\x0b\x0c\r"  # fixed values: what is stripped off a line to get its key
SHARD_HASHES = 200_000  # hashes of a shard on average
HASH_BYTES = 19  # of a hash in the index: fingerprint, count and largest document, and under 2 of the bit arrays
SENT_BYTES = 64_000_000  # an index of at most this size is sent to every task
PAIRS = 1_000_000  # lines that probe a shard in one task
LOAD = 2  # bits of an array per hash that comes to it
MOST = 255
INDEX = "shard int, levels array<binary>, prints binary, counts binary, largest binary"


# ---------------------------------------------------------------- lines

def line_hashes(lines: Iterable[str], least: int) -> list[bytes | None]:
    """Hashes of the keys of at least ``least`` code points, None for shorter ones. A line's key is the line without
    white space at its ends, A-Z in lower case."""
    keys = [line.strip(BLANK) for line in lines]
    return [xxh3_128_digest(k.encode("utf-8").lower()) if len(k) >= least else None for k in keys]


def words_of(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of hashes as unsigned numbers: for the place, and for the fingerprint."""
    both = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def shard_of(place: np.ndarray, shards: int) -> np.ndarray:
    return ((place >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


# ---------------------------------------------------------------- minimal perfect hash

def spot(place: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Where hashes fall in the bit array of a level."""
    x = place ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ x >> np.uint64(33)) % np.uint64(bits)).astype(np.int64)


def build_levels(place: np.ndarray) -> list[np.ndarray]:
    """Bit arrays (words of 64) that number the given distinct hashes."""
    levels, left = [], place
    while len(left):
        bits = 64 * -(-LOAD * len(left) // 64)
        at = spot(left, len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        left = left[~alone[at]]
    return levels


class Numbering:
    """Numbers from 0 without gaps for the hashes that the levels were built from; any number or -1 for others."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.before, n = levels, [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.before.append(n + np.cumsum(ones) - ones)
            n += int(ones.sum())

    def number(self, place: np.ndarray) -> np.ndarray:
        out = np.full(len(place), -1, np.int64)
        todo = np.arange(len(place))
        for level, (words, before) in enumerate(zip(self.levels, self.before)):
            at = spot(place[todo], level, 64 * len(words))
            word, bit = words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (word & bit) != 0
            rank = np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1)))
            out[todo[hit]] = before[at[hit] >> 6] + rank
            todo = todo[~hit]
        return out


class Shard:
    """The numbering and the arrays of one shard."""

    def __init__(self, levels: list[bytes], prints: bytes, counts: bytes, largest: bytes):
        self.numbering = Numbering([np.frombuffer(x, np.uint64) for x in levels])
        self.prints, self.counts = np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint8)
        self.largest = np.frombuffer(largest, np.int64)

    @staticmethod
    def build(place: np.ndarray, prints: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> tuple[list[bytes], bytes, bytes, bytes]:
        levels = build_levels(place)
        order = np.empty(len(place), np.int64)
        order[Numbering(levels).number(place)] = np.arange(len(place))
        return ([x.tobytes() for x in levels], prints[order].tobytes(), np.minimum(counts[order], MOST).astype(np.uint8).tobytes(),
                largest[order].astype(np.int64).tobytes())

    def probe(self, place: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, largest documents) of hashes; a hash that is not here has count 0."""
        at = self.numbering.number(place)
        here = np.flatnonzero(at >= 0)
        here = here[self.prints[at[here]] == prints[here]]
        counts, largest = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        counts[here], largest[here] = self.counts[at[here]], self.largest[at[here]]
        return counts, largest


NOBODY = -(2**63)  # in place of the largest document: no holder has a key


def dropped(shards: Mapping[int, Shard], n_shards: int, hashes: list[bytes], keys: np.ndarray, least_docs: int) -> np.ndarray:
    """For (hash, document) pairs, null keys as NOBODY: does the document lose the line?"""
    out = np.zeros(len(hashes), bool)
    if not hashes or not n_shards:
        return out
    place, prints = words_of(hashes)
    shard = shard_of(place, n_shards)
    for number in np.unique(shard).tolist():
        if number in shards:
            rows = np.flatnonzero(shard == number)
            counts, largest = shards[number].probe(place[rows], prints[rows])
            out[rows] = (counts >= least_docs) & (largest != keys[rows])
    return out


# ---------------------------------------------------------------- index

def held_lines(docs: DataFrame, text: str, least_chars: int) -> DataFrame:
    """The other columns of ``docs`` with the hash of every distinct line of ``least_chars`` code points and more."""
    names = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("hash", T.BinaryType())])

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set(line_hashes((t.as_py() or "").split("\n"), least_chars)) - {None} for t in batch.column(text)]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in names], pa.array([h for f in found for h in f], pa.binary())],
                                             [*names, "hash"])

    return docs.select(*names, text).mapInArrow(split, schema)


def frequent_lines(docs: DataFrame, key: str, text: str, least_chars: int, least_docs: int) -> DataFrame:
    """(hash, n, largest): lines found in at least ``least_docs`` rows, and the largest key among those."""
    held = held_lines(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "text", least_chars)
    counted = held.groupBy("hash").agg(F.count("*").alias("n"), F.max("key").alias("largest"))
    return counted.where(F.col("n") >= least_docs)


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """One row per shard with its numbering and arrays. Hashes are spread evenly, so shards are alike in size."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        place, prints = words_of(frame["hash"].tolist())
        parts = Shard.build(place, prints, frame["n"].to_numpy(), frame["largest"].to_numpy())
        return pd.DataFrame([(int(frame["shard"].iloc[0]), *parts)], columns=["shard", "levels", "prints", "counts", "largest"])

    rows = lines.select("hash", "n", F.coalesce("largest", F.lit(NOBODY)).alias("largest"), shard_column("hash", shards))
    return rows.groupBy("shard").applyInPandas(build, INDEX)


def shard_column(hashes: str, shards: int) -> Column:
    @F.pandas_udf("int")
    def shard(hashes: pd.Series) -> pd.Series:
        return pd.Series(shard_of(words_of(hashes.tolist())[0], shards).astype("int32"))

    return shard(hashes).alias("shard")


def load(rows: Iterable) -> dict[int, Shard]:
    return {r["shard"]: Shard(r["levels"], r["prints"], r["counts"], r["largest"]) for r in rows}


# ---------------------------------------------------------------- operator

KEPT = "struct<n_lines:bigint,n_dropped:bigint,kept:string>"


def drop_repeated_lines(docs: DataFrame, key: str, text: str, least_chars: int = 20, least_docs: int = 3,
                        shard_hashes: int = SHARD_HASHES, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(key, n_lines, n_dropped, kept) for every row: the number of lines, of those dropped, and the lines that stay.

    Lines end at line feeds. Two lines are the same if their keys are (see ``line_hashes``). A line whose key has at least
    ``least_chars`` code points and is found in at least ``least_docs`` rows is dropped from all rows but those with the
    largest key that hold it, where all its occurrences stay. Null keys are smaller than all others; if no other row holds
    the line it stays in them. A null text is an empty one: one empty line. Rows that repeat each count and come back
    each; an empty table gives no rows. Keys must be whole numbers; other columns of ``docs`` do not matter.
    """
    if not 1 <= least_docs <= MOST:
        raise ValueError(f"least_docs must lie between 1 and {MOST}, the largest count that the index holds")
    lines = materialize(frequent_lines(docs, key, text, least_chars, least_docs))
    n = lines.count()
    shards = max(1, -(-n // shard_hashes))
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(key).cast("long"), F.lit(NOBODY)).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"))
    if n * HASH_BYTES <= sent_bytes:
        held = load(build_index(lines, shards).collect())

        @F.arrow_udf(KEPT)
        def keep(ids: pa.Array, texts: pa.Array) -> pa.Array:
            ids = ids.to_numpy()
            return strip(texts, least_chars, lambda hashes, row: dropped(held, shards, hashes, ids[row], least_docs))

        out = rows.withColumn("r", keep("_id", "_text"))
    else:
        # Rows of equal key and text lose the same lines, so they may share what comes back.
        rows = rows.withColumn("_digest", F.xxhash64("_text"))
        gone = lost_lines(held_lines(rows.drop("_key"), "_text", least_chars), build_index(lines, shards), shards, least_docs)
        gone = gone.groupBy("_id", "_digest").agg(F.collect_set("hash").alias("gone"))

        @F.arrow_udf(KEPT)
        def keep(texts: pa.Array, gone: pa.Array) -> pa.Array:
            sets = [set(g.as_py() or ()) for g in gone]
            return strip(texts, least_chars, lambda hashes, row: np.array([h in sets[i] for h, i in zip(hashes, row)], bool))

        out = rows.join(gone, ["_id", "_digest"], "left").withColumn("r", keep("_text", "gone"))
    return out.select(F.col("_key").alias(key), "r.n_lines", "r.n_dropped", "r.kept")


def lost_lines(pairs: DataFrame, index: DataFrame, shards: int, least_docs: int) -> DataFrame:
    """Of the rows (_id, _digest, hash) those whose document loses the line. A shard that many rows ask for, as that of a
    very common line, is copied to several tasks."""
    pairs = materialize(pairs.withColumn("shard", shard_column("hash", shards)))
    parts = F.broadcast(pairs.groupBy("shard").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts")))  # a row per shard
    asked = pairs.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("_id", "_digest"), F.col("parts")).cast("int")).drop("parts")
    copies = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def probe(asked: pd.DataFrame, copies: pd.DataFrame) -> pd.DataFrame:
        lost = dropped(load(copies.to_dict("records")), shards, asked["hash"].tolist(), asked["_id"].to_numpy(), least_docs) if len(copies) else []
        return asked[["_id", "_digest", "hash"]][np.asarray(lost, bool)] if len(copies) else asked[["_id", "_digest", "hash"]].head(0)

    keys = ["shard", "part"]
    return asked.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(probe, "_id bigint, _digest bigint, hash binary")


def strip(texts: pa.Array, least_chars: int, lost: Callable[[list[bytes], np.ndarray], np.ndarray]) -> pa.Array:
    """Texts without the lines that ``lost(hashes, rows)`` tells, asked for all lines of the batch that have a hash."""
    lines = [t.as_py().split("\n") for t in texts]
    every = [line_hashes(row, least_chars) for row in lines]
    rows = np.repeat(np.arange(len(lines)), [sum(h is not None for h in row) for row in every])
    told = iter(lost([h for row in every for h in row if h is not None], rows).tolist())
    left = [[line for line, h in zip(row, hashes) if h is None or not next(told)] for row, hashes in zip(lines, every)]
    return pa.StructArray.from_arrays([
        pa.array([len(x) for x in lines], pa.int64()), pa.array([len(x) - len(y) for x, y in zip(lines, left)], pa.int64()),
        pa.array(["\n".join(x) for x in left], pa.string())], ["n_lines", "n_dropped", "kept"])
