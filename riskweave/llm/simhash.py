"""SimHash near-duplicates by an embedding of segment bit counts.

A 64-bit fingerprint is cut into segments of two bits and mapped to the numbers of ones per segment: a point in 32
dimensions. The Manhattan distance of two points never exceeds the Hamming distance of the fingerprints, so links of at
most ``reach`` bits lie in a range join of the points. Its grid: the dimensions are dealt into blocks, and a distance of
at most ``reach`` leaves all but ``reach`` blocks untouched. A point therefore lies in one cell for every choice of the
untouched blocks, and every pair in range meets in at least one cell. Pairs of a cell within the Manhattan distance are
then verified by the fingerprints' bits.

Counts are written in unary (0: 00, 1: 01, 2: 11), so the Manhattan distance is the number of differing bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import materialize
from .common import attach_groups, one_of_each
from .components import connected_components

SEED = 42
SEGMENTS = 32
PAIR_BITS = 1.5  # information of the number of ones in two random bits
LOW = 0x5555555555555555
CELL_ROWS = 2048  # cells with more fingerprints are compared block by block
SHORT_RUN = 12
STEP = 50_000  # shingles hashed at once


# ---------------------------------------------------------------- fingerprints

def run_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of all runs of ``shingle`` words, in steps; a text of fewer words is one run, one without words has none."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return
    ends = np.cumsum([len(w) + 1 for w in words])
    line, k = b" ".join(words), min(shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k]]).tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    for i in range(0, len(starts), STEP):
        yield np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[i : i + STEP], stops[i : i + STEP])], np.uint64)


def fingerprint_of(text: str, shingle: int) -> int:
    ones, runs = np.zeros(64, np.int64), 0
    for hashes in run_hashes(text, shingle):
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        runs += len(hashes)
    return int(np.packbits(2 * ones > runs).view(">i8")[0])


def fingerprint(text: str | Column, shingle: int = 3) -> Column:
    """64-bit SimHash (long) of a whole text over runs of ``shingle`` words, repeats included.

    A text of fewer words counts as one run; null, empty and blank texts get zero. Equal texts get equal fingerprints.
    """

    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t.as_py() or "", shingle) for t in texts], pa.int64())

    return prints(text)


def hex_of(bits: str) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


# ---------------------------------------------------------------- embedding and grid

def embedding(bits: Column) -> Column:
    """Numbers of ones of the 32 segments, in unary."""
    up = F.shiftrightunsigned(bits, 1)
    return bits.bitwiseOR(up).bitwiseAND(F.lit(LOW)).bitwiseOR(F.shiftleft(bits.bitwiseAND(up).bitwiseAND(F.lit(LOW)), 1))


def embed(bits: np.ndarray) -> np.ndarray:
    low, one = np.uint64(LOW), np.uint64(1)
    return ((bits | bits >> one) & low) | ((bits & bits >> one & low) << one)


def masks(blocks: int, reach: int) -> list[int]:
    """Bits of the embedding that each choice of untouched blocks keeps, as signed numbers."""
    cuts = [64 // SEGMENTS * (SEGMENTS * i // blocks) for i in range(blocks + 1)]
    parts = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    whole = [sum(c) for c in combinations(parts, blocks - reach)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def blocks_for(n: int, reach: int) -> int:
    """The fewest blocks for which a fingerprint meets about one unrelated one per cell. All numbers give the same links."""
    return next(b for b in range(reach + 1, SEGMENTS + 1)
                if b == SEGMENTS or log2(max(2, n)) <= PAIR_BITS * SEGMENTS * (b - reach) / b)


def links(prints: DataFrame, n: int, reach: int = 3) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints in the column ``bits`` within ``reach`` bits. Within a cell of many
    fingerprints only a spanning forest of the pairs is given, which keeps the components as they are."""
    keep = masks(blocks_for(n, reach), reach)
    cells = prints.select("bits", F.posexplode(F.array(*[embedding(F.col("bits")).bitwiseAND(F.lit(m)) for m in keep])).alias("grid", "cell"))
    full = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL_ROWS)
    full = full.select("grid", "cell", F.ceil(F.col("n") * 2 / CELL_ROWS).cast("int").alias("parts"))
    # A cell of few fingerprints is one part; a full one is cut into parts by hash, and every two parts meet in one task.
    dealt = _with_parts(cells, full, n * len(keep)).withColumn("part", F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = dealt.select("grid", "cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "bits")
    keys = ["grid", "cell", "i", "j"]
    runs = rows.repartition(*keys).sortWithinPartitions(*keys, "bits")
    return runs.mapInArrow(lambda batches: _compare(batches, reach), "a bigint, b bigint").distinct()


def _with_parts(cells: DataFrame, full: DataFrame, n_rows: int) -> DataFrame:
    """Full cells number at most rows / CELL_ROWS. They are broadcast while that is few, else joined."""
    if n_rows // CELL_ROWS <= 100_000:
        full = F.broadcast(full)
    return cells.join(full, ["grid", "cell"], "left").fillna(1, ["parts"])


def _compare(batches: Iterable[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Links within the runs of equal keys in sorted rows; the last run of a batch waits for the next batch."""
    held = None

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        *keys, bits = (c.to_numpy() for c in table.columns)
        bits = bits.view(np.uint64)
        new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(bits)))
        run, sizes = np.repeat(np.arange(len(first)), size), np.repeat(size, size)
        near = lambda a, b: (np.bitwise_count(embed(a) ^ embed(b)) <= reach) & (np.bitwise_count(a ^ b) <= reach)
        short = sizes <= SHORT_RUN
        pairs = []
        for step in range(1, min(SHORT_RUN, len(bits))):
            at = np.flatnonzero((run[step:] == run[:-step]) & short[step:])
            at = at[near(bits[at], bits[at + step])]
            pairs.append(np.stack([bits[at], bits[at + step]]))
        for k in np.flatnonzero(size > SHORT_RUN):
            pairs.append(_forest(bits[first[k] : first[k] + size[k]], near))
        if pairs:
            a, b = np.concatenate(pairs, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        keys = [c.to_numpy() for c in table.columns[:-1]]
        same = np.logical_and.reduce([k == k[-1] for k in keys])
        cut = int(np.argmax(same))
        held = table.slice(cut)
        if cut:
            yield from found(table.slice(0, cut))
    if held is not None:
        yield from found(held)


def _forest(bits: np.ndarray, near) -> np.ndarray:
    """A spanning forest of the links among the fingerprints."""
    left, edges = bits, []
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            for bit in queue.pop():
                hit = near(left, bit)
                if hit.any():
                    queue.append(left[hit])
                    edges.append(np.stack([np.full(int(hit.sum()), bit), left[hit]]))
                    left = left[~hit]
    return np.concatenate(edges, axis=1) if edges else np.empty((2, 0), np.uint64)


# ---------------------------------------------------------------- operators

def _classes(df: DataFrame, key: str, text: str, shingle: int, reach: int) -> DataFrame:
    """One row per row of ``df``: _key, fingerprint, _root (fingerprint that names the class), _least (smallest key there)."""
    docs = materialize(df.select(F.col(key).alias("_key"), fingerprint(F.col(text), shingle).alias("bits")))
    prints = materialize(docs.groupBy("bits").agg(F.min("_key").alias("_own"), F.count("*").alias("_size")))
    roots = materialize(connected_components(links(prints.select("bits"), prints.count(), reach)))
    linked = prints.join(roots, F.col("bits") == F.col("node"), "left").select("bits", "_own", "_size", F.coalesce("root", "bits").alias("_root"))
    least = linked.groupBy("_root").agg(F.min("_own").alias("_least"))
    classes = linked.join(least, "_root").select(hex_of("bits").alias("fingerprint"), "_size", hex_of("_root").alias("_root"), "_least")
    rows = docs.select("_key", hex_of("bits").alias("fingerprint"))
    return attach_groups(rows, classes, "fingerprint", "_size", docs.count(), "_key")


def near_copies(df: DataFrame, key: str, text: str, shingle: int = 3, reach: int = 3) -> DataFrame:
    """One row per row of ``df``: key, fingerprint (16 hex digits), component_id (smallest key reachable by links of at
    most ``reach`` differing bits, its own included).

    Null keys take no part in that minimum, and it is null where all keys are. Null and empty texts share fingerprint
    zero. Repeated rows repeat in the result; an empty table gives none. Other columns do not matter.
    """
    return _classes(df, key, text, shingle, reach).select(F.col("_key").alias(key), "fingerprint", F.col("_least").alias("component_id"))


def drop_near_copies(df: DataFrame, key: str, text: str, shingle: int = 3, reach: int = 3) -> DataFrame:
    """The rows of ``df``, one per class: that with the smallest key, null keys last, of rows that tie just one. Columns
    may have any names."""
    classes = _classes(df, key, text, shingle, reach)
    first = classes.groupBy("_root").agg(F.min(F.struct(F.col("_key").isNull().alias("no_key"), "_key", "fingerprint")).alias("f"))
    kept = first.select(F.col("f._key").alias("_kept_key"), F.col("f.fingerprint").alias("_kept_print"))
    repeated = not classes.groupBy("_key", "fingerprint").count().where("count > 1").isEmpty()
    marked = df.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), fingerprint(F.col(text), shingle).alias("_bits"))
    left = marked.join(kept, (hex_of("_bits") == F.col("_kept_print")) & F.col("_key").eqNullSafe(F.col("_kept_key")), "left_semi")
    return one_of_each(left, ["_bits", "_key"], repeated).select("_row.*")
