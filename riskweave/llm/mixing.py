"""Mixing sources to target weights by temperature, with DataFrame functions alone.

A source's weight is its share of the tokens raised to an exponent and normalised. Exponent 1 keeps the shares, 0 makes
all sources equal; as it falls, the entropy and the passes over small sources grow. Bisection finds where the entropy
reaches its target or, if that comes first, the passes reach their limit.

Weights times the budget give every source a budget of its own, met by whole passes over the source and a partial one.
A source's documents lie in blocks by hash, and the blocks are permuted by another hash. The partial pass takes blocks in
that order; only in the block in which the budget ends are documents ordered one by one. What comes out of this is one
row per source (passes, last block, last document), so every document is decided where it lies, and a source of any
size is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import attach_groups, text_of

ROUNDS = 10  # of bisection; each tries 15 exponents in one job and so halves the interval four times
BLOCK_ROWS = 1000  # documents of a block on average
BROADCAST_SOURCES = 100_000  # more sources than this are joined by shuffling
SEED = "mix"


def token_count(text: str | Column) -> Column:
    """Words between ASCII white space, a stand-in for tokens that needs no vocabulary; null and blank texts have none."""
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _block(key: Column, docs: Column) -> Column:
    """The block of a document: blocks number docs / BLOCK_ROWS, rounded up."""
    drawn = F.conv(F.substring(_key(SEED, "block", key), 1, 8), 16, 10).cast("long")
    return drawn % F.ceil(docs / BLOCK_ROWS)


def _block_key(source: Column, block: Column, turn: Column | int = 0) -> Column:
    return _key(SEED, F.lit(turn) if isinstance(turn, int) else turn, source, block)


def _doc_key(key: Column, turn: Column | int = 0) -> Column:
    return _key(SEED, F.lit(turn) if isinstance(turn, int) else turn, key)


def exponent(sources: DataFrame, budget_share: float, entropy_share: float, repeats: float, rounds: int = ROUNDS) -> float:
    """The largest exponent in [0, 1] at which the entropy reaches ``entropy_share`` of its largest possible value or a
    source is passed over ``repeats`` times. ``sources`` has the column tokens, above 0."""
    total, kinds = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not kinds:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def too_large(alphas: list[float]) -> dict[float, bool]:
        rows = sources.select("tokens", share.alias("share"), F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
        rows = rows.withColumn("p", F.pow("share", "alpha"))
        # For weights p / z the entropy is ln z - sum(p ln p) / z, and the passes are the budget * p / (z * tokens).
        sums = rows.groupBy("alpha").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("plogp"),
                                         F.max(F.col("p") / F.col("tokens")).alias("top"))
        entropy = F.log("z") - F.col("plogp") / F.col("z")
        passes = F.col("top") / F.col("z") * (float(total) * budget_share)
        return {r[0]: r[1] for r in sums.select("alpha", (entropy < F.lit(entropy_share) * F.log(F.lit(float(kinds)))) & (passes < repeats)).collect()}

    low, high = 0.0, 1.0
    if not too_large([1.0])[1.0]:
        return 1.0
    for _ in range(rounds):
        tried = [low + (high - low) * k / 16 for k in range(1, 16)]
        large = too_large(tried)
        low, high = max([a for a in tried if not large[a]], default=low), min([a for a in tried if large[a]], default=high)
    return low


def plan(docs: DataFrame, key: str, source: str, tokens: str, budget_share: float = 1.0, entropy_share: float = 0.95,
         repeats: float = 4.0) -> DataFrame:
    """One row per source: _source, docs, tokens, weight, budget, passes, last_block, last_doc.

    ``budget_share``: tokens to give out, as a share of all tokens. A source's budget is also at most ``repeats`` times
    its tokens. A source without tokens has weight 0 and takes no part. Null is a source of its own.
    """
    rows = materialize(docs.select(F.col(key).cast("string").alias("key"), F.coalesce(source, F.lit("\x00")).alias("_source"),
                                   F.coalesce(tokens, F.lit(0)).alias("n")))
    sources = materialize(rows.groupBy("_source").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")))
    some = sources.where("tokens > 0")
    alpha = exponent(some.select("tokens"), budget_share, entropy_share, repeats)
    total = some.agg(F.sum("tokens")).first()[0] or 1
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(alpha))).otherwise(0.0)
    z = some.agg(F.sum(power)).first()[0] or 1.0
    sources = sources.withColumn("weight", power / F.lit(z))
    spent = F.least(F.floor(F.col("weight") * F.lit(total * budget_share) + 0.5), F.floor(F.col("tokens") * F.lit(repeats))).cast("long")
    sources = sources.withColumn("budget", spent).withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0))
    sources = sources.withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
    dealt = _with_sources(rows, sources.select("_source", "docs", "rest"), "key").where("rest > 0").withColumn("block", _block(F.col("key"), F.col("docs")))
    blocks = dealt.groupBy("_source", "block").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("block_key", _block_key(F.col("_source"), F.col("block")))
    upto = F.sum("n").over(Window.partitionBy("_source").orderBy("block_key"))
    # The first block that goes beyond the rest is where the partial pass ends; without one it takes all blocks.
    over = blocks.withColumn("upto", upto).where("upto > rest")
    last = over.groupBy("_source").agg(F.min(F.struct("block_key", "block", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))).alias("last"))
    last = last.select("_source", "last.*")
    edge = dealt.join(F.broadcast(last) if sources.count() <= BROADCAST_SOURCES else last, ["_source", "block"])
    edge = edge.withColumn("doc_key", _doc_key(F.col("key")))
    edge = edge.withColumn("upto", F.sum("n").over(Window.partitionBy("_source").orderBy("doc_key")))  # one block per source
    ends = edge.where("upto <= left").groupBy("_source").agg(F.max("doc_key").alias("last_doc"))
    out = sources.join(last.select("_source", F.col("block_key").alias("last_block")), "_source", "left").join(ends, "_source", "left")
    # Without a rest nothing lies before the first block; a rest that all blocks fit into lies before the end of all keys.
    out = out.withColumn("last_block", F.when(F.col("rest") > 0, F.coalesce("last_block", F.lit("g"))).otherwise(""))
    return materialize(out.select("_source", "docs", "tokens", "weight", "budget", "passes", "last_block", F.coalesce("last_doc", F.lit("")).alias("last_doc")))


def _with_sources(rows: DataFrame, sources: DataFrame, spread: str) -> DataFrame:
    if sources.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), "_source", "left")
    return attach_groups(rows, sources, "_source", "docs", rows.count(), spread)


def realise(docs: DataFrame, key: str, source: str, plans: DataFrame) -> DataFrame:
    """The mixed rows: those of ``docs``, as often as ``plans`` says, with pass (from 0) and place.

    Sorted by pass and place, blocks of all sources follow each other in random order. Repeated rows are treated alike;
    null keys count as one key. Columns may have any names but pass and place, which are refused.
    """
    if taken := {"pass", "place"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the result has columns of these names itself: {sorted(taken)}")
    return _turns(docs, key, source, plans).select("_row.*", "pass", "place")


def _turns(docs: DataFrame, key: str, source: str, plans: DataFrame) -> DataFrame:
    """(_row, pass, place, ...) with every row of ``docs`` as a struct, so that its names meet no others."""
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(source, F.lit("\x00")).alias("_source"), F.col(key).cast("string").alias("_key"))
    side = plans.select("_source", "docs", "passes", "last_block", "last_doc")
    if plans.count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(side), "_source")
    else:
        rows = attach_groups(rows, side, "_source", "docs", docs.count(), "_key")
    rows = rows.withColumn("block", _block(F.col("_key"), F.col("docs")))
    at = _block_key(F.col("_source"), F.col("block"))
    partial = (at < F.col("last_block")) | ((at == F.col("last_block")) & (_doc_key(F.col("_key")) <= F.col("last_doc")))
    # The partial pass is number 0 of the order; whole passes follow it.
    turns = F.filter(F.sequence(F.lit(0), F.col("passes").cast("int")), lambda t: (t > 0) | partial)
    rows = rows.withColumn("pass", F.explode(turns))
    place = F.concat(F.substring(_block_key(F.col("_source"), F.col("block"), F.col("pass")), 1, 12),
                     F.substring(_doc_key(F.col("_key"), F.col("pass")), 1, 12))
    return rows.withColumn("place", place)


def mix(docs: DataFrame, key: str, source: str, text: str, **parameters: float) -> DataFrame:
    """``docs`` mixed by the word counts of their texts, with their own columns only, whatever these are called; parameters
    as in ``plan``. An empty table stays empty."""
    counted = docs.select(key, source, token_count(text).alias("_n"))
    return _turns(docs, key, source, plan(counted, key, source, "_n", **parameters)).select("_row.*")
