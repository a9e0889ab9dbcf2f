"""Scalar column expressions: rules, ratios, calendar parts, buckets and hash draws.

Everything here is a plain ``Column -> Column`` expression, so it stays inside whole-stage
code generation and adds no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- values and rules

def map_values(c: Column | str, mapping: Mapping) -> Column:
    """Replace each key of ``mapping`` by its value; anything else becomes NULL."""
    c = as_column(c)
    out = None
    for key, value in mapping.items():
        out = F.when(c == F.lit(key), F.lit(value)) if out is None else out.when(c == F.lit(key), F.lit(value))
    return out if out is not None else F.lit(None)


def is_true(cond: Column) -> Column:
    """A condition on missing data counts as false, never as NULL."""
    return F.coalesce(cond, F.lit(False))


def any_flag(*conds: Column) -> Column:
    """1 when at least one condition holds, else 0."""
    return reduce(lambda a, b: a | b, [is_true(c) for c in conds]).cast("int")


def swap_fraud_label(devices: Column, locations: Column, plan: Column, usage: Column) -> Column:
    """Many device changes, many location changes, or a prepaid plan that is hardly used."""
    return any_flag(devices > 3, locations > 5, (plan == "prepaid") & (usage < 0.5))


def threshold_flag(c: Column | str, k: float) -> Column:
    """1 when the value exceeds ``k``; missing counts as 0."""
    return any_flag(as_column(c) > k)


def velocity_flag(per_day: Column | None = None, per_hour: Column | None = None) -> Column:
    """1 when a key placed 3 orders in a day or 2 in an hour; a missing input is no evidence."""
    conds = []
    if per_day is not None:
        conds.append(per_day >= 3)
    if per_hour is not None:
        conds.append(per_hour >= 2)
    return any_flag(*conds) if conds else F.lit(0)


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound from one or both sides. ``least``/``greatest`` skip NULLs, so NULL is kept by hand."""
    c = as_column(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


# ---------------------------------------------------------------- ratios

def relative_deviation(amount: Column | str, mean: Column | str) -> Column:
    amount, mean = as_column(amount), as_column(mean)
    return F.abs(amount - mean) / (mean + F.lit(1e-6))


def safe_ratio(n: Column | str, d: Column | str, mode: str = "zero") -> Column:
    """``zero``: 0 where the denominator is 0. ``plus_one``: n / (d + 1)."""
    n, d = as_column(n).cast("double"), as_column(d).cast("double")
    if mode == "zero":
        # A missing denominator is not zero, so the quotient (NULL) is kept.
        return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(n, d))
    if mode == "plus_one":
        return F.try_divide(n, d + 1)
    raise ValueError(f"unknown ratio mode {mode!r}")


def period_rate(c: Column | str, periods: float) -> Column:
    return as_column(c).cast("double") / F.lit(float(periods))


# ---------------------------------------------------------------- time

def parse_time(c: Column | str, fmt: str | None = None) -> Column:
    """Text to timestamp; unreadable text becomes NULL instead of failing the job."""
    c = as_column(c)
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def hour_of(ts: Column | str) -> Column:
    return F.hour(as_column(ts))


def weekday_of(ts: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(as_column(ts))


def micros_of(ts: Column | str, has_zone: bool) -> Column:
    """Microseconds since 1970. A time without a zone is read from its own parts, as converting it
    to an instant would shift it around the session zone's clock changes."""
    ts = as_column(ts)
    if has_zone:
        return F.unix_micros(ts)
    seconds = (F.unix_date(ts.cast("date")).cast("bigint") * 86_400
               + F.hour(ts).cast("bigint") * 3_600 + F.minute(ts).cast("bigint") * 60)
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


# ---------------------------------------------------------------- scores to decisions

def risk_bucket(p: Column | str, cuts: Sequence[float], labels: Sequence[str], closed: str = "left") -> Column:
    """Name the interval ``p`` falls in.

    ``closed='left'``: a score equal to a cut belongs to the interval above it.
    ``closed='right'``: it belongs to the interval below it.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError("need one label more than cuts")
    if closed not in ("left", "right"):
        raise ValueError("closed is 'left' or 'right'")
    if list(cuts) != sorted(set(cuts)):
        raise ValueError("cuts must rise strictly")
    p = as_column(p)
    out = F.when(p.isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        out = out.when(p < cut if closed == "left" else p <= cut, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def recommend_action(tier: Column | str, churn: Column | str, threshold: float = 0.5) -> Column:
    tier, churn = as_column(tier), as_column(churn)
    return (
        F.when(is_true((tier == "High") & (churn > threshold)), F.lit("Retention Priority"))
        .when(is_true(tier.isin("High", "Medium")), F.lit("Upsell/Cross-sell"))
        .otherwise(F.lit("Low-cost Nurture"))
    )


def weighted_score(
    weights: Mapping[str, float],
    indicators: Mapping[tuple[str, str], float] | None = None,
    interactions: Mapping[tuple[str, str], float] | None = None,
    intercept: float = 0.0,
    lo: float | None = 0.0,
    hi: float | None = None,
) -> Column:
    """Linear score over columns, category indicators and products, bounded at the end."""
    terms = [F.lit(float(intercept))]
    terms += [F.col(c) * F.lit(float(w)) for c, w in weights.items()]
    terms += [(F.col(c) == v).cast("double") * F.lit(float(w)) for (c, v), w in (indicators or {}).items()]
    terms += [F.col(a) * F.col(b) * F.lit(float(w)) for (a, b), w in (interactions or {}).items()]
    total = reduce(lambda a, b: a + b, terms)
    return clip(total, lo, hi) if lo is not None or hi is not None else total


def decide(p: Column | str, threshold: float = 0.5) -> Column:
    return (as_column(p) >= threshold).cast("int")


def yes_no(p: Column | str, threshold: float = 0.5) -> Column:
    p = as_column(p)
    return F.when(p >= threshold, F.lit("Yes")).when(p.isNotNull(), F.lit("No"))


# ---------------------------------------------------------------- repeatable randomness

def hash_key(*keys: Column | str, seed: int | str) -> Column:
    """Hex digest of the key and the seed: the same draw on every run and every layout."""
    parts = [as_column(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))


def hash_int(*keys: Column | str, seed: int | str) -> Column:
    """A whole number in [0, 2^32) from the first eight hex digits."""
    return F.conv(F.substring(hash_key(*keys, seed=seed), 1, 8), 16, 10).cast("bigint")


def hash_long(*keys: Column | str, seed: int | str) -> Column:
    """A whole number in [0, 2^60) from the first fifteen hex digits, to draw from very many rows."""
    return F.conv(F.substring(hash_key(*keys, seed=seed), 1, 15), 16, 10).cast("bigint")


def hash_unit(*keys: Column | str, seed: int | str) -> Column:
    """A number in [0, 1)."""
    return hash_int(*keys, seed=seed) / F.lit(4294967296.0)
