"""Element-wise and layer arithmetic on ``array<double>`` columns with higher-order functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column

EPS = 1e-9  # fixed value: keeps log() finite at probability 0


def doubles(c: Column | str) -> Column:
    return as_column(c).cast("array<double>")


def rescale(c: Column | str, by: float) -> Column:
    return F.transform(doubles(c), lambda v: v / F.lit(float(by)))


UNROLL = 64  # products up to which a layer is written out as plain arithmetic


def dense_layer(c: Column | str, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """x · W + b; ``weights`` holds one row per input.

    Small layers become plain arithmetic, which compiles with the rest of the stage. Larger ones
    would outgrow what the JVM compiles, so they fold over literal weight arrays. An input of another
    length than ``weights`` raises in both.
    """
    if any(len(row) != len(bias) for row in weights):
        raise ValueError("every weight row needs one value per output")
    x = doubles(c)
    wrong = F.size(x) != len(weights)
    x = F.when(wrong, F.raise_error(F.lit(f"a layer of {len(weights)} inputs got another number of values"))).otherwise(x)
    outputs = []
    for j, b in enumerate(bias):
        column = [float(row[j]) for row in weights]
        if len(weights) * len(bias) <= UNROLL:
            dot = reduce(lambda a, t: a + t, [x[i] * F.lit(w) for i, w in enumerate(column)])
        else:
            products = F.zip_with(x, F.array(*[F.lit(w) for w in column]), lambda v, w: v * w)
            dot = array_sum(products)
        outputs.append(dot + F.lit(float(b)))
    return F.array(*outputs)


def sigmoid(c: Column | str) -> Column:
    return F.transform(as_column(c), lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def relu(c: Column | str) -> Column:
    return F.transform(as_column(c), lambda z: F.greatest(z, F.lit(0.0)))


def tanh(c: Column | str) -> Column:
    return F.transform(as_column(c), F.tanh)


def array_sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)


def softmax(c: Column | str) -> Column:
    """Row-normalised exponentials, shifted by the largest value so nothing overflows.

    One pass per step: the exponentials are held in a one-element array so their sum is not
    recomputed for every output.
    """
    z = as_column(c)
    shifted = F.transform(F.array(F.struct(z.alias("z"), F.array_max(z).alias("top"))),
                          lambda s: F.transform(s["z"], lambda v: F.exp(v - s["top"])))
    normed = F.transform(
        F.transform(shifted, lambda e: F.struct(e.alias("e"), array_sum(e).alias("total"))),
        lambda s: F.transform(s["e"], lambda v: v / s["total"]),
    )
    return normed[0]


def argmax(c: Column | str) -> Column:
    """Index of the largest value; the first one on ties."""
    c = as_column(c)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def one_hot(label: Column | str, n: int) -> Column:
    label = as_column(label)
    return F.array(*[F.coalesce((label == i).cast("int"), F.lit(0)) for i in range(n)])


def log_loss(label: Column | str, p: Column | str) -> Column:
    """-log of the probability given to the true class; average it for cross-entropy."""
    return -F.log(F.try_element_at(as_column(p), as_column(label).cast("int") + 1) + F.lit(EPS))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
    )


def layers(c: Column | str, stack: Sequence[tuple]) -> Column:
    """Chain ``(weights, bias, activation)`` layers."""
    out = as_column(c)
    for weights, bias, activation in stack:
        # Held in a one-element array so each layer's input is computed once, not once per output.
        out = F.transform(F.array(out), _layer(weights, bias, activation))[0]
    return out


def _layer(weights, bias, activation):
    return lambda x: activation(dense_layer(x, weights, bias))
