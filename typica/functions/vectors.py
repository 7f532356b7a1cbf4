"""Vector arithmetic on array<double> columns, JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once; a plain column would be computed again wherever a lambda uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    """Null if a vector is zero."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def eucos(a: Column, b: Column, weight: float = 0.5) -> Column:
    """weight times the euclidean distance, plus the cosine distance."""
    return weight * euclid(a, b) + cosine_distance(a, b)


def normalised(v: Column, eps: float = 1e-10) -> Column:
    return let(norm(v) + eps, lambda n: F.transform(v, lambda x: x / n))


def feature(v: Column, kind: str) -> Column:
    """A feature type: norm is the length alone, normalized the unit vector; raw, embedding, penultimate and others the vector."""
    if kind == "norm":
        return F.array(norm(v))
    return let(norm(v), lambda n: F.transform(v, lambda x: x / F.greatest(n, F.lit(1e-12)))) if kind == "normalized" else v


def clipped(v: Column, most: float | Column) -> Column:
    return F.transform(v, lambda x: F.least(x, F.lit(most) if isinstance(most, float) else most))


def log_sum_exp(v: Column, temperature: float = 1.0) -> Column:
    """ln sum exp(x / T), shifted by the maximum."""
    top = F.array_max(v) / temperature
    return let(top, lambda m: m + F.ln(total(F.transform(v, lambda x: F.exp(x / temperature - m)))))


def energy(v: Column, temperature: float = 1.0) -> Column:
    return -temperature * log_sum_exp(v, temperature)


def log_2cosh(x: Column) -> Column:
    """logsumexp(-x, x)."""
    return F.abs(x) + F.log1p(F.exp(-2 * F.abs(x)))


def largest_places(v: Column, k: int) -> Column:
    """Places (from 0) of the k largest entries, ties to the lower place."""
    pairs = F.array_sort(F.transform(v, lambda x, i: F.struct((-x).alias("a"), i.alias("i"))))
    return F.transform(F.slice(pairs, 1, k), lambda p: p["i"])
