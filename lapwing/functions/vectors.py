"""Column expressions on numeric arrays. Vectors are ARRAY<DOUBLE> while computing."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F


def doubles(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def scaled(v: Column, factor) -> Column:
    return F.transform(v, lambda x: x * factor)


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`: a lambda body is otherwise re-evaluated per element."""
    return F.transform(F.array(value), body)[0]


def unit(v: Column) -> Column:
    """L2 normalise; an all-zero vector stays zero."""
    divide = lambda a, n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)
    return let(v, lambda a: let(norm(a), lambda n: divide(a, n)))


def cosine(a: Column, b: Column) -> Column:
    return let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def mean_vector(v: Column, weight: Column | None = None) -> Column:
    """Aggregate: (weighted) mean vector of a group, merged map-side in the JVM."""
    vec = array_to_vector(v)
    return vector_to_array(Summarizer.mean(vec, weight) if weight is not None else Summarizer.mean(vec))


def sum_vector(v: Column) -> Column:
    """Aggregate: sum vector of a group, merged map-side in the JVM."""
    return vector_to_array(Summarizer.sum(array_to_vector(v)))


def ramp(v: Column) -> Column:
    """Position-sensitive checksum: sum of (i+1)*v[i]."""
    return total(F.transform(v, lambda x, i: x * (i + F.lit(1.0))))
