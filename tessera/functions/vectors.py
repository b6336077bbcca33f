"""Vector expressions over array columns, in double precision.

A null vector and a zero norm score 0; of unequal lengths the shorter counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(doubles(a), 1, n), F.slice(doubles(b), 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    length = norm(x) * norm(y)
    return F.when(a.isNull() | b.isNull(), 0.0).when(length == 0, 0.0).otherwise(dot(a, b) / length)


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits as SQL's round has it: what x * 10^digits is in binary is rounded, halves away from zero, and the sign stays, of zeros too.

    Spark's own round goes by the shortest decimal that reads as x, so that 0.06495 becomes 0.065 instead of 0.0649, and has no negative zero.
    """
    y = x * F.lit(10.0**digits)
    return F.signum(y) * F.round(F.abs(y)) / F.lit(10.0**digits)


def scaled(cosine: Column) -> Column:
    """A cosine as a score between 0 and 1."""
    return (F.lit(1.0) + cosine) / 2


def l2_normalize(v: Column) -> Column:
    """v over its norm, as floats; zero vectors stay."""
    n = norm(v)
    return F.when(n == 0, v.cast("array<float>")).otherwise(F.transform(doubles(v), lambda x: (x / n).cast("float")))


def is_valid(v: Column) -> Column:
    """Not null, not empty, every component a finite number."""
    inf = float("inf")
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (x != inf) & (x != -inf)), F.lit(False))


def analogy(a: Column, b: Column, c: Column) -> Column:
    """a - b + c."""
    return F.zip_with(F.zip_with(doubles(a), doubles(b), lambda x, y: x - y), doubles(c), lambda x, y: x + y)
