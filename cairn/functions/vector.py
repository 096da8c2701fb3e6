"""Vector arithmetic over arrays, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """NULL where the lengths differ or either is NULL."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, v: s + v))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(F.struct(F.transform(a, lambda x: x.cast("double")).alias("a"), norm(a).alias("n")), lambda s: F.when(s["n"] > 0, F.transform(s["a"], lambda x: x / s["n"])).otherwise(s["a"]))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Average of the token vectors whose mask is positive, at unit length; NULL if none is."""
    start = F.struct(F.lit(None).cast("array<double>").alias("sum"), F.lit(0).alias("n"))
    add = lambda acc, t: F.struct(F.when(acc["sum"].isNull(), F.transform(t, lambda x: x.cast("double"))).otherwise(F.zip_with(acc["sum"], t, lambda x, y: x + y.cast("double"))).alias("sum"), (acc["n"] + 1).alias("n"))
    kept = F.filter(F.zip_with(tokens, mask, lambda t, m: F.when(m > 0, t)), lambda t: t.isNotNull())
    mean = F.aggregate(kept, start, add, lambda acc: F.transform(acc["sum"], lambda x: x / acc["n"]))
    return let(mean, normalize)
