"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Scaled to length one; a zero vector stays as it is.

    The vector and its length are bound first: a lambda computes what it
    mentions anew for each element.
    """
    bound = F.array(F.struct(v.alias("v"), norm(v).alias("n")))
    divisor = F.transform(bound, lambda s: F.struct(s["v"].alias("v"), F.when(s["n"] == 0, 1.0).otherwise(s["n"]).alias("n")))
    return F.transform(divisor, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
