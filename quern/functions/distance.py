"""Distances between vector columns, in double precision; smaller is closer for each."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def dot(a: Column, b: Column) -> Column:
    return -_dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    """1 where either vector is zero."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, 1.0).otherwise(1 - _dot(a, b) / norms)


METRICS = {"l2": l2, "cosine": cosine, "dot": dot}
