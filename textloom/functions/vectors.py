"""Scalar functions on numeric arrays; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l1_norm(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: F.abs(x.cast("double"))))


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def vector_sum(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    return dot(a, b) / F.nullif(l2_norm(a) * l2_norm(b), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def analogy(a: Column, b: Column, c: Column) -> Column:
    """c + b - a."""
    return plus(c, minus(b, a))


def normalise(v: Column) -> Column:
    """Of length 1; zero vectors stay."""
    n = l2_norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mirrored_sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(x))


def pair_features(a: Column, b: Column) -> Column:
    """Sums, then absolute differences, of two latent vectors."""
    return F.concat(plus(a, b), F.transform(minus(a, b), F.abs))


def pair_features_last(a: Column, b: Column) -> Column:
    """Sums, then the absolute difference of the last component alone."""
    return F.concat(plus(a, b), F.array(F.abs(F.element_at(minus(a, b), -1))))
