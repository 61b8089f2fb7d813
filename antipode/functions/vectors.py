"""Vector expressions over ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Norms below these count as zero.
ZERO_NORM = 1e-12
ZERO_NORM_DIVERGENCE = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine01(a: Column, b: Column) -> Column:
    """Cosine mapped to [0, 1]; 0 when either vector is zero."""
    na, nb = norm(a), norm(b)
    return F.when((na < ZERO_NORM) | (nb < ZERO_NORM), F.lit(0.0)).otherwise((dot(a, b) / (na * nb) + 1) / 2)


def divergence(a: Column, b: Column) -> Column:
    """1 - cosine01; null when either vector is zero."""
    return F.when((norm(a) >= ZERO_NORM_DIVERGENCE) & (norm(b) >= ZERO_NORM_DIVERGENCE), 1 - cosine01(a, b))


def combine_vectors(a: Column, b: Column, zero_fill: bool = False) -> Column:
    """[a, b, a*b, |a-b|]; null if a side is null, or zeros for it with ``zero_fill``."""
    if zero_fill:
        a, b = (
            F.coalesce(a, F.transform(b, lambda _: F.lit(0.0))),
            F.coalesce(b, F.transform(a, lambda _: F.lit(0.0))),
        )
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: x * y), F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def one_hot(key: Column, vocabulary: Sequence[str]) -> Column:
    """0/1 array over the sorted vocabulary; all zeros for an unknown key."""
    words = sorted(vocabulary)
    return F.array(*[F.coalesce(key == w, F.lit(False)).cast("double") for w in words])


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def pad(values: Column, length: int) -> Column:
    """First ``length`` values, filled up with zeros."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), length)), 1, length)
