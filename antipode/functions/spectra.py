"""Measures of the difference between two eigenvalue lists (cos side, sin side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Denominators below EMPTY count as zero, differences below FLAT as none.
EMPTY = 1e-12
FLAT = 1e-6


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _common(ec: Column, es: Column) -> tuple[Column, Column, Column]:
    n = F.least(F.size(ec), F.size(es))
    return F.slice(ec, 1, F.greatest(n, F.lit(0))), F.slice(es, 1, F.greatest(n, F.lit(0))), n


def _weighted(ec: Column, es: Column) -> Column:
    return _sum(F.zip_with(ec, es, lambda x, y: (x - y) * (F.abs(x) + F.abs(y))))


def _magnitude(ec: Column, es: Column) -> Column:
    return _sum(F.zip_with(ec, es, lambda x, y: F.abs(x) + F.abs(y)))


def _gap(ec: Column, es: Column) -> Column:
    return _sum(F.zip_with(ec, es, lambda x, y: F.abs(x - y)))


def spectral_asymmetry(ec: Column, es: Column) -> tuple[Column, Column]:
    """(share of the total magnitude that differs, sign of the weighted difference)."""
    ec, es, n = _common(ec, es)
    empty = (n <= 0) | (_magnitude(ec, es) < EMPTY)
    score = F.when(empty, F.lit(0.0)).otherwise(_gap(ec, es) / _magnitude(ec, es))
    return score, F.when(empty, F.lit(0.0)).otherwise(F.signum(_weighted(ec, es)))


def activity_index(ec: Column, es: Column) -> tuple[Column, Column]:
    """(RMS difference over mean magnitude, ``positive`` / ``negative`` / ``inactive``)."""
    ec, es, n = _common(ec, es)
    rms = F.sqrt(_sum(F.zip_with(ec, es, lambda x, y: (x - y) * (x - y))) / n)
    raw = F.when((n <= 0) | (_magnitude(ec, es) / n < EMPTY), F.lit(0.0)).otherwise(rms / (_magnitude(ec, es) / n))
    value = F.when(raw < FLAT, F.lit(0.0)).otherwise(raw)
    sign = F.when(value == 0, "inactive").when(_weighted(ec, es) > 0, "positive").otherwise("negative")
    return value, sign


def saturation_score(ec: Column, es: Column) -> Column:
    """Logistic of the differing share: steepness 10, centre 0.1; 0 for empty spectra."""
    ec, es, n = _common(ec, es)
    empty = (n <= 0) | (_magnitude(ec, es) < EMPTY)
    return F.when(empty, F.lit(0.0)).otherwise(
        1 / (1 + F.exp(-10.0 * (_gap(ec, es) / _magnitude(ec, es) - 0.1)))
    )


def edge_shift(ec: Column, es: Column) -> Column:
    """Mean absolute difference with weights e^-i, so that the lowest values dominate."""
    ec, es, n = _common(ec, es)
    weights = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.exp(-i.cast("double")))
    gaps = F.zip_with(ec, es, lambda x, y: F.abs(x - y))
    return F.when(n <= 0, F.lit(0.0)).otherwise(
        _sum(F.zip_with(gaps, weights, lambda g, w: g * w)) / _sum(weights)
    )


def rotation_class(sign: Column, score: Column) -> Column:
    return (
        F.when((score < FLAT) | (sign == 0), "inactive")
        .when(sign > 0, "dextrorotatory (+)").otherwise("levorotatory (-)")
    )


def mode_contributions(ec: Column, es: Column) -> Column:
    """Array of (index, ec, es, delta) where the two values differ."""
    ec, es, n = _common(ec, es)
    rows = F.transform(
        F.arrays_zip(ec.alias("ec"), es.alias("es")),
        lambda z, i: F.struct(i.alias("index"), z["ec"].alias("ec"), z["es"].alias("es"),
                              (z["ec"] - z["es"]).alias("delta")),
    )
    return F.filter(rows, lambda r: F.abs(r["delta"]) > FLAT)


def material_class(n: Column, labels: Column) -> Column:
    """``crystalline`` from 20 nodes, ``metamaterial`` for at most 3 distinct labels, else ``molecular``."""
    return (
        F.when(n >= 20, "crystalline")
        .when((F.size(labels) > 0) & (F.size(F.array_distinct(labels)) <= 3), "metamaterial")
        .otherwise("molecular")
    )
