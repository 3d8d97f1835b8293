"""Normalisers: forward and inverse, with the guard against a vanishing spread."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 1e-6


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / F.greatest(std, F.lit(LEAST))


def un_zscore(z: Column, mean: Column, std: Column) -> Column:
    """Multiplies by the deviation as it is, without the guard."""
    return z * std + mean


def minmax(x: Column, low: Column, high: Column) -> Column:
    return 2 * (x - low) / F.greatest(high - low, F.lit(LEAST)) - 1


def un_minmax(y: Column, low: Column, high: Column) -> Column:
    """Multiplies by the range as it is, without the guard."""
    return (y + 1) / 2 * (high - low) + low


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """NaN stays NaN; Spark would order it above everything."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def quantile(x: Column, q01: Column, q99: Column) -> Column:
    return clamp(minmax(x, q01, q99))


def un_quantile(y: Column, q01: Column, q99: Column) -> Column:
    return (clamp(y) + 1) / 2 * F.greatest(q99 - q01, F.lit(LEAST)) + q01
