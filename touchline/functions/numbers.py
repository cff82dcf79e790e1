"""Rounding and interpolation shared by the percentile operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away_2(value: Column) -> Column:
    """Two decimals by scaling, which is not the same as decimal rounding: 1.005 gives 1.0."""
    return F.round(value * 100) / 100


def rank_position(fraction: float, count: Column) -> Column:
    """Zero-based, possibly fractional rank of a quantile among ``count`` sorted values."""
    return F.lit(float(fraction)) * (count - 1).cast("double")


def interpolate(position: Column, lower: Column, upper: Column, count: Column) -> Column:
    """Linear interpolation between neighbours; a single value is returned as it is."""
    part = position - F.floor(position)
    mixed = F.when(part == 0, lower).otherwise(lower + part * (upper - lower))
    return F.when(count == 1, lower).otherwise(round_half_away_2(mixed))
