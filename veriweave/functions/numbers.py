"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Below the last digit any operator reports, above the noise of a double sum:
# it makes a value that sits exactly on a half round up on every engine.
_HALF_GUARD = 1e-7


def round_half_up(c: Column, digits: int) -> Column:
    """Round a double to ``digits`` places, halves upward."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5 + _HALF_GUARD)) / F.lit(scale)


def clamp01(c: Column) -> Column:
    """Limit a value to the range 0..1; NULL stays NULL, which ``least`` alone would skip."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
