"""Rounding and clamping as column expressions that give the same doubles in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, places: int) -> Column:
    """Half away from zero on the scaled double: sign(x) * floor(|x| * 10^n + 0.5) / 10^n."""
    scale = float(10**places)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def clamp01(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def half_up(value: Column) -> Column:
    """Halves towards plus infinity."""
    return F.floor(value + 0.5)
