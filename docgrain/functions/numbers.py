"""Rounding and ratios that give the same doubles in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int = 3) -> Column:
    """``value`` rounded half up on its double, by floor: null stays null."""
    scale = float(10**digits)
    return F.floor(value.cast("double") * scale + 0.5).cast("double") / scale


def ratio(part: Column, whole: Column, digits: int | None = 3) -> Column:
    """part / whole as a double, 0 where the whole is 0 or null."""
    plain = F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))
    return plain if digits is None else round_half_up(plain, digits)


def harmonic(p: Column, r: Column, digits: int | None = 3) -> Column:
    """2pr / (p + r), 0 where both are 0."""
    plain = F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(F.lit(0.0))
    return plain if digits is None else round_half_up(plain, digits)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def r3(expression: str, digits: int = 3) -> str:
    """The SQL text of ``round_half_up``."""
    scale = f"{10**digits}e0"
    return f"(CAST(floor(({expression}) * {scale} + 0.5e0) AS DOUBLE) / {scale})"
