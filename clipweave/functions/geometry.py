"""Integer geometry: floor division, truncation and vertical frame sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc_int(col: Column) -> Column:
    """Double to int, toward zero; null where the value does not fit an int."""
    return col.cast("double").try_cast("int")


def floor_div(a: Column, n: int | Column) -> Column:
    """Floor division for ints (``div`` would truncate toward zero)."""
    return F.floor(a / (F.lit(n) if isinstance(n, int) else n)).cast("int")


def even_down(col: Column) -> Column:
    return (col - F.pmod(col, F.lit(2))).cast("int")


def clamp(col: Column, low: Column | int, high: Column | int) -> Column:
    """``max(low, min(col, high))``: the low bound wins if the bounds cross."""
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    return F.greatest(low, F.least(col, high))


def vertical_width(height: Column) -> Column:
    """Width of a 9:16 frame of this height, rounded down to even."""
    return even_down(trunc_int(height * F.lit(9) / F.lit(16)))


def vertical_height(height: Column) -> Column:
    return even_down(height)
