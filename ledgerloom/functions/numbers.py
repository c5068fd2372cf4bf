"""Numbers: exact money, guarded ratios, tolerant comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(x: Column, scale: int = 2) -> Column:
    return x.cast(f"decimal(18,{scale})")


def ratio(over: Column, under: Column, places: int) -> Column:
    """Rounded half up on decimals; null where under is not positive."""
    return F.when(under > 0, F.round(over.cast("decimal(24,4)") / under.cast("decimal(14,2)"), places))


def percent(n: Column, base: Column, places: int = 2) -> Column:
    """Share in percent, 0 where the base is 0."""
    return F.coalesce(ratio(100 * n, base, places), F.lit(0))


def comma_number(x: Column) -> Column:
    """Decimal comma; null where the text is no number."""
    return F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("decimal(18,4)")


def within(x: Column, low: float, high: float) -> Column:
    return F.when(x.between(low, high), x)


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Equal within the tolerance, or both null."""
    return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())
