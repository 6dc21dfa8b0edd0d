"""Number helpers: rounding, safe division, Brazilian money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopgrain.schema import WIDE_MONEY


def rint(col: Column, digits: int) -> Column:
    """Round a double to ``digits`` places, halves to even (pandas rounding)."""
    scale = float(10 ** digits)
    return F.rint(col.cast("double") * scale) / scale


def dbl(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("double")


def money_sum(col: Column | str) -> Column:
    """Exact sum of money, order-independent."""
    return F.sum((F.col(col) if isinstance(col, str) else col).cast(WIDE_MONEY))


def div0(num: Column, den: Column) -> Column:
    """Division where a zero or missing divisor gives 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def plain(col: Column, digits: int = 0) -> Column:
    """Fixed-point text without thousands separator."""
    return F.replace(F.format_number(col.cast("double"), digits), F.lit(","), F.lit(""))


def fmt_brl(col: Column) -> Column:
    """``R$ 1.234,56``."""
    text = F.format_number(col.cast("double"), 2)
    return F.concat(F.lit("R$ "), F.translate(text, ",.", ".,"))
