"""Column expressions for prices, percentages and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelf.functions.text import MISSING, strip

MINOR_UNIT_LIMIT = 50_000.0


def number_or_null(c: Column) -> Column:
    """Non-negative finite number from text such as ``₹ 1,234.50`` or ``Rs. 500/-``."""
    text = c.cast("string")
    bare = F.regexp_replace(text, r"₹|Rs\.|Rs|,", "")
    bare = strip(F.regexp_replace(strip(bare), r"[/-]+$", ""))
    value = bare.try_cast("double")
    valid = (~F.lower(strip(text)).isin(MISSING)) & (value >= 0) & (value < F.lit(float("inf")))
    return F.when(valid, value)


def repair_minor_unit(price: Column, limit: float = MINOR_UNIT_LIMIT) -> Column:
    """Prices above the limit are in hundredths of the currency unit."""
    return F.when(price > limit, price / 100).otherwise(price)


def fraction_or_null(c: Column) -> Column:
    """``"10.64%"`` → 0.1064; a plain number is already a fraction."""
    text = strip(c.cast("string"))
    value = F.regexp_replace(text, r"[,%₹]", "").try_cast("double")
    return F.when(text.endswith("%"), value / 100).otherwise(value)


def nonzero(c: Column) -> Column:
    """Zero counts as missing."""
    return F.when(c != 0, c)


def round_to(c: Column, places: int) -> Column:
    """Half-up rounding over DECIMAL, returned as double.

    Rounding the decimal image of a double is stable across engines, which rounding
    the binary value is not.
    """
    return F.round(c.cast("decimal(28,8)"), places).cast("double")


def diff_pct(own: Column, ref: Column) -> Column:
    """|own − ref| / ref · 100, null when either price is missing or zero."""
    return F.when((own != 0) & (ref != 0), F.abs(own - ref) / ref * 100)


def share_pct(part: Column, whole: Column, places: int = 1) -> Column:
    """part · 100 / whole over DECIMAL, 0 for an empty whole."""
    ratio = part.cast("decimal(20,0)") * 100 / whole.cast("decimal(20,0)")
    return F.when(whole > 0, F.round(ratio.cast("decimal(28,8)"), places).cast("double")).otherwise(0.0)


def mean_of(c: Column, scale: int = 6) -> Column:
    """Average over DECIMAL, so that the result does not depend on the order of rows."""
    return (F.sum(c.cast(f"decimal(28,{scale})")).cast("double")
            / F.count(c).cast("double"))


def total_of(c: Column, scale: int = 4) -> Column:
    """Sum over DECIMAL, as double."""
    return F.sum(c.cast(f"decimal(28,{scale})")).cast("double")
