"""Exact rates and strict parsing of numbers and dates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column | str, whole: Column | str, digits: int = 6) -> Column:
    """part / whole of two counts as an exact decimal, rounded half up; null where whole is 0 or null."""
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.round(part.cast("decimal(20,0)") / F.nullif(whole, F.lit(0)).cast("decimal(20,0)"), digits).cast(f"decimal(18,{digits})")


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(12,2)")


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def optional_int(c: Column) -> Column:
    """A non-negative integer; null where blank. Check bad_int() before."""
    return F.when(~blank(c), F.trim(c).try_cast("bigint"))


def bad_int(c: Column, required: bool = False) -> Column:
    """Whether text is no non-negative integer (or is blank although it is required)."""
    value = F.trim(c).try_cast("bigint")
    wrong = ~blank(c) & (value.isNull() | (value < 0))
    return (wrong | blank(c)) if required else wrong


def month_day(c: Column, year: int) -> Column:
    """MMDD of a fixed year as a date; null unless it has four digits and exists."""
    return F.when(F.trim(c).rlike("^[0-9]{4}$"), F.try_to_date(F.concat(F.lit(str(year)), F.trim(c)), "yyyyMMdd"))


def probability(c: Column) -> Column:
    """An exact decimal in [0, 1]; null where blank or wrong (see bad_probability())."""
    value = F.trim(c).try_cast("decimal(8,7)")
    return F.when(~blank(c) & value.between(0, 1), value)


def bad_probability(c: Column) -> Column:
    return ~blank(c) & probability(c).isNull()
