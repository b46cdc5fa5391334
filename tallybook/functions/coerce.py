"""Money, rounding, null and text rules shared by the reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
TOTAL = "decimal(20,2)"
EPOCH = dt.date(1970, 1, 1)
FIRST_DAY = dt.date(1000, 1, 1)
LAST_DAY = dt.date(9999, 12, 31)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    return col(c).cast(MONEY)


def total(c: str | Column) -> Column:
    """Sum that is 0 for no rows."""
    return F.coalesce(F.sum(col(c)).cast(TOTAL), F.lit(0).cast(TOTAL))


def total_if(condition: Column, c: str | Column) -> Column:
    return total(F.when(condition, col(c)))


def or_zero(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0))


def as_total(c: str | Column) -> Column:
    return col(c).cast(TOTAL)


def number(c: str | Column) -> Column:
    """Text to money; empty or unreadable text is 0."""
    return F.coalesce(col(c).try_cast(MONEY), F.lit(0).cast(MONEY))


def half_up(c: str | Column) -> Column:
    """Round to a whole number, halves toward plus infinity; NULL is 0."""
    return F.coalesce(F.floor(col(c) + F.lit(0.5).cast("decimal(2,1)")), F.lit(0)).cast("bigint")


def half_away(c: str | Column) -> Column:
    """Round to a whole number, halves away from zero; NULL stays NULL."""
    return F.round(col(c), 0).cast("bigint")


def is_blank(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit("")) == ""


def is_named(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit("")) != ""


def or_text(c: str | Column, default: str) -> Column:
    """``default`` for NULL and for the empty text."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def lowered(c: str | Column) -> Column:
    return F.lower(F.coalesce(col(c), F.lit("")))


def join_texts(separator: str, *parts: Column) -> Column:
    """Join the non-empty parts."""
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def padded(n: Column, width: int) -> Column:
    """Left-pad with zeros, never cutting a longer number."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def like_literal(c: str | Column, needle: str) -> Column:
    """Case-insensitive 'contains', with % and _ taken literally."""
    return F.lower(col(c)).contains(needle.lower())


def day_start(day: dt.date) -> dt.datetime:
    return dt.datetime.combine(day, dt.time())


def on_days(stamp: str | Column, first: dt.date, last: dt.date) -> Column:
    """Timestamp falls on a day in [first, last]; half-open, so the bounds reach the scan."""
    lo = F.lit(day_start(first)).cast("timestamp_ntz")
    hi = F.lit(day_start(last + dt.timedelta(days=1))).cast("timestamp_ntz")
    return (col(stamp) >= lo) & (col(stamp) < hi)
