"""Which period close a report starts from."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.coerce import FIRST_DAY


def latest_by_id(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.desc("id")).limit(1)


def latest_by_day(snapshots: DataFrame, needs: str | None = None) -> DataFrame:
    if needs:
        snapshots = snapshots.where(F.col(needs).isNotNull())
    return snapshots.orderBy(F.desc("date_to"), F.desc("id")).limit(1)


def before_day(snapshots: DataFrame, day: dt.date) -> DataFrame:
    """The last close that ended before ``day``."""
    return latest_by_day(snapshots.where(F.col("date_to") < F.lit(day)))


def field(one_row: DataFrame, expression: str | Column, default) -> Column:
    """One value of a one-row frame as a scalar subquery; ``default`` if there is no row.

    The max() makes the subquery return a row even for no input.
    """
    value = F.expr(expression) if isinstance(expression, str) else expression
    return one_row.agg(F.coalesce(F.max(value), F.lit(default)).alias("v")).scalar()


def day_after(one_row: DataFrame, default: dt.date = FIRST_DAY) -> Column:
    """First timestamp after the close: ``stamp >= this`` means 'dated later than date_to'."""
    start = F.coalesce(F.date_add(F.max("date_to"), 1), F.lit(default)).cast("timestamp_ntz")
    return one_row.agg(start.alias("v")).scalar()


def later_than(one_row: DataFrame, column: str) -> Column:
    """Rows dated after the day of the close; every row, dated or not, if there is no close."""
    closed = lambda: one_row.agg(F.max("date_to").alias("v")).scalar()
    start = F.date_add(closed(), 1).cast("timestamp_ntz")
    return closed().isNull() | (F.col(column) >= start)
