"""Profit per month and year, archived months first and live months for the rest."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.books import Books
from tallybook.functions.coerce import MONEY, as_total, half_up, on_days, or_zero, total
from tallybook.plans.sales import active

MEASURES = (
    "total_sales",
    "total_purchase",
    "base_profit",
    "supplier_adjustment",
    "customer_adjustment",
    "total_expense",
)


def net_profit() -> Column:
    return F.col("base_profit") + F.col("supplier_adjustment") - F.col("customer_adjustment") - F.col("total_expense")


def live_months(books: Books, first: dt.date, last: dt.date, sales_day: str = "created_at") -> DataFrame:
    """Measures per (year, month) touched by the days [first, last]; whole months only.

    All sources are stacked and summed in one pass; the day bounds reach each scan.
    """
    first, last = first.replace(day=1), _month_end(last)

    def part(rows: DataFrame, day: str, **measures: str) -> DataFrame:
        values = [
            (F.col(measures[m]) if m in measures else F.lit(None)).cast(MONEY).alias(m) for m in MEASURES
        ]
        bounds = (
            on_days(day, first, last) if day == "created_at" else F.col(day).between(F.lit(first), F.lit(last))
        )
        return rows.where(bounds).select(
            F.year(day).alias("report_year"), F.month(day).alias("report_month"), *values
        )

    adjusted = F.lower("type") == "adjustment"
    stacked = reduce(
        DataFrame.unionByName,
        (
            part(active(books.sales), sales_day, total_sales="total_pkr"),
            part(active(books.purchases), "created_at", total_purchase="purchase_pkr", base_profit="profit"),
            part(books.supplier_payments.where(adjusted), "payment_date", supplier_adjustment="amount"),
            part(books.customer_payments.where(adjusted), "payment_date", customer_adjustment="amount"),
            part(books.expenses, "expense_date", total_expense="amount"),
        ),
    )
    return stacked.groupBy("report_year", "report_month").agg(*[total(m).alias(m) for m in MEASURES])


def _month_end(day: dt.date) -> dt.date:
    nxt = (day.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    return nxt - dt.timedelta(days=1)


def month_spine(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """One row per calendar month touched by [first, last]."""
    months = F.sequence(F.lit(first.replace(day=1)), F.lit(last), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("month_start")).select(
        F.year("month_start").alias("report_year"), F.month("month_start").alias("report_month"), "month_start"
    )


def archived_months(books: Books, year: int) -> DataFrame:
    """The archived row of each month; the latest close wins where several cover a month."""
    values = [or_zero(c).alias(c) for c in (*MEASURES, "net_profit")]
    return (
        books.profit_months.where(F.col("report_year") == year)
        .groupBy("report_year", "report_month")
        .agg(F.max_by(F.struct(*values), F.col("snapshot_id")).alias("kept"))
        .select("report_year", "report_month", "kept.*")
    )


def combined_months(books: Books, year: int, first: int = 1, last: int = 12) -> DataFrame:
    """Unrounded measures of the months, each archived or live."""
    start, end = dt.date(year, first, 1), _month_end(dt.date(year, last, 1))
    live = live_months(books, start, end)
    live = live.select("report_year", "report_month", *[F.col(m).alias(f"_live_{m}") for m in MEASURES])
    archived = archived_months(books, year).withColumn("_archived", F.lit(True))
    month = ["report_year", "report_month"]
    joined = month_spine(books.profit_months.sparkSession, start, end).join(archived, month, "left").join(live, month, "left")
    from_archive = F.col("_archived").isNotNull()
    rows = joined.select(
        *month,
        F.date_format("month_start", "MMMM").alias("month_name"),
        *[
            as_total(F.when(from_archive, F.col(m)).otherwise(or_zero(f"_live_{m}"))).alias(m)
            for m in MEASURES
        ],
        F.col("net_profit").alias("_archived_net"),
        F.when(from_archive, "archive").otherwise("live").alias("source"),
    )
    return rows.withColumn(
        "net_profit", as_total(F.when(F.col("source") == "archive", F.col("_archived_net")).otherwise(net_profit()))
    ).drop("_archived_net")


def _rounded() -> list[Column]:
    return [half_up(c).alias(c) for c in (*MEASURES, "net_profit")]


def monthly_profit(books: Books, year: int) -> DataFrame:
    """Twelve rows."""
    return (
        combined_months(books, year)
        .select(F.col("report_month").alias("month"), "month_name", *_rounded(), "source")
        .orderBy("month")
    )


def profit_month(books: Books, year: int, month: int) -> DataFrame:
    return combined_months(books, year, month, month).select("source", *_rounded())


def profit_year(books: Books, year: int) -> DataFrame:
    """Sums of the year; the net is recomputed from the summed measures."""
    archived = F.count_if(F.col("source") == "archive")
    return (
        combined_months(books, year)
        .agg(
            F.when(archived == 12, "archive").when(archived > 0, "combined").otherwise("live").alias("source"),
            *[total(m).alias(m) for m in MEASURES],
        )
        .withColumn("net_profit", net_profit())
        .select("source", *_rounded())
    )
