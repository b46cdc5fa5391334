"""The unified sales relation and the lists read from it.

Lists end their sort with a key, so that one very common date or amount does
not put all of its rows into one range of the sort.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.books import Books
from tallybook.functions.coerce import is_blank
from tallybook.functions.modules import MODULES, module_prefix, module_value
from tallybook.functions.status import OPEN_STATUSES

COLUMNS = (
    "id",
    "prefix",
    "ref_no",
    "customer_code",
    "customer_name",
    "booking_date",
    "created_at",
    "total_pkr",
    "payment_status",
    "purchase_status",
    "is_deleted",
)


def unify_sales(modules: Mapping[str, DataFrame]) -> DataFrame:
    """UNION ALL of the module tables; a filter on ``prefix`` prunes branches."""
    branches = [
        modules[m.table].withColumn("prefix", F.lit(m.prefix)).select(*COLUMNS) for m in MODULES if m.table in modules
    ]
    return reduce(DataFrame.unionByName, branches)


def active(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("is_deleted"))


def walk_in() -> Column:
    return is_blank("customer_code")


def open_walkins(sales: DataFrame) -> DataFrame:
    return active(sales).where(walk_in() & F.col("payment_status").isin(*OPEN_STATUSES))


def sales_unified(books: Books) -> DataFrame:
    s = books.sales
    return s.select(module_value(F.col("prefix"), "table").alias("type"), *[c for c in COLUMNS if c != "prefix"])


def bookings_active(books: Books, prefix: str = MODULES[0].prefix) -> DataFrame:
    """Active rows of one module, newest first."""
    return (
        active(books.sales)
        .where(F.col("prefix") == prefix)
        .select("id", "ref_no", "customer_name", "booking_date", "total_pkr")
        .orderBy(F.desc("id"))
    )


def sales_lookup(books: Books, keys: DataFrame, deleted: bool = False) -> DataFrame:
    """The sales rows whose ref_no is in ``keys``, active or deleted ones."""
    rows = books.sales.where(F.col("is_deleted") == deleted)
    return rows.join(keys.select("ref_no"), "ref_no", "left_semi").select(
        "ref_no", "customer_code", "customer_name", "booking_date", "total_pkr"
    )


def walkin_pending(books: Books) -> DataFrame:
    return (
        open_walkins(books.sales).select("ref_no", "customer_name", "payment_status").orderBy(F.desc("ref_no"))
    )


def sales_all(books: Books) -> DataFrame:
    return _report(active(books.sales)).orderBy(F.desc_nulls_first("booking_date"), "id", "type")


def sales_recent(books: Books, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Sales created in the last ``days`` days before ``as_of``."""
    start = F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")
    recent = active(books.sales).where(F.col("created_at") >= start)
    return _report(recent, "created_at").orderBy(F.desc_nulls_first("created_at"), "id", "type")


def _report(rows: DataFrame, *more: str) -> DataFrame:
    label = module_value(F.col("prefix"), "report").alias("type")
    return rows.select(label, "id", "ref_no", "customer_name", "booking_date", "total_pkr", *more)


def purchase_status_pending(books: Books) -> DataFrame:
    return (
        active(books.sales)
        .where(F.col("purchase_status").isin(*OPEN_STATUSES))
        .select("ref_no", "customer_name", "booking_date", "purchase_status")
        .orderBy(F.desc_nulls_first("booking_date"), "ref_no")
    )


def live_data_start(books: Books, prefix: str = MODULES[0].prefix) -> DataFrame:
    return books.sales.where(F.col("prefix") == prefix).agg(F.min("created_at").alias("first_date"))


def of_module(ref_no: Column) -> Column:
    """The ref belongs to one of the sales modules."""
    return module_value(module_prefix(ref_no), "table").isNotNull()
