"""Dimension lists, adjustments, deleted records, table counts."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.books import Books
from tallybook.functions.coerce import as_total, half_away, is_named, like_literal, or_zero, total, total_if
from tallybook.functions.modules import CUSTOMER_PREFIX, module_rank, module_value
from tallybook.operators.names import greatest_name_by_ref
from tallybook.plans.sales import active

# dimensions


def suppliers_active(books: Books) -> DataFrame:
    return active(books.suppliers).drop("is_deleted").orderBy("supplier_code")


def banks_list(books: Books) -> DataFrame:
    return books.banks.orderBy("id")


def bank_profiles_active(books: Books) -> DataFrame:
    return (
        books.banks.where(F.lower("status") == "active")
        .select("id", "bank_name", "account_title", "account_number")
        .orderBy("id")
    )


def customers_list(books: Books, search: str | None = None) -> DataFrame:
    rows = active(books.customers)
    if search and search.strip():
        needle = search.strip()
        rows = rows.where(like_literal("name", needle) | like_literal("customer_code", needle))
    return rows.select("id", "customer_code", "name", "contact_no", "email").orderBy("name", "customer_code")


def expense_list(books: Books) -> DataFrame:
    banks = books.banks.select(F.col("id").alias("bank_profile_id"), "bank_name")
    return (
        books.expenses.join(banks, "bank_profile_id", "left")
        .select("id", "expense_date", "title", "amount", "payment_method", "bank_profile_id", "bank_name", "remarks")
        .orderBy(F.desc_nulls_first("expense_date"), F.desc("id"))
    )


# adjustments


def sale_adjustments(books: Books) -> DataFrame:
    """Payments of type ``adjustment`` (as written) against the sale they adjust.

    A registered ref is looked up by customer code, any other by ref_no. One
    pass over the sales yields both the amount (active rows) and the name.
    """
    keyed = (
        books.sales.select(
            "id",
            "customer_name",
            "total_pkr",
            "is_deleted",
            module_rank(F.col("prefix")).alias("_rank"),
            F.explode(
                F.array(
                    F.struct(F.lit("ref").alias("kind"), F.col("ref_no").alias("key")),
                    F.struct(F.lit("code").alias("kind"), F.col("customer_code").alias("key")),
                )
            ).alias("k"),
        )
        .select("id", "customer_name", "total_pkr", "is_deleted", "_rank", "k.kind", "k.key")
        .where(is_named("key"))
    )
    named = F.when(is_named("customer_name"), F.struct("_rank", "id"))
    sold = keyed.groupBy("kind", "key").agg(
        total_if(~F.col("is_deleted"), "total_pkr").alias("sale"),
        F.min_by("customer_name", named).alias("name"),
    )
    adjusted = books.customer_payments.where(F.col("type") == "adjustment").withColumns(
        {
            "kind": F.when(F.col("ref_no").startswith(CUSTOMER_PREFIX), "code").otherwise("ref"),
            "key": F.col("ref_no"),
        }
    )
    return (
        adjusted.join(sold, ["kind", "key"], "left")
        .select(
            "id",
            F.col("payment_date").alias("date"),
            "ref_no",
            "payment_method",
            F.coalesce("name", F.lit("Unknown Customer")).alias("customer_name"),
            half_away(or_zero("sale")).alias("amount"),
            half_away(or_zero("amount")).alias("adjustment_amount"),
            half_away(or_zero("sale") - or_zero("amount")).alias("net_amount"),
        )
        .orderBy(F.desc_nulls_first("date"), F.desc("id"))
    )


def supplier_adjustments(books: Books, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    rows = books.supplier_payments.where(
        (F.lower("payment_method") == "adjustment") | (F.lower("type") == "adjustment")
    )
    if start and end:
        rows = rows.where(F.col("payment_date").between(F.lit(start), F.lit(end)))
    suppliers = books.suppliers.select(F.col("id").alias("supplier_id"), "supplier_code", "supplier_name")
    return (
        rows.select("supplier_id", "payment_date", F.col("amount").alias("adjustment_amount"))
        .join(suppliers, "supplier_id")
        .select("supplier_id", "supplier_code", "supplier_name", "payment_date", "adjustment_amount")
        .orderBy(F.desc_nulls_first("payment_date"), "supplier_code", "adjustment_amount")
    )


# deleted records


def deleted_report(books: Books) -> DataFrame:
    gone = F.col("is_deleted")
    sales = books.sales.where(gone).select(
        module_value(F.col("prefix"), "deleted").alias("type"),
        "ref_no",
        "customer_name",
        "booking_date",
        as_total("total_pkr").alias("amount"),
    )
    purchases = (
        books.purchases.where(gone)
        .groupBy("ref_no")
        .agg(F.min("created_at").alias("first_at"), total("purchase_pkr").alias("amount"))
        .join(greatest_name_by_ref(books.sales), "ref_no", "left")
        .select(
            F.lit("PURCHASE").alias("type"),
            "ref_no",
            F.coalesce("name", F.lit("-")).alias("customer_name"),
            F.to_date("first_at").alias("booking_date"),
            "amount",
        )
    )

    def master(rows: DataFrame, label: str, code: str, name: str) -> DataFrame:
        return rows.where(gone).select(
            F.lit(label).alias("type"),
            F.col(code).alias("ref_no"),
            F.col(name).alias("customer_name"),
            F.lit(None).cast("date").alias("booking_date"),
            as_total(F.lit(None)).alias("amount"),
        )

    parts = (
        sales,
        purchases,
        master(books.suppliers, "SUPPLIER", "supplier_code", "supplier_name"),
        master(books.customers, "CUSTOMER", "customer_code", "name"),
    )
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc_nulls_last("booking_date"), "type", "ref_no")


# table sizes


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count), largest first."""
    counted = [
        frame.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, frame in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted).orderBy(F.desc("row_count"), "table_name")


def capacity(profile: DataFrame, used_mb: float, limit_mb: float = 500) -> DataFrame:
    """How many more rows of average size fit under the limit."""
    rows = F.sum("row_count")
    average = F.when(rows > 0, F.lit(float(used_mb)) / rows)
    return profile.agg(
        rows.alias("total_rows"),
        F.round(average * 1024, 2).alias("avg_row_kb"),
        F.coalesce(F.floor(F.lit(float(limit_mb - used_mb)) / F.nullif(average, F.lit(0.0))), F.lit(0)).alias(
            "possible_more_rows"
        ),
    )


# export manifest


def manifest_expired(manifest: DataFrame, as_of: dt.datetime, days: int = 60) -> DataFrame:
    """Exports older than ``days``; an export without a date never expires."""
    cutoff = F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")
    return manifest.where(F.col("created_at") < cutoff).select("name", "created_at")


def manifest_latest(manifest: DataFrame) -> DataFrame:
    return manifest_list(manifest).limit(1)


def manifest_list(manifest: DataFrame) -> DataFrame:
    return manifest.select("name", "created_at").orderBy(F.desc("name"))
