"""Purchase lists, details and data quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.books import Books
from tallybook.functions.coerce import as_total, is_blank, like_literal, on_days, or_text, or_zero, total
from tallybook.operators.names import greatest_name_by_ref
from tallybook.plans.sales import active

SUMS = ("sale_pkr", "purchase_pkr", "profit")
DETAIL = (
    "ref_no",
    "item",
    "sale_sar",
    "sale_rate",
    "sale_pkr",
    "purchase_sar",
    "purchase_rate",
    "purchase_pkr",
    "profit",
    "supplier_code",
    "supplier_name",
    "created_at",
)


def purchase_list(
    books: Books, start: dt.date | None = None, end: dt.date | None = None, search: str | None = None
) -> DataFrame:
    """One row per ref; sums are taken before the name joins, so they cannot fan out."""
    rows = active(books.purchases)
    if start and end:
        rows = rows.where(on_days("created_at", start, end))
    per_ref = rows.groupBy("ref_no").agg(
        *[total(c).alias(c) for c in SUMS], F.min("created_at").alias("created_at")
    )
    listed = per_ref.join(greatest_name_by_ref(books.sales), "ref_no", "left").withColumnRenamed(
        "name", "customer_name"
    )
    if search:
        listed = listed.where(
            like_literal("ref_no", search) | F.coalesce(like_literal("customer_name", search), F.lit(False))
        )
    return listed.select("ref_no", "customer_name", *SUMS, "created_at").orderBy(F.desc("created_at"), "ref_no")


def purchase_detail(books: Books) -> DataFrame:
    names = greatest_name_by_ref(books.sales).withColumnRenamed("name", "customer_name")
    return (
        active(books.purchases)
        .select(*DETAIL)
        .join(names, "ref_no", "left")
        .select(*DETAIL, "customer_name")
        .orderBy("ref_no", "item")
    )


def purchase_detail_deleted(books: Books) -> DataFrame:
    return books.purchases.where("is_deleted").select(*DETAIL).orderBy("ref_no", "item")


def purchase_totals(books: Books, deleted: bool = False) -> DataFrame:
    rows = books.purchases.where(F.col("is_deleted") == deleted)
    return rows.groupBy("ref_no").agg(*[total(c).alias(c) for c in SUMS])


def purchase_count(books: Books) -> DataFrame:
    return active(books.purchases).groupBy("ref_no").agg(F.count("*").alias("total"))


def missing_supplier(books: Books) -> DataFrame:
    """Costed rows that name no supplier."""
    rows = active(books.purchases).where(
        (F.col("purchase_sar") > 0)
        & (F.col("purchase_rate") > 0)
        & (is_blank("supplier_name") | is_blank("supplier_code"))
    )
    return (
        rows.join(greatest_name_by_ref(active(books.sales)), "ref_no", "left")
        .select(
            "id",
            "ref_no",
            or_text("name", "").alias("customer_name"),
            "supplier_name",
            "supplier_code",
            as_total(or_zero(F.col("purchase_sar") * F.col("purchase_rate"))).alias("row_amount"),
            F.lit("COMPLETE").alias("status"),
            F.lit("Supplier missing in this row").alias("note"),
        )
        .orderBy("ref_no", "id")
    )


def supplier_purchase_detail(books: Books, supplier_name: str | None = None) -> DataFrame:
    """Rows with a purchase amount or rate, profit recomputed; NULL or ``ALL`` means every supplier."""
    suppliers = books.suppliers.select("supplier_code", F.col("supplier_name").alias("name"))
    rows = (
        active(books.purchases)
        .where((F.col("purchase_sar") > 0) | (F.col("purchase_rate") > 0))
        .join(suppliers, "supplier_code", "left")
        .select(
            "id",
            "ref_no",
            "item",
            "sale_sar",
            "sale_rate",
            "sale_pkr",
            "purchase_sar",
            "purchase_rate",
            "purchase_pkr",
            as_total(or_zero("sale_pkr") - or_zero("purchase_pkr")).alias("profit"),
            F.col("created_at").alias("booking_date"),
            F.col("name").alias("supplier_name"),
        )
    )
    if supplier_name and supplier_name != "ALL":
        rows = rows.where(F.col("supplier_name") == supplier_name)
    return rows.orderBy(F.desc_nulls_first("booking_date"), "id")


def supplier_names(books: Books) -> DataFrame:
    """``ALL`` and then the active suppliers by name."""
    names = active(books.suppliers).select(F.lit(1).alias("_group"), "supplier_name")
    every = books.suppliers.sparkSession.range(1).select(F.lit(0).alias("_group"), F.lit("ALL").alias("supplier_name"))
    return every.unionByName(names).orderBy("_group", "supplier_name").select("supplier_name")
