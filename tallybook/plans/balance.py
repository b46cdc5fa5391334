"""Balance sheet: three sections and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.books import Books
from tallybook.functions.coerce import MONEY, as_total, is_named, or_text, or_zero, total, total_if
from tallybook.functions.modules import CUSTOMER_PREFIX
from tallybook.functions.status import account_status, supplier_status
from tallybook.operators.names import names_by_code
from tallybook.operators.snapshots import field, later_than, latest_by_id
from tallybook.plans.outstanding import supplier_positions
from tallybook.plans.sales import active, open_walkins


def _largest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.abs("balance").desc(), rows.columns[0])


def _walkin(books: Books) -> DataFrame:
    last = latest_by_id(books.snapshots)
    received = (
        active(books.customer_payments)
        .where(later_than(last, "payment_date") & (F.col("type") != "opening_balance"))
        .groupBy("ref_no")
        .agg(total("amount").alias("received"))
    )
    carried = books.balances.where(
        (F.col("balance_type") == "CUSTOMER") & (F.col("snapshot_id") == field(last, "id", -1))
    ).select(F.col("code").alias("ref_no"), F.col("balance").alias("carried"))
    # the carried balance comes on top of the full sale, not of what was left of it
    return (
        open_walkins(books.sales)
        .join(received, "ref_no", "left")
        .join(carried, "ref_no", "left")
        .select(
            "ref_no",
            or_text("customer_name", "Walk-In Customer").alias("customer_name"),
            as_total(or_zero("total_pkr")).alias("sale_total"),
            as_total(or_zero("received")).alias("received"),
            as_total(or_zero("carried") + or_zero("total_pkr") - or_zero("received")).alias("balance"),
            F.col("payment_status").alias("status"),
        )
    )


def bs_walkin(books: Books) -> DataFrame:
    return _largest_first(_walkin(books))


def _registered(books: Books) -> DataFrame:
    """An account is a code of an active sale, or a payment ref that looks like one."""
    none = F.lit(None).cast(MONEY)
    sales = (
        active(books.sales)
        .where(is_named("customer_code"))
        .select(
            "customer_code", F.col("total_pkr").alias("debit"), none.alias("credit"), F.lit(True).alias("known")
        )
    )
    opening = F.col("type") == "opening_balance"
    payments = active(books.customer_payments).select(
        F.col("ref_no").alias("customer_code"),
        F.when(opening, F.col("amount")).alias("debit"),
        F.when(~opening, F.col("amount")).alias("credit"),
        F.col("ref_no").startswith(CUSTOMER_PREFIX).alias("known"),
    )
    return (
        sales.unionByName(payments)
        .groupBy("customer_code")
        .agg(total("debit").alias("sale_total"), total("credit").alias("received"), F.max("known").alias("known"))
        .where("known and (sale_total > 0 or received > 0)")
        .withColumn("balance", as_total(F.col("sale_total") - F.col("received")))
    )


def bs_registered(books: Books) -> DataFrame:
    names = names_by_code(books.sales, books.customers)
    return _largest_first(
        _registered(books)
        .join(names, "customer_code", "left")
        .select(
            "customer_code",
            F.coalesce("name", F.lit("Registered Client")).alias("customer_name"),
            "sale_total",
            "received",
            "balance",
            account_status(F.col("balance"), F.col("received")).alias("status"),
        )
    )


def bs_suppliers(books: Books) -> DataFrame:
    return _largest_first(
        supplier_positions(books).select(
            "supplier_code",
            "supplier_name",
            F.col("owed").alias("purchase_total"),
            "paid",
            "balance",
            supplier_status(F.col("balance"), F.col("paid")).alias("status"),
        )
    )


def bs_summary(books: Books) -> DataFrame:
    """What is owed to us, what we owe, and the overpayments of both sides."""

    def side(rows: DataFrame, customers: bool) -> DataFrame:
        return rows.select("balance", F.lit(customers).alias("customers"))

    stacked = (
        side(_walkin(books), True)
        .unionByName(side(_registered(books), True))
        .unionByName(side(supplier_positions(books), False))
    )
    ours = F.col("customers")
    owed, over = F.col("balance") > 0, F.col("balance") < 0

    def summed(condition: Column, value: Column, name: str) -> Column:
        return total_if(condition, value).alias(name)

    return stacked.agg(
        summed(ours & owed, F.col("balance"), "total_receivable"),
        summed(~ours & owed, F.col("balance"), "total_payable"),
        summed(ours & over, -F.col("balance"), "total_extra_received"),
        summed(~ours & over, -F.col("balance"), "total_extra_paid"),
    )
