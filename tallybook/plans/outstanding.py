"""Who owes what: payment status per ref and the pending lists.

Two sides that share a key are combined as one UNION of signed columns and one
grouped aggregate (map-side partial sums, a single shuffle, no join skew).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.books import Books
from tallybook.functions.coerce import (
    MONEY,
    as_total,
    half_up,
    is_named,
    on_days,
    or_text,
    or_zero,
    total,
    total_if,
)
from tallybook.functions.status import (
    OPEN_STATUSES,
    account_status,
    outstanding_side,
    sale_payment_status,
    supplier_status,
)
from tallybook.operators.names import greatest_name_by_ref, names_by_code
from tallybook.operators.snapshots import before_day, field, later_than, latest_by_id
from tallybook.plans.sales import active, walk_in


def two_sided(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """(key, left total, right total, has_left, has_right) over both inputs of (key, amount)."""
    none = F.lit(None).cast(MONEY)
    stacked = left.select(
        key, F.col("amount").cast(MONEY).alias("_l"), none.alias("_r"), F.lit(True).alias("_left")
    ).unionByName(
        right.select(key, none.alias("_l"), F.col("amount").cast(MONEY).alias("_r"), F.lit(False).alias("_left"))
    )
    return stacked.groupBy(key).agg(
        total("_l").alias(left_name),
        total("_r").alias(right_name),
        F.max("_left").alias("has_left"),
        F.max(~F.col("_left")).alias("has_right"),
    )


# status of one ref


def walkin_payment_status(books: Books) -> DataFrame:
    """Sale, paid and status of every walk-in ref with an active sale.

    All payments of the ref count: any type, deleted or not.
    """
    return (
        _walkin_sides(books)
        .where("has_left")
        .select("ref_no", "total_sale", "total_paid", _status().alias("payment_status"))
    )


def _walkin_sides(books: Books) -> DataFrame:
    sold = active(books.sales).where(walk_in()).select("ref_no", F.col("total_pkr").alias("amount"))
    paid = books.customer_payments.select("ref_no", "amount")
    return two_sided(sold, paid, "ref_no", "total_sale", "total_paid")


def _status():
    return sale_payment_status(F.col("total_sale"), F.col("total_paid"))


def status_of_paid_refs(books: Books) -> DataFrame:
    """(ref_no, payment_status) of every ref with a payment."""
    return _walkin_sides(books).where("has_right").select("ref_no", _status().alias("payment_status"))


def status_of_refs(books: Books, refs: DataFrame) -> DataFrame:
    """(ref_no, payment_status) recomputed for the given refs only."""
    keys = refs.select("ref_no").distinct()
    narrowed = books.replace(
        sales=books.sales.join(keys, "ref_no", "left_semi"),
        customer_payments=books.customer_payments.join(keys, "ref_no", "left_semi"),
    )
    sides = _walkin_sides(narrowed)
    return (
        keys.join(sides, "ref_no", "left")
        .withColumns({c: or_zero(c) for c in ("total_sale", "total_paid")})
        .select("ref_no", _status().alias("payment_status"))
    )


# pending lists


def registered_pending(books: Books) -> DataFrame:
    """Accounts with a balance. Every payment ref counts as an account, walk-in refs too."""
    sales = (
        active(books.sales)
        .where(is_named("customer_code"))
        .select("customer_code", F.col("total_pkr").alias("credit"), F.lit(None).cast(MONEY).alias("debit"))
    )
    opening = F.col("type") == "opening_balance"
    payments = books.customer_payments.where(is_named("ref_no")).select(
        F.col("ref_no").alias("customer_code"),
        F.when(opening, F.col("amount")).alias("credit"),
        F.when(~opening, F.col("amount")).alias("debit"),
    )
    accounts = (
        sales.unionByName(payments)
        .groupBy("customer_code")
        .agg(total("credit").alias("sale"), total("debit").alias("paid"))
        .withColumn("balance", as_total(F.col("sale") - F.col("paid")))
        .where("balance <> 0")
    )
    names = names_by_code(books.sales, books.customers)
    return accounts.join(names, "customer_code", "left").select(
        "customer_code",
        F.coalesce("name", F.lit("Registered Customer")).alias("customer_name"),
        F.col("balance").alias("remaining_balance"),
        account_status(F.col("balance"), F.col("paid")).alias("payment_status"),
    )


def supplier_positions(books: Books) -> DataFrame:
    """Owed and paid per active supplier since the latest close (by id), plus its balance."""
    last = latest_by_id(books.snapshots)
    bought = (
        active(books.purchases)
        .where(later_than(last, "created_at"))
        .groupBy("supplier_code")
        .agg(total("purchase_pkr").alias("bought"))
    )
    opening = F.col("type") == "opening_balance"
    payments = (
        books.supplier_payments.where(later_than(last, "payment_date"))
        .groupBy("supplier_id")
        .agg(total_if(opening, "amount").alias("opening"), total_if(~opening, "amount").alias("paid"))
    )
    carried = books.balances.where(
        (F.col("balance_type") == "SUPPLIER") & (F.col("snapshot_id") == field(last, "id", -1))
    ).select(F.col("code").alias("supplier_code"), F.col("balance").alias("carried"))
    return (
        active(books.suppliers)
        .select(F.col("id").alias("supplier_id"), "supplier_code", "supplier_name")
        .join(payments, "supplier_id", "left")
        .join(bought, "supplier_code", "left")
        .join(carried, "supplier_code", "left")
        .select(
            "supplier_code",
            "supplier_name",
            as_total(or_zero("carried") + or_zero("bought") + or_zero("opening")).alias("owed"),
            as_total(or_zero("paid")).alias("paid"),
        )
        .withColumn("balance", as_total(F.col("owed") - F.col("paid")))
    )


def supplier_pending(books: Books) -> DataFrame:
    return (
        supplier_positions(books)
        .where(F.abs("balance") > 0.5)
        .select(
            "supplier_code",
            "supplier_name",
            F.col("owed").alias("total_purchase"),
            F.col("paid").alias("total_paid"),
            F.col("balance").alias("pending_amount"),
            supplier_status(F.col("balance"), F.col("paid"), "0.5").alias("status"),
        )
        .orderBy(F.desc("pending_amount"), "supplier_name", "supplier_code")
    )


def purchase_payables_pending(books: Books) -> DataFrame:
    bought = active(books.purchases).select("ref_no", F.col("purchase_pkr").alias("amount"))
    paid = books.purchase_payments.select("ref_no", "amount")
    sides = two_sided(bought, paid, "ref_no", "bought", "paid").where("has_left")
    part_paid = F.col("paid") > 0
    return (
        sides.select("ref_no", half_up("bought").alias("bought"), half_up("paid").alias("paid"))
        .where("bought > 0 and paid < bought")
        .join(greatest_name_by_ref(books.sales), "ref_no", "left")
        .select(
            "ref_no",
            or_text("name", "").alias("customer_name"),
            F.when(part_paid, "PARTIAL").otherwise("PENDING").alias("status"),
            F.when(part_paid, "Payment partially made").otherwise("Payment not made").alias("note"),
        )
    )


# outstanding at a period close


def customer_outstanding(books: Books, start: dt.date, end: dt.date) -> DataFrame:
    return customer_balances(books, start, end).orderBy(F.desc("balance"), "ref_no")


def customer_balances(books: Books, start: dt.date, end: dt.date) -> DataFrame:
    """Open sales booked in the range, less all payments up to its end."""
    received = (
        books.customer_payments.where(F.col("payment_date") <= F.lit(end))
        .groupBy("ref_no")
        .agg(total("amount").alias("received"))
    )
    booked = active(books.sales).where(
        F.col("booking_date").between(F.lit(start), F.lit(end)) & F.col("payment_status").isin(*OPEN_STATUSES)
    )
    return (
        booked.join(received, "ref_no", "left")
        .select(
            "ref_no",
            "customer_name",
            "payment_status",
            "total_pkr",
            as_total(or_zero("received")).alias("received"),
            as_total(or_zero("total_pkr") - or_zero("received")).alias("balance"),
        )
        .where("balance > 0")
    )


def supplier_outstanding(books: Books, start: dt.date, end: dt.date) -> DataFrame:
    return supplier_balances(books, start, end).orderBy(F.desc("balance"), "supplier_code")


def supplier_balances(books: Books, start: dt.date, end: dt.date) -> DataFrame:
    """Balance of the previous close plus purchases less payments of any type in the range.

    An opening_balance payment counts as paid here, unlike in the supplier ledger.
    """
    previous = field(before_day(books.snapshots, end), "id", 0)
    carried = books.balances.where(
        (F.col("balance_type") == "SUPPLIER") & (F.col("snapshot_id") == previous)
    ).select(F.col("code").alias("supplier_code"), F.col("balance").alias("carried"))
    bought = (
        active(books.purchases)
        .where(on_days("created_at", start, end))
        .groupBy("supplier_code")
        .agg(total("purchase_pkr").alias("bought"))
    )
    paid = (
        books.supplier_payments.where(F.col("payment_date").between(F.lit(start), F.lit(end)))
        .groupBy("supplier_id")
        .agg(total("amount").alias("paid"))
    )
    return (
        active(books.suppliers)
        .select(F.col("id").alias("supplier_id"), "supplier_code", "supplier_name")
        .join(paid, "supplier_id", "left")
        .join(bought, "supplier_code", "left")
        .join(carried, "supplier_code", "left")
        .select(
            "supplier_code",
            "supplier_name",
            as_total(or_zero("carried") + or_zero("bought") - or_zero("paid")).alias("balance"),
        )
        .where("balance <> 0")
        .withColumn("status", outstanding_side(F.col("balance")))
    )
