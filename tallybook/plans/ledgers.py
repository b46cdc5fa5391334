"""Ledgers with running balances, each for all of its accounts at once."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.books import Books
from tallybook.functions.coerce import (
    EPOCH,
    FIRST_DAY,
    MONEY,
    as_total,
    col,
    half_away,
    half_up,
    is_named,
    lowered,
    or_text,
    or_zero,
)
from tallybook.functions.modules import CUSTOMER_PREFIX, MODULES, module_rank, module_value
from tallybook.operators.names import names_by_any_key, names_by_code, one_per_key
from tallybook.operators.running import running_total
from tallybook.operators.snapshots import field, later_than, latest_by_day, latest_by_id
from tallybook.plans.sales import active, walk_in

WHOLE = "bigint"


def method_text() -> Column:
    """``Bank: <name>`` for a bank payment with a known bank, else the method."""
    return F.when(
        (F.lower("payment_method") == "bank") & is_named("bank_name"), F.concat(F.lit("Bank: "), F.col("bank_name"))
    ).otherwise(F.coalesce(F.col("payment_method"), F.lit("")))


def bank_names(books: Books) -> DataFrame:
    return one_per_key(books.banks.select(F.col("id").alias("bank_profile_id"), "bank_name"), "bank_profile_id", "bank_name")


def _template(text: str | Column) -> Column:
    """A NULL inside a text template prints as ``null``."""
    return F.coalesce(col(text).cast("string"), F.lit("null"))


# walk-in ledger


def walkin_accounts(sales: DataFrame) -> DataFrame:
    """One row per walk-in ref: name and date of its first sale, rounded total."""
    return (
        active(sales)
        .where(walk_in())
        .groupBy("ref_no")
        .agg(
            F.min_by(F.struct("customer_name", "booking_date"), F.struct(module_rank(F.col("prefix")), "id")).alias("head"),
            half_up(F.sum("total_pkr")).alias("sale"),
        )
        .select("ref_no", "head.*", "sale")
    )


def walkin_ledger(books: Books, **sizes) -> DataFrame:
    accounts = walkin_accounts(books.sales)
    zero = F.lit(0).cast(WHOLE)
    opening = F.greatest(F.col("sale"), zero)

    def line(entry: str, text: Column, credit: Column, order: int) -> Column:
        return F.struct(
            F.lit(order).alias("line_group"),
            F.lit(entry).alias("entry_id"),
            text.alias("description"),
            zero.alias("debit"),
            credit.alias("credit"),
            credit.alias("balance"),
        )

    header = line("CUSTOMER", F.concat(F.lit("Customer: "), _template("customer_name")), zero, 0)
    sale = line("SALE", F.lit("Sale Invoice"), opening, 1)
    heads = (
        accounts.select("ref_no", F.col("booking_date").alias("entry_date"), F.inline(F.array(header, sale)))
        .where("line_group = 0 or credit > 0")
    )
    payments = books.customer_payments.where(F.col("ref_no").isNotNull()).select(
        "id", "ref_no", "payment_date", half_up("amount").alias("debit"), "type", "payment_method", "bank_profile_id"
    )
    paid = running_total(
        payments, F.col("debit"), "_paid", account=["ref_no"], day="payment_date", order_id="id", **sizes
    )
    entries = (
        paid.join(accounts.select("ref_no", "sale"), "ref_no")
        .join(bank_names(books), "bank_profile_id", "left")
        .select(
            "ref_no",
            F.col("payment_date").alias("entry_date"),
            F.lit(2).alias("line_group"),
            F.col("id").cast("string").alias("entry_id"),
            F.when(F.col("type") == "adjustment", "Adjustment")
            .otherwise(F.concat(F.lit("Payment Received ("), method_text(), F.lit(")")))
            .alias("description"),
            "debit",
            zero.alias("credit"),
            (opening - F.col("_paid")).cast(WHOLE).alias("balance"),
        )
    )
    return heads.select(*entries.columns).unionByName(entries)


# registered customers


def registered_entries(books: Books) -> DataFrame:
    """Sales and payments of registered customers, one row each."""
    sales = (
        active(books.sales)
        .where(is_named("customer_code"))
        .select(
            "customer_code",
            F.col("booking_date").alias("entry_date"),
            module_rank(F.col("prefix")).alias("line_group"),
            "id",
            F.concat(F.lit("SALE-"), "ref_no").alias("entry_id"),
            F.concat(
                F.lit("Sale Invoice ("), module_value(F.col("prefix"), "source"), F.lit(") - Ref: "), F.col("ref_no")
            ).alias("description"),
            F.lit(0).cast(WHOLE).alias("debit"),
            half_up("total_pkr").alias("credit"),
            F.lit("sale").alias("entry_type"),
            F.lit(None).cast("bigint").alias("bank_profile_id"),
        )
    )
    opening = F.coalesce(F.col("type") == "opening_balance", F.lit(False))
    amount = half_up("amount")
    payments = (
        books.customer_payments.where(F.col("ref_no").startswith(CUSTOMER_PREFIX))
        .join(bank_names(books), "bank_profile_id", "left")
        .select(
            F.col("ref_no").alias("customer_code"),
            F.col("payment_date").alias("entry_date"),
            F.lit(len(MODULES)).alias("line_group"),
            "id",
            F.col("id").cast("string").alias("entry_id"),
            F.when(opening, "🔑 Opening Balance")
            .otherwise(
                F.concat(
                    F.when(F.col("type") == "adjustment", "Adjustment Receipt (").otherwise("Payment Received ("),
                    method_text(),
                    F.lit(")"),
                )
            )
            .alias("description"),
            F.when(opening, F.lit(0)).otherwise(amount).cast(WHOLE).alias("debit"),
            F.when(opening, amount).otherwise(F.lit(0)).cast(WHOLE).alias("credit"),
            F.when(opening, "opening_balance").otherwise("payment").alias("entry_type"),
            "bank_profile_id",
        )
    )
    return sales.unionByName(payments)


def registered_ledger(
    books: Books, start: dt.date | None = None, end: dt.date | None = None, **sizes
) -> DataFrame:
    """Date filters apply after the balance, so a statement carries it over."""
    rows = running_total(
        registered_entries(books),
        F.col("credit") - F.col("debit"),
        "balance",
        account=["customer_code"],
        day="entry_date",
        before_id=["line_group"],
        order_id="id",
        no_day=EPOCH,
        **sizes,
    )
    if start:
        rows = rows.where(F.coalesce("entry_date", F.lit(EPOCH)) >= F.lit(start))
    if end:
        rows = rows.where(F.coalesce("entry_date", F.lit(EPOCH)) <= F.lit(end))
    names = names_by_code(books.sales)
    return rows.join(names, "customer_code", "left").select(
        "customer_code",
        F.coalesce("name", F.lit("Registered Customer")).alias("customer_name"),
        "entry_date",
        "entry_id",
        "description",
        "debit",
        "credit",
        "entry_type",
        "bank_profile_id",
        F.col("balance").cast(WHOLE).alias("balance"),
    )


def registered_closing(books: Books) -> DataFrame:
    """Balance of each registered customer after all entries."""
    return (
        registered_entries(books)
        .groupBy("customer_code")
        .agg(F.sum(F.col("credit") - F.col("debit")).cast(WHOLE).alias("total_remaining_balance"))
    )


# suppliers


def supplier_ledger(books: Books, **sizes) -> DataFrame:
    last = latest_by_id(books.snapshots)
    codes = one_per_key(books.suppliers.select("id", "supplier_code"), "id", "supplier_code")
    nothing = F.lit(0).cast(MONEY)

    def shaped(rows: DataFrame, rank: int, **more: Column) -> DataFrame:
        return rows.select(
            "supplier_code",
            F.lit(rank).alias("line_group"),
            *[
                more.get(c, F.lit(None).cast(t)).cast(t).alias(c)
                for c, t in (
                    ("id", "bigint"),
                    ("entry_date", "date"),
                    ("type", "string"),
                    ("payment_method", "string"),
                    ("bank_profile_id", "bigint"),
                    ("item", "string"),
                    ("ref_no", "string"),
                    ("debit", MONEY),
                    ("credit", MONEY),
                )
            ],
        )

    carried = books.balances.where(
        (F.col("snapshot_id") == field(last, "id", -1)) & (F.col("balance_type") == "SUPPLIER") & (F.col("balance") != 0)
    ).withColumnRenamed("code", "supplier_code")
    opening = shaped(
        carried.join(codes.select("supplier_code"), "supplier_code", "left_semi"),
        0,
        id=F.lit(0),
        entry_date=field(last, "date_to", FIRST_DAY),
        type=F.lit("Snapshot Opening"),
        debit=F.greatest("balance", nothing),
        credit=F.greatest(-F.col("balance"), nothing),
    )
    bought = shaped(
        active(books.purchases)
        .where(later_than(last, "created_at"))
        .join(codes.select("supplier_code"), "supplier_code", "left_semi"),
        1,
        id=F.col("id"),
        entry_date=F.to_date("created_at"),
        type=F.lit("Purchase"),
        payment_method=F.lit("-"),
        item=F.col("item"),
        ref_no=F.col("ref_no"),
        debit=F.col("purchase_pkr"),
        credit=nothing,
    )
    is_opening = F.col("type") == "opening_balance"
    paid = shaped(
        books.supplier_payments.where(later_than(last, "payment_date")).join(
            codes.withColumnRenamed("id", "supplier_id"), "supplier_id"
        ),
        2,
        id=F.col("id"),
        entry_date=F.col("payment_date"),
        type=F.col("type"),
        payment_method=F.col("payment_method"),
        bank_profile_id=F.col("bank_profile_id"),
        debit=F.when(is_opening, F.col("amount")).otherwise(nothing),
        credit=F.when(~is_opening, F.col("amount")).otherwise(nothing),
    )
    entries = reduce(DataFrame.unionByName, (opening, bought, paid))
    rows = running_total(
        entries,
        or_zero("debit") - or_zero("credit"),
        "balance",
        account=["supplier_code"],
        day="entry_date",
        order_id="id",
        after_id=["line_group"],
        no_day=EPOCH,
        **sizes,
    )
    kind = lowered("type")
    return rows.join(bank_names(books), "bank_profile_id", "left").select(
        "supplier_code",
        "id",
        "entry_date",
        F.when(is_opening, "Opening Bal").otherwise(F.col("type")).alias("type"),
        F.when(is_opening, "opening_balance")
        .otherwise(
            or_text(
                "item",
                "",
            )
        )
        .alias("_item"),
        F.concat(_template("type"), F.lit(" ("), F.coalesce("payment_method", F.lit("")), F.lit(")")).alias("_text"),
        "payment_method",
        "bank_name",
        "ref_no",
        as_total("debit").alias("debit"),
        as_total("credit").alias("credit"),
        F.when(is_opening | kind.contains("payment") | kind.contains("adjustment"), "payment")
        .when(F.col("type") == "Snapshot Opening", "snapshot")
        .otherwise("purchase")
        .alias("entry_type"),
        as_total("balance").alias("balance"),
    ).select(
        "supplier_code",
        "id",
        "entry_date",
        "type",
        F.coalesce(F.nullif("_item", F.lit("")), F.col("_text")).alias("description"),
        "payment_method",
        "bank_name",
        "ref_no",
        "debit",
        "credit",
        "entry_type",
        "balance",
    )


# purchase ledger


def purchase_ledger(books: Books, **sizes) -> DataFrame:
    bought = (
        active(books.purchases)
        .groupBy("ref_no")
        .agg(F.min("created_at").alias("first_at"), F.sum("purchase_pkr").alias("cost"))
        .where("cost <> 0")
        .select("ref_no", F.to_date("first_at").alias("entry_date"), half_up("cost").alias("cost"))
    )
    payments = books.purchase_payments.where(F.col("ref_no").isNotNull()).select(
        "id", "ref_no", "payment_date", half_up("amount").alias("credit"), "type", "payment_method"
    )
    paid = running_total(
        payments, F.col("credit"), "_paid", account=["ref_no"], day="payment_date", order_id="id", **sizes
    )
    cost_rows = bought.select(
        "ref_no",
        F.lit("PURCHASE").alias("entry_id"),
        "entry_date",
        F.lit("Purchase Entry").alias("description"),
        F.col("cost").alias("debit"),
        F.lit(None).cast(WHOLE).alias("credit"),
        F.col("cost").alias("balance"),
    )
    pay_rows = paid.join(bought.select("ref_no", "cost"), "ref_no", "left").select(
        "ref_no",
        F.col("id").cast("string").alias("entry_id"),
        F.col("payment_date").alias("entry_date"),
        F.when(F.col("type") == "adjustment", "Adjustment")
        .otherwise(F.concat(F.lit("Payment ("), _template("payment_method"), F.lit(")")))
        .alias("description"),
        F.lit(None).cast(WHOLE).alias("debit"),
        "credit",
        (or_zero("cost") - F.col("_paid")).cast(WHOLE).alias("balance"),
    )
    return cost_rows.unionByName(pay_rows)


# cash and bank


def _money_entries(books: Books, method: str, later: Column | None, manual: DataFrame, *, live_only: bool, bank: bool):
    """Customer, supplier, expense and manual movements of one payment method."""
    profile = ["bank_profile_id"] if bank else []
    counted = ~lowered("type").isin("adjustment", "opening_balance") & (lowered("payment_method") == method)
    empty = F.lit(None).cast(WHOLE)

    def shaped(rows: DataFrame, day: str, source: str, text: Column, credit: Column, debit: Column) -> DataFrame:
        return rows.select(
            "id",
            F.col(day).alias("txn_date"),
            text.alias("description"),
            credit.cast(WHOLE).alias("credit"),
            debit.cast(WHOLE).alias("debit"),
            F.lit(source).alias("source"),
            *profile,
        )

    received = books.customer_payments.where(counted & later("payment_date"))
    if live_only:
        received = active(received)
    received = received.join(names_by_any_key(books.sales).withColumnRenamed("key", "ref_no"), "ref_no", "left")
    suppliers = one_per_key(
        books.suppliers.select(F.col("id").alias("supplier_id"), "supplier_name"), "supplier_id", "supplier_name"
    )
    paid = books.supplier_payments.where(counted & later("payment_date")).join(suppliers, "supplier_id", "left")
    spent = books.expenses.where((lowered("payment_method") == method) & later("expense_date"))
    moved = manual.where(later("txn_date"))
    amount = half_away("amount")
    parts = [
        shaped(
            received,
            "payment_date",
            "customer",
            F.concat(
                F.lit("Customer Payment - "),
                F.coalesce("name", F.lit("Walk-in Customer")),
                F.lit(" (Ref: "),
                F.col("ref_no"),
                F.lit(")"),
            ),
            amount,
            empty,
        ),
        shaped(
            paid,
            "payment_date",
            "supplier",
            F.concat(
                F.lit("Supplier Payment - "),
                F.coalesce("supplier_name", F.lit("")),
                F.lit(" (Ref: "),
                F.col("id").cast("string"),
                F.lit(")"),
            ),
            empty,
            amount,
        ),
        shaped(spent, "expense_date", "expense", F.concat(F.lit("Expense: "), "title"), empty, amount),
        shaped(
            moved,
            "txn_date",
            "manual",
            F.col("comment"),
            F.when(F.col("type") == "deposit", amount),
            F.when(F.col("type") == "withdraw", amount),
        ),
    ]
    entries = reduce(DataFrame.unionByName, parts)
    if bank:
        entries = entries.where(F.col("bank_profile_id").isNotNull())
    return entries


def _money_ledger(entries: DataFrame, account: list[str], opening: Column | None, **sizes) -> DataFrame:
    rows = running_total(
        entries,
        or_zero("credit") - or_zero("debit"),
        "balance",
        account=account,
        day="txn_date",
        order_id="id",
        share_ties=True,
        **sizes,
    )
    balance = F.col("balance") if opening is None else F.col("balance") + opening
    return rows.select(
        "id",
        "txn_date",
        "description",
        or_zero("credit").alias("credit"),
        or_zero("debit").alias("debit"),
        "source",
        *account,
        balance.cast(WHOLE).alias("balance"),
    ).orderBy(*account, "txn_date", "id")


def cash_ledger(books: Books, with_opening: bool = False, **sizes) -> DataFrame:
    """Cash movements after the latest close; rows equal in (day, id) share a balance.

    The opening cash of the close is not part of the balance unless asked for.
    """
    last = latest_by_day(books.snapshots, "opening_cash")
    cutoff = field(last, "date_to", EPOCH)
    entries = _money_entries(
        books, "cash", lambda c: F.col(c) > cutoff, books.cash_txns, live_only=True, bank=False
    )
    opening = half_away(field(last, "opening_cash", 0)) if with_opening else None
    return _money_ledger(entries, [], opening, **sizes)


def bank_ledger(books: Books, with_opening: bool = False, **sizes) -> DataFrame:
    """Movements of every bank profile from the day of the latest close on.

    Unlike cash: the closing day itself counts, and so do deleted payments.
    """
    last = latest_by_day(books.snapshots, "opening_bank")
    cutoff = field(last, "date_to", EPOCH)
    entries = _money_entries(
        books, "bank", lambda c: F.col(c) >= cutoff, books.bank_txns, live_only=False, bank=True
    )
    opening = half_away(field(last, "opening_bank", 0)) if with_opening else None
    return _money_ledger(entries, ["bank_profile_id"], opening, **sizes)
