"""The tables of the ledger: their names on disk and in the books, and the column that dates their rows."""

from __future__ import annotations

from dataclasses import dataclass

from tallybook.functions.modules import MODULES


@dataclass(frozen=True)
class Table:
    name: str  # of files and folders
    frame: str  # in the books
    day: str | None = None  # dates a row for range exports and purges
    archive: bool = False  # written by closes, exported whole


# fixed values: tables, their date columns, in the order of an export
CATALOGUE = (
    *(Table(m.table, m.table, "booking_date") for m in MODULES),
    Table("purchase_entries", "purchases", "created_at"),
    Table("customer_payments", "customer_payments", "payment_date"),
    Table("supplier_payments", "supplier_payments", "payment_date"),
    Table("expense_ledger", "expenses", "expense_date"),
    Table("bank_transactions", "bank_txns", "created_at"),
    Table("cash_transactions", "cash_txns", "created_at"),
    Table("purchase_payments", "purchase_payments"),
    Table("banks", "banks"),
    Table("suppliers", "suppliers"),
    Table("customers", "customers"),
    Table("archive_snapshots", "snapshots", archive=True),
    Table("archive_balances", "balances", archive=True),
    Table("archive_profit_monthly", "profit_months", archive=True),
    Table("archive_logs", "logs", archive=True),
)
BY_NAME = {t.name: t for t in CATALOGUE}
DATED = tuple(t for t in CATALOGUE if t.day)
ARCHIVE = tuple(t for t in CATALOGUE if t.archive)
