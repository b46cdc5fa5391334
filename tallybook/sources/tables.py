"""Schemas of the ledger tables, and books opened from a folder of them.

Schemas are given, never inferred. Nested columns hold JSON text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallybook.books import Books
from tallybook.functions.catalogue import CATALOGUE
from tallybook.functions.coerce import MONEY
from tallybook.functions.modules import MODULES
from tallybook.plans.sales import unify_sales
from tallybook.sources import csv_io

_SALE = (
    f"id bigint, ref_no string, customer_code string, customer_name string, booking_date date, total_pkr {MONEY},"
    " payment_status string, purchase_status string, is_deleted boolean, created_at timestamp_ntz"
)
_ROWS = f"{_SALE}, rows string, total_sar {MONEY}, pkr_rate {MONEY}"
_DATED = f"id bigint, txn_date date, type string, amount {MONEY}, comment string, created_at timestamp_ntz"
_PAID = f"payment_date date, amount {MONEY}, payment_method string, type string"
_STAYS = "checkin checkout nights location name rooms type rate total".split()
_KINDS = "flight hotel visa transport ziyarat".split()
_TRAVELLERS = "adult child infant".split()


def _money(*names: str) -> str:
    return ", ".join(f"{n} {MONEY}" for n in names)


# fixed values: tables by file name with their columns
TABLES = {
    "bookings": f"{_SALE}, contact_no string, flights string, hotels string, visa string, transport string, ziyarat string, "
    + ", ".join(f"{t}_count int, {t}_rate {MONEY}" for t in _TRAVELLERS)
    + ", "
    + _money(*[f"{k}_{m}" for k in _KINDS for m in ("sar_total", "sar_rate", "pkr_total")])
    + ", "
    + _money("flight_total", "hotels_total", "transport_total", "ziyarat_total", "net_pkr_total", "total_sar")
    + ", "
    + _money("per_person_qty", "per_person_final", *[f"{t}_per_person" for t in _TRAVELLERS]),
    "hotels": f"{_SALE}, agent_name string, hotels_total {MONEY}, sar_rate {MONEY}, "
    + ", ".join(f"hotel_{s} string" for s in _STAYS),
    "visa": f"{_ROWS}, persons bigint",
    "card": f"{_ROWS}, persons bigint",
    "groups": f"{_ROWS}, persons bigint, start_date date, end_date date, duration int",
    "ticketing": f"{_SALE}, flight_from string, flight_to string, flight_date string, airline string, total_sar {MONEY}, pkr_rate {MONEY}, "
    + ", ".join(f"{t}_qty int, {t}_rate {MONEY}" for t in _TRAVELLERS),
    "transport": _ROWS,
    "ziyarat": _ROWS,
    "purchase_entries": "id bigint, ref_no string, item string, "
    + _money("sale_sar", "sale_rate", "sale_pkr", "purchase_sar", "purchase_rate", "purchase_pkr", "profit")
    + ", supplier_code string, supplier_name string, status string, is_deleted boolean, created_at timestamp_ntz",
    "customer_payments": f"id bigint, ref_no string, {_PAID}, bank_profile_id bigint, is_deleted boolean",
    "supplier_payments": f"id bigint, supplier_id bigint, {_PAID}, bank_profile_id bigint",
    "purchase_payments": f"id bigint, ref_no string, {_PAID}",
    "expense_ledger": f"id bigint, expense_date date, title string, amount {MONEY}, payment_method string, bank_profile_id bigint, remarks string",
    "cash_transactions": _DATED,
    "bank_transactions": f"{_DATED}, bank_profile_id bigint",
    "banks": "id bigint, bank_name string, account_title string, account_number string, status string",
    "suppliers": "id bigint, supplier_code string, supplier_name string, category string, contact_no string, is_deleted boolean",
    "customers": "id bigint, customer_code string, name string, contact_no string, email string, is_deleted boolean",
    "archive_snapshots": "id bigint, date_from date, date_to date, "
    + _money("opening_cash", "opening_bank", "opening_profit", "total_customer_receivable", "total_supplier_payable")
    + ", created_at timestamp_ntz, backup_file string",
    "archive_balances": f"id bigint, snapshot_id bigint, balance_type string, code string, name string, balance {MONEY}, status string",
    "archive_profit_monthly": "id bigint, report_year int, report_month int, "
    + _money("total_sales", "total_purchase", "base_profit", "supplier_adjustment", "customer_adjustment")
    + f", total_expense {MONEY}, net_profit {MONEY}, archive_from date, archive_to date, snapshot_id bigint",
    "archive_logs": "id bigint, snapshot_id bigint, date_from date, date_to date, "
    + ", ".join(
        f"{t}_count bigint"
        for t in (*[m.table for m in MODULES], "customer_payments", "supplier_payments", "purchase_entries")
    )
    + ", deleted_at timestamp_ntz, archived_at timestamp_ntz, backup_file string",
}
# the name a table has in the books, where it differs
IN_BOOKS = {t.name: t.frame for t in CATALOGUE if t.name != t.frame}


def schema_of(spark: SparkSession, table: str) -> T.StructType:
    return spark.createDataFrame([], TABLES[table]).schema


def _books(read) -> Books:
    frames = {IN_BOOKS.get(t, t): lambda t=t: read(t) for t in TABLES}
    books = Books(frames)
    books.define("sales", lambda: unify_sales({m.table: getattr(books, m.table) for m in MODULES}))
    return books


def open_books(spark: SparkSession, root: str, fmt: str = "parquet") -> Books:
    """Books over ``root/<table>`` folders of a columnar format; a table is planned on first use."""

    def read(table: str) -> DataFrame:
        return spark.read.schema(TABLES[table]).format(fmt).load(f"{root.rstrip('/')}/{table}")

    return _books(read)


def import_books(spark: SparkSession, root: str, merge: bool = False, keep_empty: bool = False) -> Books:
    """Books over ``root/<table>`` folders of CSV text, brought to the table schemas."""

    def read(table: str) -> DataFrame:
        schema = schema_of(spark, table)
        path = f"{root.rstrip('/')}/{table}"
        return csv_io.import_typed(csv_io.read_text(spark, path, schema.names), schema, merge, keep_empty)

    return _books(read)
