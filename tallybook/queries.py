"""Every report and job as ``name -> f(spark, sf_dir)`` over the test tables.

Parameters a user would pass (dates, year, search text) are fixed here; change
jobs take their change sets from the same tables.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.books import Books
from tallybook.functions.catalogue import DATED
from tallybook.functions.coerce import MONEY
from tallybook.functions.modules import MODULES
from tallybook.plans import balance, changes, close, intake, ledgers, lines, outstanding, profit, purchases, reports, sales
from tallybook.session import scratch_path
from tallybook.sources import csv_io, fixtures
from tallybook.streaming import payments as feed

START, END = dt.date(1997, 1, 1), dt.date(1998, 12, 31)
CLOSED = (dt.date(1996, 1, 1), dt.date(1996, 12, 31))
AS_OF = dt.datetime(2001, 8, 1)
YEAR = 1996
MANIFEST_AS_OF = dt.datetime(2024, 3, 15)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Callable[[Books], DataFrame]], Callable]:
    """Register a function of the books under a query name."""

    def register(f: Callable[[Books], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(fixtures.load(spark, sf_dir))
        return f

    return register


def _plain(**named: Callable[[Books], DataFrame]) -> None:
    for name, f in named.items():
        query(name)(f)


# sources and lists

_plain(
    sales_unified=sales.sales_unified,
    bookings_active=sales.bookings_active,
    sales_lookup=lambda b: sales.sales_lookup(b, b.purchase_payments.select("ref_no")),
    sales_deleted_lookup=lambda b: sales.sales_lookup(b, b.purchases.where("is_deleted").select("ref_no"), deleted=True),
    suppliers_active=reports.suppliers_active,
    banks_list=reports.banks_list,
    bank_profiles_active=reports.bank_profiles_active,
    customers_list=reports.customers_list,
    customers_search=lambda b: reports.customers_list(b, "00001"),
    expense_list=reports.expense_list,
    live_data_start=sales.live_data_start,
)


def _profiled(b: Books) -> dict[str, DataFrame]:
    names = ("sales", "purchases", "customer_payments", "supplier_payments", "purchase_payments")
    names += ("expenses", "cash_txns", "bank_txns", "suppliers", "customers", "banks", "balances", "profit_months")
    return {n: getattr(b, n) for n in names}


_plain(
    table_profile=lambda b: reports.table_profile(_profiled(b)),
    capacity_projection=lambda b: reports.capacity(reports.table_profile(_profiled(b)), used_mb=120.0),
)


def _manifest(b: Books) -> DataFrame:
    """The event log read as a list of exports, one per event."""
    return b.events.select(
        F.concat(F.lit("backup-"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(".zip")).alias("name"),
        F.col("ts").alias("created_at"),
    )


_plain(
    manifest_expired=lambda b: reports.manifest_expired(_manifest(b), MANIFEST_AS_OF),
    manifest_list=lambda b: reports.manifest_list(_manifest(b)),
    manifest_latest=lambda b: reports.manifest_latest(_manifest(b)),
)

@query("export_range")
def _export_range(b: Books) -> DataFrame:
    """Write the tables of a range as CSV; the rows of each, as the manifest has counted them."""
    folder = scratch_path(b.sales.sparkSession, "export-range")
    return csv_io.export_range(b, START, END, folder).select("table_name", "row_count")


@query("export_full")
def _export_full(b: Books) -> DataFrame:
    folder = scratch_path(b.sales.sparkSession, "export-full")
    return csv_io.export_full(b, folder).select("table_name", "row_count")


@query("export_reopened")
def _export_reopened(b: Books) -> DataFrame:
    """The lines of all modules, read from a full export that is opened again."""
    spark = b.sales.sparkSession
    folder = scratch_path(spark, "export-reopened")
    csv_io.export_full(b, folder, [m.table for m in MODULES])
    return lines.all_lines(csv_io.open_export(spark, folder))


@query("export_roundtrip")
def _roundtrip(b: Books) -> DataFrame:
    """The purchase table exported and opened again."""
    spark = b.purchases.sparkSession
    folder = scratch_path(spark, "roundtrip")
    csv_io.export_full(b, folder, ["purchase_entries"])
    return csv_io.open_export(spark, folder).purchases


IMPORT_SCHEMA = "id bigint, sent_at timestamp_ntz, amount decimal(18,2), is_deleted boolean, payload struct<k:int>, note string"


@query("import_normalize")
def _import_normalize(b: Books) -> DataFrame:
    """Text as an old export holds it: epoch stamps, empty cells, TRUE/FALSE, JSON."""
    spark = b.events.sparkSession
    folder = scratch_path(spark, "import")
    e = F.col("event_id")
    since = "ts - TIMESTAMP_NTZ '1970-01-01 00:00:00'"
    units = {"DAY": 86_400_000, "HOUR": 3_600_000, "MINUTE": 60_000, "SECOND": 1000}
    millis = F.floor(sum((F.expr(f"CAST(extract({u} FROM {since}) AS DECIMAL(20,6))") * n for u, n in units.items()), F.lit(0))).cast("string")
    b.events.select(
        e.cast("string").alias("id"),
        F.when(e % 7 == 0, "").when(e % 7 == 1, "soon").otherwise(millis).alias("sent_at"),
        F.when(e % 5 == 0, "").when(e % 5 == 1, "n/a").otherwise((-F.col("value").cast(MONEY)).cast("string")).alias("amount"),
        F.when(e % 3 == 0, "TRUE").when(e % 3 == 1, "FALSE").otherwise("").alias("is_deleted"),
        F.when(e % 4 == 0, "").otherwise(F.col("props")).alias("payload"),
        F.when(e % 6 == 0, "").otherwise(F.concat(F.lit('a "'), "event_type", F.lit('", b'))).alias("note"),
    ).write.options(**csv_io.WRITE_OPTIONS).csv(folder)
    schema = spark.createDataFrame([], IMPORT_SCHEMA).schema
    text = csv_io.read_text(spark, folder, schema.names)
    return csv_io.import_typed(text, schema).select("id", "sent_at", "amount", "is_deleted", "payload.k", "note")


@query("import_merge")
def _import_merge(b: Books) -> DataFrame:
    """Payments of one table half restored from an export of all of them: known ids stay as they are."""
    rows = b.customer_payments
    current = rows.where(F.col("payment_date") < F.lit(START)).withColumn("amount", F.col("amount") * 0)
    incoming = csv_io.import_typed(csv_io.as_text(rows), rows.schema, merge=True)
    merged = csv_io.merge_import(
        current.withColumn("amount", F.col("amount").cast(MONEY)), incoming, "customer_payments"
    )
    return merged


# sales and outstanding

_plain(
    walkin_payment_status=outstanding.walkin_payment_status,
    walkin_pending=sales.walkin_pending,
    registered_pending=outstanding.registered_pending,
    supplier_pending=outstanding.supplier_pending,
    purchase_payables_pending=outstanding.purchase_payables_pending,
    customer_outstanding=lambda b: outstanding.customer_outstanding(b, START, END),
    supplier_outstanding=lambda b: outstanding.supplier_outstanding(b, START, END),
    sales_all=sales.sales_all,
    sales_recent=lambda b: sales.sales_recent(b, AS_OF, 30),
    purchase_status_pending=sales.purchase_status_pending,
)

# ledgers

_plain(
    walkin_ledger=ledgers.walkin_ledger,
    registered_ledger=ledgers.registered_ledger,
    registered_statement=lambda b: ledgers.registered_ledger(b, START, END),
    registered_closing=ledgers.registered_closing,
    supplier_ledger=ledgers.supplier_ledger,
    purchase_ledger=ledgers.purchase_ledger,
    cash_ledger=ledgers.cash_ledger,
    cash_ledger_opening=lambda b: ledgers.cash_ledger(b, with_opening=True),
    bank_ledger=ledgers.bank_ledger,
)

# balance sheet and profit

_plain(
    bs_walkin=balance.bs_walkin,
    bs_registered=balance.bs_registered,
    bs_suppliers=balance.bs_suppliers,
    bs_summary=balance.bs_summary,
    monthly_profit=lambda b: profit.monthly_profit(b, YEAR),
    profit_year=lambda b: profit.profit_year(b, YEAR),
    profit_month=lambda b: profit.profit_month(b, YEAR, 1),
    profit_month_live=lambda b: profit.profit_month(b, YEAR, 2),
)

# adjustments, purchases, quality, deleted

_plain(
    sale_adjustments=reports.sale_adjustments,
    supplier_adjustments=reports.supplier_adjustments,
    supplier_adjustments_range=lambda b: reports.supplier_adjustments(b, START, END),
    supplier_purchase_detail=purchases.supplier_purchase_detail,
    supplier_names=purchases.supplier_names,
    purchase_list=purchases.purchase_list,
    purchase_list_search=lambda b: purchases.purchase_list(b, START, END, "pkg-"),
    purchase_detail=purchases.purchase_detail,
    purchase_detail_totals=purchases.purchase_totals,
    purchase_detail_deleted=purchases.purchase_detail_deleted,
    purchase_deleted_totals=lambda b: purchases.purchase_totals(b, deleted=True),
    purchase_count=purchases.purchase_count,
    missing_supplier=purchases.missing_supplier,
    deleted_report=reports.deleted_report,
)

# nested rows

for _module in lines.LINES:
    _plain(**{f"purchase_lines_{_module}": lambda b, m=_module: lines.purchase_lines(b, m)})


_plain(purchase_worksheet=lines.purchase_worksheet)


def _totals(b: Books) -> DataFrame:
    return lines.rows_totals(b.visa).unionByName(lines.rows_totals(b.card)).unionByName(lines.rows_totals(b.groups))


_plain(
    hotel_stays=lines.hotel_stays,
    hotel_stays_deleted=lambda b: lines.hotel_stays(b, deleted=True),
    hotel_voucher=lines.hotel_voucher,
    rows_totals=_totals,
)

# period close


def _left_over(b: Books) -> DataFrame:
    """Rows that a purge has left in each dated table."""
    return reports.table_profile({t.name: getattr(b, t.frame) for t in DATED})


_plain(
    opening_cash=lambda b: close.opening_cash(b, END),
    opening_bank=lambda b: close.opening_bank(b, END),
    opening_profit=lambda b: close.opening_profit(b, END),
    snapshot_header=lambda b: close.snapshot_header(b, START, END),
    snapshot_balances=lambda b: close.snapshot_balances(b, START, END),
    snapshot_profit=lambda b: close.snapshot_profit(b, START, END),
    archive_list=close.archive_list,
    archive_view_balances=lambda b: close.archive_view_balances(b, 1),
    archive_view_profit=lambda b: close.archive_view_profit(b, 2),
    archive_log=lambda b: close.archive_log(b, 2),
    purge_counts=lambda b: close.purge_counts(b, START, END),
    purge_log=lambda b: close.purge_log(b, *CLOSED),
    purge_retained=lambda b: close.purge_retained(b, "purchases", START, END).select("ref_no", "item", "created_at"),
    purge_range=lambda b: _left_over(close.purge_range(b, START, END)),
    purge_close=lambda b: _left_over(close.purge_close(b, 1)),
    purge_close_again=lambda b: _left_over(close.purge_close(b, 2)),
    rearchive_profit=lambda b: close.rearchive_profit(b, dt.date(1996, 1, 1), dt.date(1996, 12, 31), 1),
)


@query("snapshot_drop")
def _snapshot_drop(b: Books) -> DataFrame:
    left = close.drop_snapshot(b, 2)
    return reports.table_profile({t: getattr(left, t) for t in close.ARCHIVE_TABLES})


@query("snapshot_publish")
def _snapshot_publish(b: Books) -> DataFrame:
    """Write a close and read its header back."""
    spark = b.sales.sparkSession
    root = scratch_path(spark, "close")
    close.publish_snapshot(b, START, END, root)
    return close.published(spark, root).drop("run")


# changes


def purchase_requests(b: Books) -> DataFrame:
    """Re-priced returned lines of the feed, with stray blanks in and around the item, some of them sent again."""
    p = F.col("l_partkey")
    feed = b.purchase_feed.where((F.col("purchase_sar") > 0) & (F.col("status") == "Purchase"))
    # a fifth of the items is sent twice; the first counts
    feed = feed.withColumn("attempt", F.explode(F.sequence(F.lit(0), (p % 5 == 0).cast("int"))))
    return feed.select(
        "ref_no",
        F.struct("attempt", p, "l_suppkey", "sale_sar", "purchase_sar", "created_at").alias("position"),
        F.when(p % 37 == 5, "").when(p % 3 == 0, F.concat(F.lit(" "), "item")).otherwise(F.col("item")).alias("item"),
        F.col("sale_sar").cast("string").alias("sale_sar"),
        F.when(F.col("attempt") == 0, "80").otherwise("81").alias("sale_rate"),
        F.when(p % 6 == 0, "").when(p % 6 == 1, "x").otherwise(F.col("purchase_sar").cast("string")).alias("purchase_sar"),
        F.lit("77.25").alias("purchase_rate"),
        "supplier_code",
        "supplier_name",
        "id",
        "status",
        "created_at",
    )


def sale_requests(b: Books) -> DataFrame:
    """Half-paid sales re-priced, and a new card sale for every customer."""
    s = b.sales
    edits = s.where("payment_status = 'PARTIAL'").select(
        "id",
        "ref_no",
        F.when(F.col("id") % 4 == 0, "CUST-00000001").otherwise("").alias("customer_code"),
        "customer_name",
        "booking_date",
        (F.col("total_pkr") + 10).cast(MONEY).alias("total_pkr"),
        "created_at",
    )
    new = b.customer.select(
        (F.col("c_custkey") + 50000000).alias("id"),
        F.concat(F.lit("CARD-"), (F.col("c_custkey") + 50000000).cast("string")).alias("ref_no"),
        F.when(F.col("c_custkey") % 2 == 0, "CUST-00000002").alias("customer_code"),
        F.col("c_name").alias("customer_name"),
        F.lit(dt.date(2001, 9, 1)).alias("booking_date"),
        F.col("c_acctbal").cast(MONEY).alias("total_pkr"),
        F.lit(dt.datetime(2001, 9, 1)).cast("timestamp_ntz").alias("created_at"),
    )
    return edits.unionByName(new)


def _checked(b: Books) -> DataFrame:
    return intake.checked(b.requests, b.suppliers)


@query("payment_edits")
def _payment_edits(b: Books) -> DataFrame:
    """Customer payments edited by the requests of the same number."""
    edits = intake.checked(b.requests.where(F.col("kind").isin("customer", "registered")), rules=intake.EDITS)
    fields = ("amount", "payment_date", "payment_method", "bank_profile_id", "type")
    return intake.apply_edits(b.customer_payments, edits, "payment_date", fields)


def _edits(b: Books, kind: str) -> DataFrame:
    return intake.checked(b.requests.where(F.col("kind") == kind), rules=intake.EDITS)


EXPENSE_FIELDS = ("expense_date", "title", "amount", "payment_method", "bank_profile_id", "remarks")
_plain(
    expense_edits=lambda b: intake.apply_edits(
        b.expenses, _edits(b, "expense"), "expense_date", EXPENSE_FIELDS, note="remarks"
    ),
    supplier_payment_edits=lambda b: intake.apply_edits(
        b.supplier_payments,
        _edits(b, "supplier"),
        "payment_date",
        ("amount", "payment_date", "payment_method", "bank_profile_id", "type"),
    ),
    cash_edits=lambda b: intake.apply_edits(
        b.cash_txns, _edits(b, "cash"), "txn_date", ("txn_date", "type", "amount", "comment"), note="comment"
    ).drop("created_at"),
    bank_edits=lambda b: intake.apply_edits(
        b.bank_txns,
        _edits(b, "bank"),
        "txn_date",
        ("txn_date", "type", "amount", "comment", "bank_profile_id"),
        note="comment",
    ).drop("created_at"),
)


def _module_requests(b: Books, table: str, rate: str, nested: dict, new: dict) -> DataFrame:
    """Every sale of a module saved again at another rate, and a new one for every supplier."""
    again = getattr(b, table).select(
        F.lit(None).cast("bigint").alias("request_id"),
        "ref_no",
        "booking_date",
        (F.col(rate) + 1).cast(MONEY).alias(rate),
        *[v.alias(c) for c, v in nested.items()],
    )
    fresh = b.supplier.select(
        F.col("s_suppkey").alias("request_id"),
        F.lit("").alias("ref_no"),
        F.lit(dt.date(2001, 9, 1)).alias("booking_date"),
        F.lit(70).cast(MONEY).alias(rate),
        *[v.cast(again.schema[c].dataType).alias(c) for c, v in new.items()],
    )
    return again.unionByName(fresh)


def _saved(b: Books, table: str, rate: str, nested: dict, new: dict) -> DataFrame:
    current = changes.with_module_totals(getattr(b, table), table)
    return changes.module_save(current, _module_requests(b, table, rate, nested, new), table)


SAVED = ("ref_no", "is_deleted", "booking_date")


def _rows_saved(table: str, field: str) -> Callable[[Books], DataFrame]:
    """Saves of a module with one list of rows; the new sale has one row worth the supplier's key."""

    def saved(b: Books) -> DataFrame:
        key = F.col("s_suppkey").cast("string")
        row = F.concat(F.lit('[{"persons":2,"description":"new","' + field + '":"'), key, F.lit('"}]'))
        return _saved(b, table, "pkr_rate", {"rows": F.col("rows")}, {"rows": row}).drop("rows")

    return saved


def _hotel_saves(b: Books) -> DataFrame:
    """Stays sent as one list of structs and stored as parallel lists."""
    own = {f: lines.listed(c, lines.TEXTS) for f, c in lines.STAY_COLUMNS.items()}
    stays = F.transform(own["hotel"], lambda _, i: F.struct(*[F.get(v, i).alias(f) for f, v in own.items()]))
    key = F.col("s_suppkey").cast("string")
    one = F.array(F.struct(*[(key if f == "total" else F.lit("new")).alias(f) for f in own]))
    saved = _saved(b, "hotels", "sar_rate", {"hotels": stays}, {"hotels": one})
    n = F.size(lines.listed("hotel_name", lines.TEXTS)).alias("n_rows")
    return saved.select(*SAVED, "sar_rate", "hotels_total", "total_pkr", n)


def _ticket_saves(b: Books) -> DataFrame:
    start, end, airline = (lines.listed(c, lines.TEXTS) for c in ("flight_from", "flight_to", "airline"))
    date = F.lit("1997-01-01").alias("date")
    flights = F.transform(start, lambda x, i: F.struct(x.alias("from"), F.get(end, i).alias("to"), date, F.get(airline, i).alias("airline")))
    fares = [f"{t}_{k}" for t in ("adult", "child", "infant") for k in ("qty", "rate")]
    one = F.array(F.struct(F.lit("LHE").alias("from"), F.lit("JED").alias("to"), date, F.lit(None).cast("string").alias("airline")))
    new = {"flights": one} | {c: F.col("s_suppkey") if c == "adult_rate" else F.lit(2 if c == "adult_qty" else 0) for c in fares}
    b = b.replace(ticketing=b.ticketing.withColumn("flight_date", F.lit("[]")))
    saved = _saved(b, "ticketing", "pkr_rate", {"flights": flights} | {c: F.col(c) for c in fares}, new)
    n = F.size(lines.listed("flight_date", lines.TEXTS)).alias("n_rows")
    return saved.select(*SAVED, "pkr_rate", "total_sar", "total_pkr", n)


def _booking_saves(b: Books) -> DataFrame:
    """Five lists at once; a sale without flights stores an empty list."""
    fares = [f"{t}_{k}" for t in ("adult", "child", "infant") for k in ("count", "rate")]
    lists = ("flights", "hotels", "visa", "transport", "ziyarat")
    key = F.col("s_suppkey").cast("string")
    new = {c: F.lit(None) for c in lists} | {c: F.lit(0) for c in fares}
    new |= {"transport": F.concat(F.lit('[{"text":"new","amount":"'), key, F.lit('"}]')), "adult_count": F.lit(1), "adult_rate": F.lit(900)}
    saved = _saved(b, "bookings", "visa_sar_rate", {c: F.col(c) for c in (*lists, *fares)}, new)
    n = F.size(F.from_json("flights", lines.FLIGHT)).alias("n_rows")
    return saved.select(*SAVED, "visa_sar_rate", "flight_total", "hotels_total", "transport_total", "ziyarat_total", n)


_plain(
    module_save=_rows_saved("visa", "total"),
    module_save_card=_rows_saved("card", "total"),
    module_save_groups=_rows_saved("groups", "total"),
    module_save_transport=_rows_saved("transport", "sar"),
    module_save_ziyarat=_rows_saved("ziyarat", "sar"),
    module_save_hotels=_hotel_saves,
    module_save_ticketing=_ticket_saves,
    module_save_bookings=_booking_saves,
)


def _customer_saves(b: Books) -> DataFrame:
    """A third of the customers changed by id, a third entered anew without a code; a seventh has no name."""
    key = F.col("c_custkey")
    return b.customer.where(key % 3 < 2).select(
        key.alias("request_id"),
        F.when(key % 3 == 0, key).alias("id"),
        F.when(key % 7 != 0, F.upper("c_name")).alias("name"),
        F.concat(F.lit(" 0300"), key.cast("string")).alias("contact_no"),
        F.when(key % 5 != 0, F.lit("a@example.org ")).alias("email"),
    )


def _supplier_saves(b: Books) -> DataFrame:
    key = F.col("s_suppkey")
    return b.supplier.where(key % 3 < 2).select(
        key.alias("request_id"),
        F.when(key % 3 == 0, key * 2).alias("id"),
        F.when(key % 7 != 0, F.upper("s_name")).otherwise("").alias("supplier_name"),
        F.lit("Changed").alias("category"),
        F.lit("0").alias("contact_no"),
    )


_plain(
    customer_save=lambda b: changes.customer_save(b, _customer_saves(b)),
    supplier_save=lambda b: changes.supplier_save(b, _supplier_saves(b)),
)


def _settled(b: Books) -> DataFrame:
    """Settled sales that may be deleted."""
    free = changes.delete_eligibility(b).where("deletable").select("ref_no")
    return b.sales.where("payment_status = 'COMPLETE'").select("ref_no").join(free, "ref_no", "left_semi")


def _customer_requests(b: Books) -> DataFrame:
    key = F.col("c_custkey")
    return b.customer.select(
        (key + 90000000).alias("id"),
        F.concat(F.lit("CUST-"), F.lpad(key.cast("string"), 8, "0")).alias("customer_code"),
        F.when(key % 7 != 0, F.upper("c_name")).alias("name"),
        F.concat(F.lit(" 0300"), key.cast("string"), F.lit(" ")).alias("contact_no"),
        F.when(key % 5 != 0, F.lit(" a@example.org")).alias("email"),
    )


def _supplier_requests(b: Books) -> DataFrame:
    key = F.col("s_suppkey")
    return b.supplier.select(
        (key + 90000000).alias("id"),
        F.concat(F.lit("SUP-"), F.lpad((key * 2).cast("string"), 8, "0")).alias("supplier_code"),
        F.when(key % 7 != 0, F.upper("s_name")).otherwise("").alias("supplier_name"),
        F.lit("Changed").alias("category"),
        F.lit("0").alias("contact_no"),
    )


def _bank_requests(b: Books) -> DataFrame:
    key = F.col("n_nationkey").cast("bigint")
    return b.nation.select(
        (key * 2).alias("id"),
        F.concat(F.lit(" "), "n_name").alias("bank_name"),
        F.when(key % 5 != 0, "T ").alias("account_title"),
        F.lit("X1").alias("account_number"),
        F.when(key % 3 == 0, "Inactive").when(key % 3 == 1, "").alias("status"),
    )


def _allocation_requests(b: Books) -> DataFrame:
    arms = F.col("event_id") % 8
    prefix = F.when(arms == 0, MODULES[0].prefix)
    for i, m in enumerate(MODULES[1:], start=1):
        prefix = prefix.when(arms == i, m.prefix)
    return b.events.select(
        F.col("event_id").alias("request_id"), F.when(F.col("event_type") == "click", "SUP-").otherwise(prefix).alias("prefix")
    )


_plain(
    purchase_upsert=lambda b: changes.purchase_upsert(b, purchase_requests(b)).select(*purchases.DETAIL, "id", "is_deleted"),
    purchase_status_rollup=lambda b: changes.purchase_status_rollup(
        b,
        changes.clean_purchase_items(purchase_requests(b)),
        b.purchases.where("is_deleted"),
    ).select("ref_no", "purchase_status"),
    payment_status_rollup=lambda b: changes.payment_status_rollup(b).select("ref_no", "payment_status"),
    delete_eligibility=changes.delete_eligibility,
    soft_delete=lambda b: changes.soft_delete(b.sales, _settled(b)).select("ref_no", "is_deleted"),
    restore=lambda b: changes.restore_purchases(b, b.purchases.where("is_deleted").select("ref_no")).select(
        "ref_no", "item", "is_deleted"
    ),
    permanent_delete=lambda b: changes.permanent_delete(
        b.sales, b.sales.where(F.year("booking_date") == 1997).select("ref_no")
    ).select("ref_no", "is_deleted"),
    entry_delete=lambda b: changes.purchase_entry_delete(
        b, b.purchases.where(F.year("created_at") == 1998).select("id")
    ).select("ref_no", "item", "status"),
    payment_delete=lambda b: changes.entry_delete(
        b.supplier_payments, b.supplier_payments.where("type = 'adjustment'").select("id")
    ).select("id", "amount"),
    ref_high_water=changes.ref_high_water,
    ref_allocate=lambda b: changes.ref_allocate(b, _allocation_requests(b)),
    master_upsert=lambda b: changes.customer_upsert(b, _customer_requests(b)),
    supplier_upsert=lambda b: changes.supplier_upsert(b, _supplier_requests(b)),
    bank_upsert=lambda b: changes.bank_upsert(b, _bank_requests(b)),
    sales_upsert=lambda b: changes.sales_upsert(b, sale_requests(b)).select(
        "ref_no", "customer_code", "customer_name", "booking_date", "total_pkr", "payment_status", "is_deleted"
    ),
    intake_validate=lambda b: intake.accepted(_checked(b)),
    intake_rejected=lambda b: intake.rejected(_checked(b)),
)

# streams


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, because a stream source takes a folder or a pattern but no single file
    path = os.path.join(sf_dir, "events.parquet")
    return spark.readStream.schema(fixtures.SCHEMAS["events"]).parquet(f"{path}*")


def payment_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intake requests as a stream in which every request arrives twice."""
    text = fixtures.VIEWS["requests"].replace("SELECT ", "SELECT CAST(ts AS TIMESTAMP) AS sent_at, ", 1)
    once = spark.sql(text, events=_event_stream(spark, sf_dir))
    again = spark.sql(text, events=_event_stream(spark, sf_dir))
    books = fixtures.load(spark, sf_dir)
    folder = scratch_path(spark, "payment-feed")
    feed.land_requests(once.unionByName(again), books.suppliers, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return feed.landed_requests(spark, f"{folder}/out").drop("sent_at", "late")


def payment_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = fixtures.load(spark, sf_dir)
    stream = spark.sql(fixtures.VIEWS["customer_payments"], events=_event_stream(spark, sf_dir))
    folder = scratch_path(spark, "payment-status")
    feed.follow_status(stream, lambda: books.sales, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return feed.current_status(spark, f"{folder}/out")


def flows(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    source = (
        F.when(kind.isin("purchase", "signup"), "customer")
        .when(kind == "click", "supplier")
        .when(kind == "view", "expense")
        .when(F.col("event_id") % 2 == 0, "deposit")
        .otherwise("withdraw")
    )
    return events.select("ts", source.alias("source"), F.col("value").cast(MONEY).alias("value")).select(
        "ts", "source", feed.signed_flow(F.col("source"), F.col("value")).alias("amount")
    )


def daily_cash_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "cash-flow")
    feed.follow_flow(flows(_event_stream(spark, sf_dir)), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return feed.current_flow(spark, f"{folder}/out")


QUERIES["payment_feed"] = payment_feed
QUERIES["payment_status_stream"] = payment_status_stream
QUERIES["daily_cash_flow"] = daily_cash_flow
