"""Period close: opening figures, snapshot, archive views, purge."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.books import Books
from tallybook.functions.catalogue import ARCHIVE, DATED
from tallybook.functions.coerce import EPOCH, MONEY, as_total, lowered, on_days, or_zero, total
from tallybook.functions.modules import MODULES, module_value
from tallybook.operators.keyed import first_per_key, remove
from tallybook.operators.snapshots import before_day, field, latest_by_id
from tallybook.plans.outstanding import customer_balances, supplier_balances
from tallybook.plans.profit import MEASURES, live_months, month_spine, net_profit

ARCHIVE_TABLES = tuple(t.frame for t in ARCHIVE)
_DAYS = {"sales": "booking_date"} | {t.frame: t.day for t in DATED}
# what a purge counts: the eight modules in one pass over the unified sales, then every other dated table
_COUNTED = {"sales": None} | {t.frame: t.name for t in DATED if t.day != "booking_date"}


def in_range(table: str, start: dt.date | Column, end: dt.date | Column) -> Column:
    """Rows of a table of the books dated from ``start`` to ``end``; days are dates or date columns."""
    day = _DAYS[table]
    if isinstance(start, Column):
        if day == "created_at":
            return (F.col(day) >= start.cast("timestamp_ntz")) & (F.col(day) < F.date_add(end, 1).cast("timestamp_ntz"))
        return (F.col(day) >= start) & (F.col(day) <= end)
    if day == "created_at":
        return on_days(day, start, end)
    return F.col(day).between(F.lit(start), F.lit(end))


# opening figures


def _signed_flows(books: Books, method: str, manual: str, after: Column, to: dt.date) -> DataFrame:
    """Money in (+) and out (-) by one method later than ``after`` and up to ``to``."""
    counted = (lowered("payment_method") == method) & (lowered("type") != "adjustment")

    def signed(rows: DataFrame, day: str, amount: Column) -> DataFrame:
        stamp = F.to_date(day) if day == "created_at" else F.col(day)
        bounds = (stamp > after) & (stamp <= F.lit(to))
        return rows.where(bounds).select(amount.cast(MONEY).alias("amount"))

    given = F.col("amount")
    return reduce(
        DataFrame.unionByName,
        (
            signed(books.customer_payments.where(counted & ~F.col("is_deleted")), "payment_date", given),
            signed(books.supplier_payments.where(counted), "payment_date", -given),
            signed(books.expenses.where(lowered("payment_method") == method), "expense_date", -given),
            # manual rows are dated by their entry time here, unlike in the ledger
            signed(
                getattr(books, manual),
                "created_at",
                F.when(F.col("type") == "deposit", given).when(F.col("type") == "withdraw", -given),
            ),
        ),
    )


def _opening(books: Books, method: str, manual: str, column: str, to: dt.date) -> DataFrame:
    previous = before_day(books.snapshots, to)
    flows = _signed_flows(books, method, manual, field(previous, "date_to", EPOCH), to)
    base = field(previous, column, 0)
    return flows.agg(total("amount").alias("flow")).select(
        as_total(F.col("flow") + base).alias(column)
    )


def opening_cash(books: Books, to: dt.date) -> DataFrame:
    return _opening(books, "cash", "cash_txns", "opening_cash", to)


def opening_bank(books: Books, to: dt.date) -> DataFrame:
    return _opening(books, "bank", "bank_txns", "opening_bank", to)


def opening_profit(books: Books, to: dt.date) -> DataFrame:
    return books.profit_months.where(F.col("archive_to") <= F.lit(to)).agg(total("net_profit").alias("opening_profit"))


# snapshot


def next_snapshot_id(books: Books) -> Column:
    return field(books.snapshots, F.col("id"), 0) + F.lit(1)


def snapshot_balances(books: Books, start: dt.date, end: dt.date, snapshot_id: Column | None = None) -> DataFrame:
    def shaped(rows: DataFrame, kind: str, code: str, name: str, status: str) -> DataFrame:
        return rows.select(
            (next_snapshot_id(books) if snapshot_id is None else snapshot_id).cast("bigint").alias("snapshot_id"),
            F.lit(kind).alias("balance_type"),
            F.col(code).alias("code"),
            F.col(name).alias("name"),
            "balance",
            F.col(status).alias("status"),
        )

    customers = shaped(customer_balances(books, start, end), "CUSTOMER", "ref_no", "customer_name", "payment_status")
    suppliers = shaped(supplier_balances(books, start, end), "SUPPLIER", "supplier_code", "supplier_name", "status")
    return customers.unionByName(suppliers)


def snapshot_header(
    books: Books, start: dt.date, end: dt.date, balances: DataFrame | None = None, snapshot_id: Column | None = None
) -> DataFrame:
    """One row; each figure is a small aggregate, stacked and picked by name."""
    balances = snapshot_balances(books, start, end) if balances is None else balances
    figures = [
        *(
            frame.select(F.lit(name).alias("figure"), F.col(name).alias("value"))
            for name, frame in (
                ("opening_cash", opening_cash(books, end)),
                ("opening_bank", opening_bank(books, end)),
                ("opening_profit", opening_profit(books, end)),
            )
        ),
        balances.groupBy("balance_type").agg(total("balance").alias("value")).select(
            F.when(F.col("balance_type") == "CUSTOMER", "total_customer_receivable")
            .otherwise("total_supplier_payable")
            .alias("figure"),
            "value",
        ),
    ]
    names = ("opening_cash", "opening_bank", "opening_profit", "total_customer_receivable", "total_supplier_payable")
    picked = [
        F.coalesce(F.max(F.when(F.col("figure") == n, F.col("value"))), F.lit(0)).cast("decimal(20,2)").alias(n)
        for n in names
    ]
    return (
        reduce(DataFrame.unionByName, figures)
        .agg(*picked)
        .select(
            (next_snapshot_id(books) if snapshot_id is None else snapshot_id).cast("bigint").alias("id"),
            F.lit(start).alias("date_from"),
            F.lit(end).alias("date_to"),
            *names,
        )
    )


def snapshot_profit(
    books: Books,
    start: dt.date,
    end: dt.date,
    snapshot_id: Column | None = None,
    sales_day: str = "created_at",
) -> DataFrame:
    """A profit row for every calendar month the range touches, whole months each."""
    month = ["report_year", "report_month"]
    spine = month_spine(books.sales.sparkSession, start, end).drop("month_start")
    return (
        spine.join(live_months(books, start, end, sales_day), month, "left")
        .select(*month, *[as_total(or_zero(m)).alias(m) for m in MEASURES])
        .withColumn("net_profit", as_total(net_profit()))
        .withColumns(
            {
                "archive_from": F.lit(start),
                "archive_to": F.lit(end),
                "snapshot_id": (next_snapshot_id(books) if snapshot_id is None else snapshot_id).cast("bigint"),
            }
        )
    )


def reserved_id(books: Books, start: dt.date, end: dt.date, root: str) -> int:
    """The id of the next published close: above those of the books and of the manifest.

    A range that was published after the books were opened keeps its id.
    """
    spark = books.sales.sparkSession
    free = books.snapshots.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return free
    again = (F.col("date_from") == F.lit(start)) & (F.col("date_to") == F.lit(end)) & (F.col("id") >= free)
    known = spark.read.parquet(folder.toString()).agg(F.max(F.when(again, F.col("id"))), F.max("id")).first()
    return known[0] or max(free, (known[1] or 0) + 1)


def publish_snapshot(books: Books, start: dt.date, end: dt.date, root: str) -> str:
    """Write the three snapshot tables under ``root`` and return the run's folder.

    Spark has no transaction over tables. Each run writes to a folder of its
    own and appends its header to the manifest last; that row is the commit
    point. A run that dies leaves no row, a repeated run adds a newer one, and
    nothing that was published is ever overwritten. The header's totals are
    read back from the written balances, so they agree with them. Publish one
    close at a time: two runs at once may reserve the same id.
    """
    spark = books.sales.sparkSession
    run = f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    folder = f"{root.rstrip('/')}/runs/{run}"
    number = F.lit(reserved_id(books, start, end, root))
    wanted = snapshot_balances(books, start, end, number)
    wanted.write.parquet(f"{folder}/balances")
    snapshot_profit(books, start, end, number).write.parquet(f"{folder}/profit_months")
    balances = spark.read.schema(wanted.schema).parquet(f"{folder}/balances")
    header = snapshot_header(books, start, end, balances, number).withColumn("run", F.lit(run))
    header.write.mode("append").parquet(f"{root.rstrip('/')}/manifest")
    return folder


def published(spark: SparkSession, root: str) -> DataFrame:
    """The header of the newest run of each published range."""
    manifest = spark.read.parquet(f"{root.rstrip('/')}/manifest")
    return first_per_key(manifest, ["date_from", "date_to"], F.desc("run"))


# archive views


def archive_list(books: Books) -> DataFrame:
    logged = books.logs.select(F.col("snapshot_id").alias("id")).distinct().withColumn("_log", F.lit(1))
    profit = books.profit_months.groupBy(F.col("snapshot_id").alias("id")).agg(total("net_profit").alias("total_profit"))
    figures = ("total_customer_receivable", "total_supplier_payable", "opening_cash", "opening_bank", "opening_profit")
    return (
        books.snapshots.join(logged, "id", "left")
        .join(profit, "id", "left")
        .select(
            "id",
            "date_from",
            "date_to",
            *[as_total(or_zero(f)).alias(f) for f in figures],
            or_zero("_log").alias("has_log"),
            as_total(or_zero("total_profit")).alias("total_profit"),
        )
        .orderBy(F.desc("id"))
    )


def archive_view_balances(books: Books, snapshot_id: int) -> DataFrame:
    kind = F.lower("balance_type")
    return (
        books.balances.where(F.col("snapshot_id") == snapshot_id)
        .select(
            F.when(kind.contains("customer"), "customers").when(kind.contains("supplier"), "suppliers").alias("side"),
            "code",
            "name",
            as_total(or_zero("balance")).alias("balance"),
        )
        .where(F.col("side").isNotNull())
        .orderBy("side", "name", "code")
    )


def archive_view_profit(books: Books, snapshot_id: int) -> DataFrame:
    return (
        books.profit_months.where(F.col("snapshot_id") == snapshot_id)
        .select(
            "report_year",
            "report_month",
            *[as_total(or_zero(c)).alias(c) for c in ("total_sales", "total_purchase", "net_profit")],
        )
        .orderBy(F.desc("report_year"), F.desc("report_month"))
    )


COUNTS = tuple(f"{m.table}_count" for m in MODULES) + (
    "customer_payments_count",
    "supplier_payments_count",
    "purchase_entries_count",
)


def archive_log(books: Books, snapshot_id: int) -> DataFrame:
    return (
        books.logs.where(F.col("snapshot_id") == snapshot_id)
        .select(
            "id",
            "snapshot_id",
            F.coalesce("deleted_at", "archived_at").alias("deleted_at"),
            *[or_zero(c).cast("bigint").alias(c) for c in COUNTS],
        )
        .orderBy("id")
        .limit(1)
    )


# purge


def purge_counts(books: Books, start: dt.date, end: dt.date) -> DataFrame:
    """(table_name, purged): rows a purge of the range removes, 0 included."""
    parts = [
        getattr(books, frame).select(
            (module_value(F.col("prefix"), "table") if name is None else F.lit(name)).alias("table_name"),
            in_range(frame, start, end).alias("hit"),
        )
        for frame, name in _COUNTED.items()
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("table_name").agg(F.count_if("hit").alias("purged"))


def purge_log(books: Books, start: dt.date, end: dt.date) -> DataFrame:
    """The audit row of the purge; no row unless a close of exactly this range exists."""
    wanted = [m.table for m in MODULES] + ["customer_payments", "supplier_payments", "purchase_entries"]
    counts = [
        F.coalesce(F.max(F.when(F.col("table_name") == t, F.col("purged"))), F.lit(0)).alias(f"{t}_count")
        for t in wanted
    ]
    owner = latest_by_id(
        books.snapshots.where((F.col("date_from") == F.lit(start)) & (F.col("date_to") == F.lit(end)))
    )
    return (
        purge_counts(books, start, end)
        .agg(*counts)
        .withColumn("snapshot_id", F.nullif(field(owner, "id", -1), F.lit(-1)))
        .where(F.col("snapshot_id").isNotNull())
        .select("snapshot_id", F.lit(start).alias("date_from"), F.lit(end).alias("date_to"), *COUNTS)
    )


def purge_retained(books: Books, table: str, start: dt.date, end: dt.date) -> DataFrame:
    """Rows of any dated table that survive; an undated row is never purged."""
    return getattr(books, table).where(~F.coalesce(in_range(table, start, end), F.lit(False)))


def purge_range(books: Books, start: dt.date, end: dt.date) -> Books:
    """The books without the rows of the range, in every dated table."""
    return books.replace(**{t.frame: purge_retained(books, t.frame, start, end) for t in DATED})


def purgeable(books: Books, snapshot_id: int) -> DataFrame:
    """The close with this id, unless its purge has been logged already."""
    done = books.logs.select(F.col("snapshot_id").alias("id"))
    return books.snapshots.where(F.col("id") == snapshot_id).join(done, "id", "left_anti").select(
        "id", "date_from", "date_to"
    )


def purge_close(books: Books, snapshot_id: int) -> Books:
    """The books without the rows of a close; all rows stay if it does not exist or has been purged before.

    The bounds are scalar subqueries over the closes, so they reach the scans.
    """
    owner = purgeable(books, snapshot_id)
    start, end = (owner.agg(F.max(c).alias("v")).scalar() for c in ("date_from", "date_to"))
    kept = {}
    for t in DATED:
        kept[t.frame] = getattr(books, t.frame).where(~F.coalesce(in_range(t.frame, start, end), F.lit(False)))
    return books.replace(**kept)


def rearchive_profit(books: Books, start: dt.date, end: dt.date, snapshot_id: int) -> DataFrame:
    """The archive with the months of one close recomputed; sales count by booking date here."""
    fresh = snapshot_profit(books, start, end, F.lit(snapshot_id), sales_day="booking_date")
    columns = books.profit_months.columns
    kept = books.profit_months.join(
        fresh.select("snapshot_id", "report_year", "report_month"),
        ["snapshot_id", "report_year", "report_month"],
        "left_anti",
    )
    return kept.select(*columns).unionByName(fresh.select(*columns))


def drop_snapshot(books: Books, snapshot_id: int) -> Books:
    """The archive tables without one close and its children."""
    doomed = books.snapshots.where(F.col("id") == snapshot_id).select("id", F.col("id").alias("snapshot_id"))
    return books.replace(
        snapshots=remove(books.snapshots, doomed, ["id"]),
        **{t: remove(getattr(books, t), doomed, ["snapshot_id"]) for t in ARCHIVE_TABLES[1:]},
    )
