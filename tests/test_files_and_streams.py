"""Round trips through files, the close on disk, and streams against their batch twins."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallybook import queries
from tallybook.plans import close, outstanding
from tallybook.session import scratch_path
from tallybook.sources import csv_io
from tallybook.streaming import payments as feed

SCHEMA = "id bigint, name string, amount decimal(18,2), at timestamp_ntz, day date, is_deleted boolean, tags array<string>"


def test_export_then_import_is_identity(spark):
    rows = [
        (1, 'a "quoted", b', None, dt.datetime(2024, 1, 2, 3, 4, 5, 6000), dt.date(2024, 1, 2), True, ["x", "y,z"]),
        (2, "", None, None, None, False, None),
        (3, None, None, None, None, False, []),
        (4, "  two\nlines \\ and é ", None, None, None, True, None),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("amount", F.expr("cast(id - 2.5 as decimal(18,2))"))
    path = scratch_path(spark, "identity")
    from tallybook import Books

    assert csv_io.export_full(Books(visa=frame), path, ["visa"]).first()[3] == 4
    back = csv_io.open_export(spark, path).visa
    assert back.schema.simpleString() == frame.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))


def test_full_export_opens_again(spark, books):
    """Every table of the books comes back with its types, nested JSON included."""
    path = scratch_path(spark, "full")
    counted = {r.table_name: r.row_count for r in csv_io.export_full(books, path).collect()}
    opened = csv_io.open_export(spark, path)
    from tallybook.functions.catalogue import CATALOGUE

    assert set(counted) == {t.name for t in CATALOGUE}
    for t in CATALOGUE:
        ours, theirs = getattr(books, t.frame), getattr(opened, t.frame)
        assert theirs.schema.simpleString() == ours.schema.simpleString(), t.name
        assert counted[t.name] == ours.count()
        # a missing delete flag is written as FALSE
        assert sorted(map(str, theirs.collect())) == sorted(map(str, ours.collect())), t.name


def test_merge_keeps_the_first_of_a_repeated_key(spark):
    path = scratch_path(spark, "merge-order")
    rows = spark.createDataFrame([("7", "z"), ("7", "a"), ("8", "b")], "id string, v string").coalesce(1)
    rows.write.options(**csv_io.WRITE_OPTIONS).csv(path)
    text = csv_io.with_position(csv_io.read_text(spark, path, ["id", "v"]))
    schema = spark.createDataFrame([], "id bigint, v string").schema
    typed = text.select(F.col("id").cast("bigint").alias("id"), "v", "position")
    current = spark.createDataFrame([], schema)
    assert sorted(tuple(r) for r in csv_io.merge_import(current, typed, position="position").collect()) == [(7, "z"), (8, "b")]


def test_import_cells(spark):
    text = spark.createDataFrame(
        [("1", "1704164645000", "-3.50", "TRUE", ""), ("2", "", "0", "false", "{"), ("3", "2024-01-02", "x", "", "[1]")],
        "id string, at string, amount string, is_deleted string, tags string",
    )
    schema = spark.createDataFrame([], "id bigint, at timestamp_ntz, amount decimal(18,2), is_deleted boolean, tags array<int>").schema
    rows = [tuple(r) for r in csv_io.import_typed(text, schema).collect()]
    assert rows[0][1] == dt.datetime(2024, 1, 2, 3, 4, 5) and float(rows[0][2]) == -3.5 and rows[0][3] is True
    assert rows[1][1] is None and rows[1][2] == 0 and rows[1][3] is False and rows[1][4] is None
    assert rows[2][1] == dt.datetime(2024, 1, 2) and rows[2][2] is None and rows[2][3] is False and rows[2][4] == [1]
    merged = [tuple(r) for r in csv_io.import_typed(text, schema, merge=True).collect()]
    assert [m[3] for m in merged] == [True, False, None]


def test_merge_keeps_known_rows(spark):
    current = spark.createDataFrame([(1, "old")], "id bigint, v string")
    rows = spark.createDataFrame([(1, "new"), (2, "two")], "id bigint, v string")
    assert sorted(tuple(r) for r in csv_io.merge_import(current, rows).collect()) == [(1, "old"), (2, "two")]
    unkeyed = rows.withColumnRenamed("id", "ref_no")
    base = current.withColumnRenamed("id", "ref_no")
    assert csv_io.merge_import(base, unkeyed, "customer_payments").count() == 3
    assert csv_io.merge_import(base, unkeyed, "visa").count() == 2


def test_close_can_be_published_twice(spark, books):
    start, end = dt.date(1997, 1, 1), dt.date(1997, 3, 31)
    root = scratch_path(spark, "close-twice")
    close.publish_snapshot(books, start, end, root)
    first = close.published(spark, root).collect()
    folder = close.publish_snapshot(books, start, end, root)
    again = close.published(spark, root).collect()
    assert len(again) == 1 and again[0].run > first[0].run and folder.endswith(again[0].run)
    assert again[0].asDict() | {"run": 0} == first[0].asDict() | {"run": 0}
    balances = spark.read.parquet(f"{folder}/balances")
    owed = balances.where("balance_type = 'CUSTOMER'").agg(F.sum("balance")).first()[0]
    assert first[0].total_customer_receivable == owed
    assert spark.read.parquet(f"{folder}/profit_months").count() == 3
    close.publish_snapshot(books, dt.date(1997, 4, 1), dt.date(1997, 4, 30), root)
    ids = {r.date_from: r.id for r in close.published(spark, root).collect()}
    assert ids == {start: first[0].id, dt.date(1997, 4, 1): first[0].id + 1}


def day(n, hour=1):
    return dt.datetime(2024, 1, n, hour)


def test_late_rows_count(spark):
    """A row of a day long past changes that day; the days near the newest row are open."""
    source, folder = scratch_path(spark, "flow-in"), scratch_path(spark, "flow")
    schema = "ts timestamp_ntz, source string, amount decimal(18,2)"

    def drained(rows):
        spark.createDataFrame([(t, s, Decimal(a)) for t, s, a in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        feed.follow_flow(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
        got = feed.current_flow(spark, f"{folder}/out").collect()
        return sorted((r.day.day, r.source, float(r.net), r.entries, r.is_open) for r in got)

    first = [(day(1), "customer", 5), (day(1, 2), "customer", 7), (day(4), "expense", -3)]
    assert drained(first) == [(1, "customer", 12.0, 2, False), (4, "expense", -3.0, 1, True)]
    want = [(1, "customer", 112.0, 3, False), (4, "expense", -3.0, 1, False), (9, "expense", -1.0, 1, True)]
    assert drained([(day(1, 3), "customer", 100), (day(9), "expense", -1)]) == want
    assert feed.compact(spark, f"{folder}/out", feed.FLOW, ["day", "source"]) == 1
    want[2] = (9, "expense", -2.0, 2, True)
    assert drained([(day(9, 2), "expense", -1)]) == want


def test_late_request_lands_once(spark):
    """A request a week late lands, is marked and written apart; the same request sent again does not."""
    source, folder = scratch_path(spark, "land-in"), scratch_path(spark, "land")
    schema = "sent_at timestamp, request_id bigint, kind string, party string, amount string, entry_date string, payment_method string, bank_profile_id string, type string, note string"

    def drained(*rows):
        made = [(at, i, "customer", "PKG-1", amount, "2024-01-01", "cash", None, None, None) for i, at, amount in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        feed.land_requests(stream, None, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
        got = feed.landed_requests(spark, f"{folder}/out").collect()
        return sorted((r.request_id, float(r.amount), r.late) for r in got)

    # 2 stands twice in its batch, 3 is no payment
    assert drained((1, day(10), "5"), (2, day(11), "6"), (2, day(12), "7"), (3, day(12), "x")) == [(1, 5.0, False), (2, 6.0, False)]
    want = [(1, 5.0, False), (2, 6.0, False), (4, 8.0, True), (5, 9.0, False)]
    assert drained((4, day(3), "8"), (1, day(10), "5"), (5, day(11, 5), "9")) == want
    assert drained((4, day(3), "8")) == want
    late = spark.read.schema(feed.LANDED).parquet(f"{folder}/out-late/batch=*").collect()
    assert [r.request_id for r in late] == [4]


def test_status_follows_each_batch(spark, books):
    """Payments that are in the stream only, in two files, leave the status the batch job gives for all of them."""
    source, folder = scratch_path(spark, "status-in"), scratch_path(spark, "status")
    paid = books.customer_payments.where(~F.col("ref_no").startswith("CUST-"))
    without = books.replace(customer_payments=paid.where("false"))
    before = paid.where("id % 4 = 3")
    opening = feed.paid_so_far(before)
    for i, part in enumerate([paid.where("id % 4 = 0"), paid.where("id % 4 in (1, 2)")]):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(paid.schema).parquet(source)
        feed.follow_status(stream, lambda: without.sales, f"{folder}/out", f"{folder}/checkpoint", opening).awaitTermination()
    got = dict(tuple(r) for r in feed.current_status(spark, f"{folder}/out").collect())
    want = dict(tuple(r) for r in outstanding.status_of_refs(books, paid.where("id % 4 < 3")).collect())
    assert got == want
    feed.compact(spark, f"{folder}/out", feed.STATUS, ["ref_no"])
    assert dict(tuple(r) for r in feed.current_status(spark, f"{folder}/out").collect()) == want


def test_feed_accepts_each_request_once(spark, sf):
    assert queries.QUERIES["payment_feed"](spark, sf).groupBy("request_id").count().where("count > 1").count() == 0


def test_books_opened_from_a_folder_agree(spark, books):
    """Module tables written apart and opened again give the reports of the unified relation."""
    from tallybook.functions.modules import MODULES
    from tallybook.plans import ledgers, sales
    from tallybook.sources import tables

    def shaped(table, frame):
        missing = [f for f in tables.schema_of(spark, table).fields if f.name not in frame.columns]
        full = frame.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
        return full.select([F.col(f.name).cast(f.dataType) for f in tables.schema_of(spark, table).fields])

    root, text_root = scratch_path(spark, "books"), scratch_path(spark, "books-csv")
    written = {m.table: books.sales.where(F.col("prefix") == m.prefix).drop("prefix") for m in MODULES}
    for table in tables.TABLES:
        name = tables.IN_BOOKS.get(table, table)
        if table not in written and name in ("purchases", "customer_payments", "banks", "customers"):
            written[table] = getattr(books, name)
    for table, frame in written.items():
        shaped(table, frame).write.parquet(f"{root}/{table}")
        csv_io.as_text(shaped(table, frame)).write.options(**csv_io.WRITE_OPTIONS).csv(f"{text_root}/{table}")
    for opened in (tables.open_books(spark, root), tables.import_books(spark, text_root, keep_empty=True)):
        for report in (sales.sales_unified, ledgers.walkin_ledger, outstanding.registered_pending):
            assert sorted(map(str, report(opened).collect())) == sorted(map(str, report(books).collect()))
    assert opened.purchases.count() == books.purchases.count()
