"""Sliced running totals equal one plain window, whatever the skew."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallybook.operators import running
from tallybook.operators.running import numbered, running_total
from tallybook.plans import ledgers

SCHEMA = "account string, day date, rank int, id bigint, amount bigint"


def entries(spark, n=600, seed=7):
    """One account holds two thirds of the rows; some days are missing; ids repeat across ranks."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        account = "hot" if rnd.random() < 0.66 else f"a{rnd.randrange(40)}"
        day = None if rnd.random() < 0.05 else dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(9))
        rows.append((account, day, i % 3, i // 3 * 7, rnd.randrange(-50, 50)))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain(rows, share_ties, order):
    w = Window.partitionBy("account").orderBy(F.coalesce("day", F.lit(dt.date(9999, 12, 31))), *order)
    if not share_ties:
        w = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum("amount").over(w))


def as_set(rows):
    return sorted(map(str, rows.select("account", "day", "rank", "id", "amount", "total").collect()))


def check(spark, **kw):
    rows = entries(spark)
    ours = running_total(rows, F.col("amount"), "total", account=["account"], day="day", order_id="id", **kw)
    share = kw.get("share_ties", False)
    order = [*kw.get("before_id", []), "id", *kw.get("after_id", [])]
    assert as_set(ours) == as_set(plain(rows, share, order))


def test_hot_account_is_sliced(spark):
    check(spark, after_id=["rank"], block_rows=64)


def test_rank_before_id(spark):
    check(spark, before_id=["rank"], block_rows=64)


def test_no_hot_account(spark):
    check(spark, after_id=["rank"])


def test_everything_sliced(spark):
    check(spark, after_id=["rank"], block_rows=10)


def test_missing_and_sparse_ids(spark):
    """Ids that are hashes, or missing, give the same totals for every block size."""
    rnd = random.Random(3)
    rows = [("a" if i % 4 else None, dt.date(2024, 1, 1 + i % 2), i, None if i % 9 == 0 else rnd.randrange(-(2**62), 2**62), i % 13) for i in range(300)]
    rows = spark.createDataFrame(rows, SCHEMA)
    want = as_set(plain(rows, False, ["id", "rank"]))
    for block_rows in (1, 7, 100, 10**6):
        ours = running_total(rows, F.col("amount"), "total", account=["account"], day="day", order_id="id", after_id=["rank"], block_rows=block_rows)
        assert as_set(ours) == want


def test_shared_ties(spark):
    check(spark, share_ties=True, block_rows=16)


def test_ledger_without_accounts(spark):
    rows = entries(spark)
    ours = running_total(rows, F.col("amount"), "total", day="day", order_id="id", share_ties=True, block_rows=30)
    whole = plain(rows.withColumn("account", F.lit("x")), True, ["id"])
    assert sorted(map(str, ours.select("id", "rank", "total").collect())) == sorted(
        map(str, whole.select("id", "rank", "total").collect())
    )


def test_numbered(spark):
    rows = spark.createDataFrame([("A" if i % 3 else "B", i * 11) for i in range(200)], "g string, id bigint")
    ours = numbered(rows, "n", group=["g"], order_id="id", block_rows=100)
    w = Window.partitionBy("g").orderBy("id")
    assert sorted(map(str, ours.collect())) == sorted(map(str, rows.withColumn("n", F.row_number().over(w)).collect()))


def test_every_ledger_is_the_same_sliced(spark, books):
    sizes = {"block_rows": 97}
    for ledger in (ledgers.cash_ledger, ledgers.bank_ledger):
        assert sorted(map(str, ledger(books, **sizes).collect())) == sorted(map(str, ledger(books).collect()))
    for ledger in (ledgers.walkin_ledger, ledgers.registered_ledger, ledgers.supplier_ledger, ledgers.purchase_ledger):
        assert sorted(map(str, ledger(books, **sizes).collect())) == sorted(map(str, ledger(books).collect()))


def test_no_window_runs_over_the_whole_ledger(books):
    """The cash ledger may gather its day totals in one task, never its entries."""
    plan = ledgers.cash_ledger(books)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    single = [line for line in physical.splitlines() if "Exchange SinglePartition" in line]
    windows = [line for line in physical.splitlines() if "Window [" in line]
    assert len(windows) == 3
    assert len([w for w in windows if "_block" not in w]) == 1
    assert single


def test_closing_balance_is_credits_less_debits(books):
    rows = ledgers.registered_ledger(books)
    totals = {r[0]: r[1] for r in rows.groupBy("customer_code").agg(F.sum(F.col("credit") - F.col("debit"))).collect()}
    closing = {r[0]: r[1] for r in ledgers.registered_closing(books).collect()}
    assert totals == closing


def test_blocks_hold_equal_counts_with_an_outlying_id(spark):
    """One id far from all others leaves the blocks of the others even."""
    rows = spark.range(5000).selectExpr("id").unionByName(spark.createDataFrame([(10**15,), (None,)], "id bigint"))
    sizes = {r["_block"]: r["count"] for r in running._blocked(rows, "id", 100).groupBy("_block").count().collect()}
    assert sizes.pop(-1) == 1 and len(sizes) >= 45 and max(sizes.values()) <= 150
