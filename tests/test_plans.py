"""Properties of physical plans that matter at scale."""

import re

import pytest

from tallybook.operators.running import running_total
from tallybook.plans import ledgers, sales
from tallybook.queries import QUERIES

PLANNED = """cash_ledger bank_ledger walkin_ledger registered_ledger supplier_ledger purchase_ledger registered_pending
supplier_pending bs_summary profit_year sale_adjustments purchase_worksheet snapshot_balances purge_counts archive_list
purchase_upsert payment_status_rollup ref_allocate intake_validate deleted_report sales_all""".split()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join_and_no_python(name, spark, sf):
    plan = physical(QUERIES[name](spark, sf))
    for operator in ("NestedLoop", "CartesianProduct", "PythonEval", "MapInPandas", "FlatMapGroups"):
        assert operator not in plan


def test_only_pre_aggregated_rows_meet_in_one_task(spark, sf):
    for name in PLANNED:
        lines = physical(QUERIES[name](spark, sf)).splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert "Aggregate" in lines[i + 1] or "LocalLimit" in lines[i + 1], (name, lines[i + 1])


def test_range_filters_reach_the_scan(spark, sf, books):
    plan = physical(books.orders.where(sales.F.col("o_orderdate") >= "1997-01-01"))
    assert "GreaterThanOrEqual(o_orderdate" in plan
    stamped = books.orders.withColumnRenamed("o_orderdate", "created_at")
    from tallybook.queries import END, START
    from tallybook.functions.coerce import on_days

    plan = physical(stamped.where(on_days("created_at", START, END)).select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_counting_passes_skip_the_name_lookups(books):
    """Slicing the cash ledger reads the entries twice, but joins the names once."""
    plan = physical(ledgers.cash_ledger(books))
    assert len(re.findall(r"min_by\(customer_name", plan)) == 2  # partial and final of one aggregate


def test_running_total_shuffles_the_rows_once(spark):
    day = "date_add(date'2024-01-01', cast(id % 50 as int)) as day"
    rows = spark.range(1000).selectExpr("id", "'a' || id % 9 as account", day, "id % 5 as amount")
    plan = physical(
        running_total(rows, sales.F.col("amount"), "t", account=["account"], day="day", order_id="id").select("id", "t")
    )
    # the rows once, the sums of slices, and what comes before each slice
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning(_k0" in x and "_block" in x]) == 3
