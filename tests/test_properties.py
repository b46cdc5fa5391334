"""Random ledgers: the sliced running total equals a plain fold."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybook.operators.running import running_total

ENTRY = st.tuples(
    st.sampled_from(["a", "b", "c"]),
    st.one_of(st.none(), st.integers(0, 3).map(lambda d: dt.date(2024, 1, 1) + dt.timedelta(days=d))),
    st.integers(0, 60),
    st.integers(-100, 100),
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(entries=st.lists(ENTRY, min_size=1, max_size=40, unique_by=lambda e: (e[0], e[2])), block=st.integers(1, 30))
def test_running_total_is_a_fold(spark, entries, block):
    rows = spark.createDataFrame(entries, "account string, day date, id bigint, amount bigint").coalesce(2)
    ours = running_total(
        rows, F.col("amount"), "total", account=["account"], day="day", order_id="id", block_rows=block
    )
    want, balance = {}, {}
    for account, day, number, amount in sorted(entries, key=lambda e: (e[0], e[1] or dt.date.max, e[2])):
        balance[account] = balance.get(account, 0) + amount
        want[(account, number)] = balance[account]
    assert {(r.account, r.id): r.total for r in ours.collect()} == want
