"""Running totals that stay spread out when one account is huge.

A plain ``sum() over (partition by account order by ...)`` sends an account to
one task, which is wrong for a ledger with few accounts or none, and for an
account that holds a large share of the rows.

So every account is cut into slices ``(day, block of ids)``; each slice is one
window partition, and a slice starts from the sum of the slices before it. Blocks
hold about equal numbers of rows, whatever the ids are: one slim pass over the ids
finds 1,023 of them that part the rows evenly, and neighbouring parts are joined
until a block has ``block_rows`` rows; rows without an id are a block of their own.
A block is never much larger than ``block_rows`` or a thousandth of the rows, but
for rows that share an id. The sums of earlier slices are taken in two steps, per
day and per block within a day, so those windows are bounded by the calendar and by
the number of blocks. Slices depend on the data only (no sampling, no partition
ids): a retried task computes the same ones. All accounts take this path, whatever
their size.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1_000_000
# evenly filled parts of the ids, a power of two, and the accuracy of their bounds
PARTS, ACCURACY = 1024, 20_000
_BEFORE = (Window.unboundedPreceding, -1)
# rows without an id sort first, and so does their block
_NO_ID = -1


def _blocked(rows: DataFrame, order_id: str, block_rows: int) -> DataFrame:
    """``rows`` with ``_block``, the block of a row's id, from 0."""
    shares = [k / PARTS for k in range(1, PARTS)]
    ids = F.col(order_id)
    cuts = rows.agg(F.struct(F.count(ids).alias("n"), F.percentile_approx(ids, shares, ACCURACY).alias("at")).alias("v")).scalar()
    blocks = F.least(F.ceil(F.col("_cuts.n") / F.lit(block_rows)), F.lit(PARTS))
    # binary search: the number of cuts that are not above the id
    halves = F.array(*[F.lit(PARTS >> k) for k in range(1, PARTS.bit_length())])
    step = lambda at, half: at + F.when(F.get(F.col("_cuts.at"), at + half - 1) <= ids, half).otherwise(F.lit(0))
    part = F.aggregate(halves, F.lit(0), step)
    block = F.when(ids.isNull(), F.lit(_NO_ID)).when(blocks > 1, F.floor(part * blocks / PARTS)).otherwise(F.lit(0))
    return rows.withColumn("_cuts", cuts).withColumn("_block", block.cast("bigint")).drop("_cuts")


def running_total(
    rows: DataFrame,
    amount: Column,
    out: str,
    *,
    account: list[str] = (),
    day: str,
    order_id: str,
    before_id: list[str] = (),
    after_id: list[str] = (),
    share_ties: bool = False,
    no_day: dt.date = dt.date(9999, 12, 31),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``out``: the sum of ``amount`` up to each row, per account.

    Order is ``day, before_id..., order_id, after_id...``; ``no_day`` stands in
    for a missing day. ``share_ties`` gives rows equal in the whole order the
    same total (RANGE frame); otherwise each row counts separately (ROWS).
    Missing accounts, ``before_id`` values and ids are values like others.
    """
    account, before_id, after_id = list(account), list(before_id), list(after_id)
    # keys that are never NULL, so that the join and the window share one shuffle of the rows
    named = {f"_k{i}": F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for i, c in enumerate([*account, *before_id])}
    own, keys = list(named)[: len(account)], [*named, "_day", "_block"]
    keyed = _blocked(rows, order_id, block_rows).withColumns(
        {**named, "_amount": amount, "_day": F.coalesce(F.col(day), F.lit(no_day))}
    )
    order = [F.col("_day"), *map(F.col, before_id), F.col(order_id), *map(F.col, after_id)]
    window = Window.partitionBy(*keys).orderBy(*order)
    if not share_ties:
        window = window.rowsBetween(Window.unboundedPreceding, 0)
    starts = _slice_starts(keyed, own, keys, before_id)
    total = F.coalesce(F.sum("_amount").over(window), F.lit(0)) + F.coalesce(F.col("_start"), F.lit(0))
    return keyed.join(starts, keys, "left").withColumn(out, total).select(*rows.columns, out)


def _slice_starts(keyed: DataFrame, own: list[str], keys: list[str], before_id: list[str]) -> DataFrame:
    """Per slice, the sum of all earlier slices of its account."""
    slices = keyed.groupBy(*keys, *before_id).agg(F.sum("_amount").alias("_sum"))
    days = slices.groupBy(*own, "_day").agg(F.sum("_sum").alias("_sum"))
    by_day = Window.partitionBy(*own).orderBy("_day").rowsBetween(*_BEFORE)
    days = days.select(*own, "_day", F.sum("_sum").over(by_day).alias("_day_start"))
    in_day = Window.partitionBy(*own, "_day").orderBy(*before_id, "_block").rowsBetween(*_BEFORE)
    starts = slices.withColumn("_in_day", F.sum("_sum").over(in_day)).join(days, [*own, "_day"])
    return starts.select(*keys, (F.coalesce("_day_start", F.lit(0)) + F.coalesce("_in_day", F.lit(0))).alias("_start"))


def numbered(
    rows: DataFrame, out: str, *, group: list[str], order_id: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Number rows 1, 2, ... per group in ``order_id`` order, for few and large groups.

    Blocks of ids are those of running_total; a row without an id comes first.
    """
    keyed = _blocked(rows, order_id, block_rows)
    blocks = keyed.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(*_BEFORE)
    starts = blocks.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    in_block = Window.partitionBy(*group, "_block").orderBy(order_id)
    return (
        keyed.join(starts, [*group, "_block"])
        .withColumn(out, F.row_number().over(in_block) + F.col("_start"))
        .select(*rows.columns, out)
    )
