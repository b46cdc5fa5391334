"""Keyed changes of a table: upsert, flag flips, removals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key (pruned per task before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def upsert(
    current: DataFrame,
    changes: DataFrame,
    keys: list[str],
    *,
    update: list[str],
    force: Mapping[str, Column] | None = None,
    insert: bool = True,
    order: list[Column] | None = None,
    unique: bool = False,
) -> DataFrame:
    """``current`` with ``update`` columns taken from the change of the same key.

    Of changes that repeat a key the first by ``order`` counts (of equal ones
    the one whose update columns sort first), so a key never multiplies; a change without a key is a new row.
    ``unique`` says that changes repeat no key. ``force`` sets columns on every changed row. Unmatched changes are
    appended (``insert``), with NULL in columns they lack.

    Both inputs are read once: one full join puts known rows and new ones out together. Without ``insert`` it is a
    left join, whose small side Spark may broadcast.
    """
    force = dict(force or {})
    if not unique:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or []), *[F.col(c) for c in update]))
        keyless = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
        changes = changes.withColumn("_rn", rank).where((F.col("_rn") == 1) | keyless).drop("_rn")
    given = [c for c in current.columns if c in changes.columns]
    renamed = changes.select(*[F.col(c).alias(f"_new_{c}") for c in given], F.lit(True).alias("_hit"))
    same = [F.col(k) == F.col(f"_new_{k}") for k in keys]
    merged = current.withColumn("_known", F.lit(True)).join(renamed, same, "full" if insert else "left")
    columns = []
    for c in current.columns:
        new = F.col(f"_new_{c}") if c in given else F.lit(None)
        if c in force:
            value = F.when(F.col("_hit"), force[c]).otherwise(F.col(c))
        elif c in update:
            value = F.when(F.col("_hit"), new).otherwise(F.col(c))
        else:
            value = F.when(F.col("_known"), F.col(c)).otherwise(new)
        columns.append(value.cast(current.schema[c].dataType).alias(c))
    return merged.select(*columns)


def set_flag(rows: DataFrame, keys: DataFrame, key: list[str], flag: str, value: bool) -> DataFrame:
    """Set a boolean on the rows whose key is listed."""
    listed = keys.select(*key).distinct().withColumn("_hit", F.lit(True))
    return (
        rows.join(listed, key, "left")
        .withColumn(flag, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(flag)))
        .select(*rows.columns)
    )


def remove(rows: DataFrame, keys: DataFrame, key: list[str], only: Column | None = None) -> DataFrame:
    """Drop the listed rows; with ``only``, just those of them that satisfy it.

    A row ``only`` is not true for is kept, also when it is unknown.
    """
    listed = keys.select(*key).distinct().withColumn("_hit", F.lit(True))
    doomed = F.col("_hit").isNotNull()
    if only is not None:
        doomed = doomed & F.coalesce(only, F.lit(False))
    return rows.join(listed, key, "left").where(~doomed).select(*rows.columns)
