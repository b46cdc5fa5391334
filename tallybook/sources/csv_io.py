"""Typed CSV export and import."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.books import Books
from tallybook.functions.catalogue import ARCHIVE, BY_NAME, CATALOGUE, DATED
from tallybook.functions.coerce import is_blank
from tallybook.functions.modules import MODULES
from tallybook.operators.keyed import first_per_key
from tallybook.plans.close import in_range
from tallybook.plans.sales import unify_sales

# written with a mark for NULL, so that an empty text survives the round trip;
# blanks at the ends of a text and line breaks inside it are kept
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
# a file with line breaks in texts is read by one task, so its size is bounded when written
WRITE_OPTIONS = {**CSV_OPTIONS, "maxRecordsPerFile": "1000000"}
READ_OPTIONS = {**CSV_OPTIONS, "multiLine": "true"}
MILLIS_2000 = 946_684_800_000
_NESTED = (T.ArrayType, T.StructType, T.MapType)


def as_text(frame: DataFrame, upper_flag: bool = False, fill_delete_flag: bool = False) -> DataFrame:
    """Every column as text: nested values as JSON, booleans as true/false (or TRUE/FALSE for the delete flag)."""
    columns = []
    for f in frame.schema.fields:
        value = F.col(f.name)
        if isinstance(f.dataType, _NESTED):
            value = F.to_json(value)
        elif isinstance(f.dataType, T.BooleanType):
            if fill_delete_flag and "delete" in f.name.lower():
                value = F.coalesce(value, F.lit(False))
            if upper_flag and f.name == "is_deleted":
                value = F.upper(F.coalesce(value, F.lit(False)).cast("string"))
        columns.append(value.cast("string").alias(f.name))
    return frame.select(*columns)


MANIFEST = "table_name string, schema string, null_mark string, row_count bigint"


def _export(books: Books, frames: dict[str, DataFrame], path: str, **flags) -> DataFrame:
    """One CSV folder per table and, last, the manifest, which is what makes the export one that can be opened."""
    spark = next(iter(frames.values())).sparkSession
    rows = []
    for name, frame in frames.items():
        as_text(frame, **flags).write.options(**WRITE_OPTIONS).csv(f"{path}/{name}")
        written = read_text(spark, f"{path}/{name}", frame.columns)
        rows.append((name, frame.schema.json(), CSV_OPTIONS["nullValue"], written.count()))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def export_range(books: Books, start: dt.date, end: dt.date, path: str) -> DataFrame:
    """Write the rows dated in the range of every dated table, and the archive tables whole; returns the manifest."""
    frames = {t.name: getattr(books, t.frame).where(in_range(t.frame, start, end)) for t in DATED}
    return _export(books, frames | {t.name: getattr(books, t.frame) for t in ARCHIVE}, path, fill_delete_flag=True)


def export_full(books: Books, path: str, tables: list[str] | None = None) -> DataFrame:
    """Write every table of the books, or the named ones; returns the manifest."""
    wanted = [BY_NAME[t] for t in tables] if tables else CATALOGUE
    return _export(books, {t.name: getattr(books, t.frame) for t in wanted}, path, upper_flag=True)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, schema, null_mark, row_count) of an export; an export that died has none."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def open_export(spark: SparkSession, path: str) -> Books:
    """Books over an export of export_full() or export_range(), under the schemas of its manifest.

    Every part file is a task of its own; nested columns come back as they were.
    """
    books = Books()
    for row in manifest(spark, path).collect():
        schema = T.StructType.fromJson(json.loads(row.schema))

        def read(name: str = row.table_name, schema: T.StructType = schema, mark: str = row.null_mark) -> DataFrame:
            return import_typed(read_text(spark, f"{path}/{name}", schema.names, mark), schema, keep_empty=True)

        books.define(BY_NAME[row.table_name].frame, read)
    if all(m.table in books for m in MODULES):
        books.define("sales", lambda: unify_sales({m.table: getattr(books, m.table) for m in MODULES}))
    return books


def read_text(spark: SparkSession, path: str, columns: list[str], null_mark: str = CSV_OPTIONS["nullValue"]) -> DataFrame:
    """A CSV folder with every column as text, under a given schema."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(**READ_OPTIONS).option("nullValue", null_mark).csv(path)


def with_position(rows: DataFrame, name: str = "position") -> DataFrame:
    """Rows of read_text() with their place in the import: by file, then within it."""
    # the lower bits count the rows of a task, which reads a file with line breaks from its start
    return rows.withColumn(name, F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")))


def _from_millis(millis: Column, kind: T.DataType) -> Column:
    """UTC wall-clock time of an epoch stamp, whatever the session time zone."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_millis(millis)
    epoch = F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz")
    seconds = (millis.cast("decimal(18,3)") / F.lit(1000)).cast("decimal(18,6)")
    return (epoch + F.make_dt_interval(secs=seconds)).cast(kind)


def _typed(column: str, kind: T.DataType, merge: bool, keep_empty: bool) -> Column:
    raw = F.col(column)
    text = raw if keep_empty and isinstance(kind, T.StringType) else F.nullif(raw, F.lit(""))
    if isinstance(kind, T.BooleanType):
        if column == "is_deleted" and not merge:
            return F.coalesce(F.upper(raw) == "TRUE", F.lit(False))
        return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        digits = text.rlike(r"^\d+$") & (text.try_cast("bigint") > MILLIS_2000)
        if not merge:
            digits = text.rlike(r"^\d{13}$")
        return F.when(digits, _from_millis(text.try_cast("bigint"), kind)).otherwise(text.try_cast(kind))
    if isinstance(kind, _NESTED):
        # an empty cell is an empty object, which as a list has no elements
        if isinstance(kind, T.ArrayType):
            return F.when(F.ltrim(column).startswith("["), F.from_json(raw, kind))
        return F.from_json(F.when(is_blank(column), F.lit("{}")).otherwise(raw), kind)
    return text if isinstance(kind, T.StringType) else text.try_cast(kind)


def import_typed(rows: DataFrame, schema: T.StructType, merge: bool = False, keep_empty: bool = False) -> DataFrame:
    """Text columns to their schema types; a cell that does not parse is NULL.

    The schema decides what is a date, a number or nested, not the column name.
    An empty cell is NULL; ``keep_empty`` keeps it in text columns, for files
    that mark NULL themselves. Millisecond stamps are recognised in date
    columns: 13 digits, or for a merge any number after the year 2000.
    """
    return rows.select(
        *[_typed(f.name, f.dataType, merge, keep_empty).alias(f.name) for f in schema.fields if f.name in rows.columns]
    )


def merge_import(current: DataFrame, rows: DataFrame, table: str = "", position: str | None = None) -> DataFrame:
    """``current`` plus imported rows whose key it lacks.

    The key is ``id``; without one it is ``ref_no``, except for customer
    payments, which then have no key and are all added. Of rows that repeat a
    key the first by ``position`` (see with_position) is added, without one the
    first in the order of their other columns.
    """
    order = [F.col(position)] if position else []
    given = [c for c in rows.columns if c != position]
    if "id" in rows.columns:
        key = "id"
    elif "ref_no" in rows.columns and table != "customer_payments":
        key = "ref_no"
    else:
        return current.unionByName(rows.select(*given), allowMissingColumns=True)
    known = rows.where(F.col(key).isNotNull())
    fresh = first_per_key(known, [key], *order, *[F.col(c) for c in given if c != key]).join(current.select(key), key, "left_anti")
    fresh = fresh.unionByName(rows.where(F.col(key).isNull()))
    return current.unionByName(fresh.select(*given), allowMissingColumns=True)
