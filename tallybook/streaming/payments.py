"""Payment intake as Structured Streaming jobs, each agreeing with its batch twin.

No job drops a late row. Requests are told apart by what has landed, sums are kept in
keyed state: one row per reference, or per day and source. Every micro-batch writes to
a folder of its own, so a replayed batch replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.coerce import MONEY, lowered, or_zero, total
from tallybook.functions.status import sale_payment_status
from tallybook.operators.keyed import first_per_key
from tallybook.plans.intake import accepted, checked
from tallybook.plans.sales import active, of_module, walk_in

LANDED = (
    f"request_id bigint, kind string, party string, amount {MONEY}, entry_date date, payment_method string,"
    " bank_profile_id bigint, type string, note string, sent_at timestamp, late boolean"
)
STATUS = "ref_no string, payment_status string"
FLOW = "day date, source string, net decimal(20,2), entries bigint, last_at timestamp_ntz"


def _batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the batches of a job have written, with the batch of each row."""
    return spark.read.schema(f"{schema}, batch bigint").option("basePath", path).parquet(f"{path}/batch=*")


def _started(spark: SparkSession, path: str, schema: str) -> None:
    """An empty batch and an empty summary, so that readers find the folder before the first rows."""
    for folder in ("batch=-1", "upto=-1"):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{folder}")


def _follow(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


# requests


def landing_writer(suppliers: DataFrame | None, path: str, delay: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: land the requests that have not landed yet, however late they come.

    The batch is the small side: history is read by its ids alone and is not shuffled. Rows sent more than
    ``delay`` before the newest one landed so far are marked, and written again to ``<path>-late``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        landed = _batches(spark, path, "request_id bigint, sent_at timestamp").where(F.col("batch") < batch_id)
        asked = first_per_key(batch, ["request_id"], F.col("sent_at"))
        known = landed.join(F.broadcast(asked.select("request_id")), "request_id", "left_semi").select("request_id")
        fresh = asked.join(known, "request_id", "left_anti")
        newest = landed.agg(F.max("sent_at").alias("v")).scalar()
        late = F.coalesce(F.col("sent_at") < newest - F.expr(f"interval {delay}"), F.lit(False))
        rows = accepted(checked(fresh, suppliers)).join(asked.select("request_id", "sent_at"), "request_id")
        folder = f"{path}/batch={batch_id}"
        rows.withColumn("late", late).write.mode("overwrite").parquet(folder)
        written = spark.read.schema(LANDED).parquet(folder)
        written.where("late").write.mode("overwrite").parquet(f"{path}-late/batch={batch_id}")

    return write


def land_requests(requests: DataFrame, suppliers: DataFrame | None, path: str, checkpoint: str, delay: str = "1 day"):
    """Validated requests, each request_id once for good; ``requests`` needs an event time ``sent_at``."""
    _started(requests.sparkSession, path, LANDED)
    return _follow(requests, landing_writer(suppliers, path, delay), checkpoint)


def landed_requests(spark: SparkSession, path: str) -> DataFrame:
    return _batches(spark, path, LANDED).drop("batch")


# status of paid references


def paid_so_far(payments: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """(ref_no, total_paid): on a stream, keyed state with one row per reference."""
    return payments.groupBy("ref_no").agg(total("amount").alias("total_paid"))


def status_writer(
    sales: Callable[[], DataFrame], path: str, opening: DataFrame | None = None
) -> Callable[[DataFrame, int], None]:
    """foreachBatch body for changed sums of paid_so_far(): the status of their refs.

    ``sales`` is asked anew in each batch, so that sales entered meanwhile count. ``opening`` holds
    (ref_no, total_paid) of payments made before the stream began. No payment file is read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        paid = batch.where(of_module(F.col("ref_no")))
        if opening is not None:
            before = opening.select("ref_no", F.col("total_paid").alias("_before"))
            paid = paid.join(before, "ref_no", "left").withColumn("total_paid", F.col("total_paid") + or_zero("_before"))
        sold = active(sales()).where(walk_in()).join(paid.select("ref_no"), "ref_no", "left_semi")
        sold = sold.groupBy("ref_no").agg(total("total_pkr").alias("total_sale"))
        status = sale_payment_status(or_zero("total_sale"), or_zero("total_paid"))
        rows = paid.join(sold, "ref_no", "left").select("ref_no", status.alias("payment_status"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def follow_status(
    payments: DataFrame,
    sales: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    opening: DataFrame | None = None,
):
    _started(payments.sparkSession, path, STATUS)
    return _follow(paid_so_far(payments), status_writer(sales, path, opening), checkpoint, "update")


# latest rows by key


def _latest(spark: SparkSession, path: str, schema: str, keys: list[str]) -> tuple[DataFrame, int]:
    """The newest row of each key, from the last summary and the batches after it, and the last batch."""
    summaries = spark.read.schema(f"{schema}, upto bigint").option("basePath", path).parquet(f"{path}/upto=*")
    # both are read from the names of folders
    upto = max(r[0] for r in summaries.select("upto").distinct().collect()) if summaries.limit(1).count() else -1
    rows = _batches(spark, path, schema).where(F.col("batch") > upto)
    if upto >= 0:
        rows = rows.unionByName(summaries.where(F.col("upto") == upto).withColumnRenamed("upto", "batch"))
    last = rows.agg(F.max("batch")).first()[0]
    return first_per_key(rows, keys, F.desc("batch")).drop("batch"), -1 if last is None else last


def compact(spark: SparkSession, path: str, schema: str, keys: list[str]) -> int:
    """Write the newest row of each key apart, so that later reads skip the batches before; returns the last batch."""
    rows, last = _latest(spark, path, schema, keys)
    if last >= 0:
        rows.write.mode("overwrite").parquet(f"{path}/upto={last}")
    return last


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """The latest status written for each ref."""
    return _latest(spark, path, STATUS, ["ref_no"])[0]


# daily cash flow


def daily_cash_flow(flows: DataFrame, stamp: str = "ts") -> DataFrame:
    """Signed amount per day and source, on a stream or a batch.

    On a stream the state has one row per day and source and is never dropped, so a row of any age counts.
    """
    at = F.col(stamp).cast("timestamp_ntz")
    return flows.groupBy(F.to_date(at).alias("day"), "source").agg(
        total("amount").alias("net"), F.count("*").alias("entries"), F.max(at).alias("last_at")
    )


def flow_writer(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: the days that the batch has changed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def follow_flow(flows: DataFrame, path: str, checkpoint: str):
    _started(flows.sparkSession, path, FLOW)
    return _follow(daily_cash_flow(flows), flow_writer(path), checkpoint, "update")


def current_flow(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    """(day, source, net, entries, is_open) of all days so far; a day is open until ``delay`` after its end."""
    rows = _latest(spark, path, FLOW, ["day", "source"])[0]
    newest = rows.agg(F.max("last_at").alias("v")).scalar()
    end = F.date_add("day", 1).cast("timestamp_ntz")
    return rows.select("day", "source", "net", "entries", (end > newest - F.expr(f"interval {delay}")).alias("is_open"))


def signed_flow(source: Column, amount: Column) -> Column:
    """Customers and deposits bring money in, everything else takes it out."""
    return F.when(lowered(source).isin("customer", "deposit"), amount).otherwise(-amount).cast(MONEY)
