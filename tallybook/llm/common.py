"""What several operators share: tables, byte access, hashing, row numbers, connected components."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallybook.session import scratch_path, ship

# Bytes of text that one vectorised step works on, in some hundred bytes of memory each; a longer document is one step of its own.
BLOCK_BYTES = 1 << 17
# Bytes of rows handed to a Python worker at once; by default these are 10,000 rows of any length, which Spark and the worker both hold.
BATCH_BYTES = 1 << 22
# Bytes of a piece of a long text.
PIECE_BYTES = 1 << 20
# ASCII whitespace as the word pattern [^\x20\x09-\x0D]+ sees it.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_python(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow() in batches of about BATCH_BYTES, or as the session says if it names a limit; a longer row is a batch of its own."""
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(limit, None) is None:
        conf.set(limit, str(BATCH_BYTES))
    return df.mapInArrow(step, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read back; cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables made by stored() that no later step reads, and let Spark clear the shuffle files of ended jobs."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` of a few numbers a row, marked for broadcast if it has at most ``most`` rows; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator works on, so that others cannot clash with its own names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def unused(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(docs: DataFrame, name: str = "row") -> Column:
    """Whole rows as one struct, so that no column can clash with the names an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def unpacked(rows: DataFrame, docs: DataFrame, name: str = "row") -> DataFrame:
    """The columns of ``docs`` back from packed() rows."""
    return rows.select(*[F.col(f"{name}.`{c}`") for c in docs.columns])


def id_crc(name: str = "doc_id") -> Column:
    return F.crc32(F.col(name).cast("string").cast("binary"))


def held_out(modulus: int, remainder: int) -> Column:
    """True for rows that labels are never learned from; rows without an id are such rows too."""
    return F.coalesce(F.pmod(id_crc(), F.lit(modulus)) == remainder, F.lit(True))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """All rows, or about ``most`` of them chosen by a hash of ``key``; the same ones in every run."""
    n = df.count()
    if n <= most:
        return df
    buckets = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(buckets)) < int(buckets * most / n))


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """One row per doc_id with the largest of its labels; rows without id or label are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return rows.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))


# ---- bytes and hashes in numpy ------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def seeds(n: int, start: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(start)
    return mix(base) | np.uint64(1)


BYTE_VALUE = seeds(256, 1)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows; null is empty."""
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def lots(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, for steps that hold several times what a batch has; none is empty."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def words(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, length in bytes) of each word, in text order; ``fold`` lower-cases A-Z."""
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(data):
        return nothing
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    if not len(start):
        return nothing
    counts = np.cumsum(inside)
    first = counts[start] - 1
    length = np.diff(np.append(first, counts[-1]))
    value = BYTE_VALUE[LOWER[data[inside]] if fold else data[inside]]
    place = np.arange(len(value)) - np.repeat(first, length)
    powers = np.full(int(length.max()), 0x9E3779B97F4A7C15 | 1, dtype=np.uint64)
    powers[0] = 1
    value *= np.cumprod(powers)[place]
    hashes = mix(np.add.reduceat(value, first) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(offsets, start, "right") - 1, length


_GAP = re.compile(rb"[ \t-\r]")


def pieces(data: bytes, step: int = PIECE_BYTES) -> Iterator[bytes]:
    """``data`` in consecutive parts of about ``step`` bytes, cut at white space; a longer word stays whole."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + step) if at + step < len(data) else None
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def per_document(doc: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each document in an array sorted by document."""
    return np.searchsorted(doc, np.arange(n + 1))


# ---- distributed row numbers and components -----------------------------------------------------------------


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str, block_rows: int = 20_000) -> DataFrame:
    """Gapless numbers from 0 in each group, without handing a group to one task.

    Rows are dealt to blocks by a hash of ``order``; a block is numbered by a window
    of its own and starts after the rows of the blocks before it.
    """
    blocks = max(64, -(-df.count() // block_rows))
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    key = [*groups, "_block"]
    counts = dealt.groupBy(*key).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*groups).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return dealt.withColumn("_row", within).join(starts, key).withColumn(name, F.col("_start") + F.col("_row") - 1).drop("_block", "_row", "_start")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b), for nodes that have an edge.

    Alternating stars: every node hands its larger neighbours, then its smaller
    ones, to its smallest neighbour, until the edges are stars around the roots.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        before, now = now, stored(moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label)
        drop(before)
