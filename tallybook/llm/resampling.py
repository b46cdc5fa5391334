"""Resampling documents towards a target distribution, by importance weights on hashed words.

Every word falls into one of 10,000 buckets. A bucket's gain is the logarithm of its share in the target
against its share in the documents; a document's weight is the mean gain of its words, and adding Gumbel
noise to it and taking the highest sums draws documents without putting any back.

Buckets are arrays, one a document, written once: the counts are array sums per task, the weights array
lookups. The scores are ranked by a least-significant-digit radix sort: each pass is a stable counting sort
by one digit of (score, id). Rows lie in blocks of consecutive places; counts per digit and block, summed
over smaller digits and earlier blocks, give every row its place after the pass.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallybook.llm import common

BUCKETS = 10_000
ORDER = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
# Bits of one digit of the sort: a pass sums at most 2 ** DIGIT totals in one task.
DIGIT = 12
BLOCK_ROWS = 1_000_000
# Words whose buckets a task remembers.
REMEMBERED = 1_000_000
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lowered: all other bytes below 128 part words
SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Buckets(dict):
    """Bucket of each feature, worked out when first met."""

    def __missing__(self, feature: bytes) -> int:
        bucket = self[feature] = zlib.crc32(feature) % BUCKETS
        return bucket


def _runs(words: list[bytes], order: int, fresh: int) -> list[bytes]:
    """Runs of 1 to ``order`` words that end within the last ``fresh`` words."""
    out = words[len(words) - fresh :]
    for k in range(2, order + 1):
        out = out + [b" ".join(words[e - k : e]) for e in range(max(k, len(words) - fresh + 1), len(words) + 1)]
    return out


def _featured(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for batch in batches:
            found, n_words = [], []
            for text in batch.column("text").cast(pa.large_string()).cast(pa.large_binary()):
                parts, tail, n = [], [], 0
                for piece in common.pieces((text.as_py() or b"").translate(SPACED)):
                    words = piece.split()
                    features = _runs(tail + words, order, len(words))
                    parts.append(np.fromiter(map(known.__getitem__, features), np.int16, len(features)))
                    tail = (tail + words)[len(tail) + len(words) - order + 1 :] if order > 1 else []
                    n += len(words)
                    if len(known) > REMEMBERED:
                        known.clear()
                found.append(np.concatenate(parts) if parts else np.zeros(0, np.int16))
                n_words.append(n)
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int16), *found])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), lists], names=["doc_id", "n_words", "buckets"])

    return run


def features(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, buckets): the buckets of all runs of 1 to ``order`` words of each whole text."""
    # a task hands over as many rows as it takes, so rows need not be put together again
    return common.id_and_text(docs).mapInArrow(_featured(order), "doc_id long, n_words long, buckets array<smallint>")


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        counts += np.bincount(batch.column("buckets").flatten().to_numpy(), minlength=BUCKETS)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])


def counts(featured: DataFrame) -> np.ndarray:
    """Features in each bucket over all documents: BUCKETS numbers, whatever the size of the corpus."""
    rows = featured.select("buckets").mapInArrow(_tallied, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln of share in the target against share in the documents), each bucket counted once more than it occurs."""
    s_all, t_all = float(have.sum()), float(want.sum())
    up, down = (want + 1.0) * (s_all + BUCKETS), (have + 1.0) * (t_all + BUCKETS)
    return np.array([math.floor(1000 * math.log(x)) for x in up / down], dtype=np.int64)


def _weighed(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            offsets = lists.offsets.to_numpy()
            summed = np.append(0, np.cumsum(gain[lists.flatten().to_numpy()]))
            n = np.diff(offsets).astype(np.int64)
            weight = (summed[offsets[1:] - offsets[0]] - summed[offsets[:-1] - offsets[0]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def _noise(seed: int) -> Column:
    """floor(1000 * a Gumbel number) drawn by a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


# ---- least-significant-digit radix sort ---------------------------------------------------------------------


def digits_of(rows: DataFrame, keys: list[str]) -> list[Column]:
    """Digits of the keys, the last key's lowest first; keys are longs, compared as signed numbers.

    One pass over the rows finds the range of each key, and so the bits that tell rows apart.
    """
    ends = rows.agg(*[F.struct(F.min(k), F.max(k)) for k in keys]).first()
    digits = []
    for key, (least, most) in reversed(list(zip(keys, ends))):
        wide = least is not None and most - least >= 2**63
        # a range that a long cannot hold: with the sign bit turned, signed order is the order of the unsigned bits
        value = F.col(key).bitwiseXOR(F.lit(-(2**63))) if wide else F.col(key) - F.lit(least or 0)
        bits = 64 if wide else ((most or 0) - (least or 0)).bit_length()
        n = -(-bits // DIGIT)
        width = -(-bits // n) if n else 0
        digits += [F.shiftrightunsigned(value, k * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for k in range(n)]
    return digits


def _counting_sort(rows: DataFrame, digit: Column, block: Column, at: str) -> DataFrame:
    """``rows`` with ``at`` replaced by the place after a stable sort by ``digit``; ``block`` parts the places into runs."""
    dealt = rows.withColumns({"_digit": digit, "_block": block})
    cells = dealt.groupBy("_digit", "_block").agg(F.count("*").alias("_n"))
    earlier = (W.unboundedPreceding, -1)
    totals = cells.groupBy("_digit").agg(F.sum("_n").alias("_n"))
    totals = totals.select("_digit", F.coalesce(F.sum("_n").over(W.orderBy("_digit").rowsBetween(*earlier)), F.lit(0)).alias("_smaller"))
    blocks = F.coalesce(F.sum("_n").over(W.partitionBy("_digit").orderBy("_block").rowsBetween(*earlier)), F.lit(0))
    starts = cells.select("_digit", "_block", blocks.alias("_earlier")).join(totals, "_digit").select("_digit", "_block", (F.col("_smaller") + F.col("_earlier")).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_digit", "_block").orderBy(at))
    placed = dealt.withColumn("_inside", inside).join(starts, ["_digit", "_block"])
    return placed.withColumn(at, F.col("_start") + F.col("_inside") - 1).select(*rows.columns)


def radix_placed(rows: DataFrame, keys: list[str], at: str, label: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``at``, their place from 0 in the order of ``keys`` (longs without nulls); equal rows in any order.

    A block has at most ``block_rows`` rows, and there are some for every shuffle partition, so that a task
    holds no more than a few blocks whatever the digits are.
    """
    now = common.stored(rows.withColumn(at, F.monotonically_increasing_id()), label)
    n = now.count()
    least = 4 * int(now.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, -(-n // block_rows))
    passes = digits_of(now, keys) or [F.lit(0)]
    for k, digit in enumerate(passes):
        # the first numbers are unique but not gapless: a hash deals them to blocks
        block = F.floor(F.col(at) * blocks / n) if k else F.pmod(F.xxhash64(at), F.lit(blocks))
        before, now = now, common.stored(_counting_sort(now, digit, block.cast("long"), at), label)
        common.drop(before)
    return now


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, order: int = ORDER, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    ``rank`` is 1, 2, 3... for the drawn documents, from the highest score down, ties by the smaller id, and
    null for the others. Drawn are floor(percent * n / 100) of the n documents with an id and ``least_words``
    words or more. A null or blank text has no words and weight 0. A row without an id has no score and is not
    drawn. Repeated rows count each; those that agree in score and id are ranked in any order. A text of any
    length is read in pieces. Other columns of either table are not read. Empty tables: no documents give no
    rows, no target texts give gains against an even spread.
    """
    label = "resampling"
    featured = common.stored(features(docs, order), label)
    want = counts(features(target.select(F.lit(0).alias("doc_id"), "text"), order))
    gain = gains(counts(featured), want)
    scored = featured.mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = common.stored(scored.withColumn("score", F.col("weight") + _noise(seed)), label)
    common.drop(featured)
    able = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    entered = scored.where(able).withColumn("_down", -F.col("score"))
    placed = radix_placed(entered, ["_down", "doc_id"], "_at", label)
    most = percent * placed.count() // 100
    ranked = placed.withColumn("rank", F.when(F.col("_at") < most, F.col("_at") + 1)).drop("_down", "_at")
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **sizes) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, with their columns as they are."""
    ids = resample(docs, target, **sizes).where("rank is not null").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    kept = rows.join(ids, F.col("row.doc_id") == F.col("id"), "left_semi")
    return kept.select("row.*")
