"""Packing into optimal length buckets.

The global histogram of lengths up to the token budget has one entry per length, so
it is bounded by the budget whatever the number of documents. Dynamic programming over
it finds the bucket bounds with the least padding; inside each bucket, documents form
batches of as many rows as the token budget allows. Longer documents are batches of
their own and need no bounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm import common

BUCKETS = 16
TOKEN_BUDGET = 16_384


def _next(least: np.ndarray, lengths: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best, where): the least cost of the first j entries with one more bucket, and the entry it starts at.

    The best start never falls as j grows, so the ranges searched for the middles of all
    gaps of one level hold together little more than one entry each.
    """
    m = len(lengths)
    best, where = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    lo, hi = np.array([1]), np.array([m])  # gaps not settled yet
    first, last = np.array([0]), np.array([m - 1])  # where their best starts lie
    while len(lo):
        j = (lo + hi) // 2
        size = np.minimum(last, j - 1) - first + 1
        ends = np.cumsum(size)
        i = np.arange(ends[-1]) - np.repeat(ends - size - first, size)
        of = np.repeat(j, size)
        cost = least[i] + lengths[of - 1] * (n[of] - n[i]) - (t[of] - t[i])
        best[j] = np.minimum.reduceat(cost, ends - size)
        hits = np.flatnonzero(cost == np.repeat(best[j], size))
        where[j] = i[hits[np.searchsorted(hits, ends - size)]]
        lo, hi, first, last = (np.concatenate(c) for c in ((lo, j + 1), (j - 1, hi), (first, where[j]), (where[j], last)))
        some = lo <= hi
        lo, hi, first, last = lo[some], hi[some], first[some], last[some]
    return best, where


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most ``buckets`` buckets, ascending, with the least total padding.

    cost(i, j) is what padding entries i..j-1 to the length of entry j-1 adds; least[k][j] is the least cost
    of the first j entries in k buckets.
    """
    m = len(lengths)
    if not m:
        return np.zeros(0, np.int64)
    n, t = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    least = np.concatenate([[0], lengths]) * n - t
    cut = [np.zeros(m + 1, np.int64)]
    for _ in range(min(buckets, m) - 1):
        least, where = _next(least, lengths, n, t)
        cut.append(where)
    out, j = [], m
    for where in reversed(cut):
        if not j:
            break
        out.append(int(lengths[j - 1]))
        j = int(where[j])
    return np.array(sorted(set(out)), dtype=np.int64)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, bucket, bucket_length, batch, place, padding, oversize.

    Tokens are words. A batch holds max(1, budget // bucket_length) rows of its bucket, the last one of a
    bucket perhaps fewer. The buckets have the least total padding. A document longer than the budget is whole,
    in a batch of its own without padding, marked ``oversize``; such documents share the bucket number after the
    last one. A null or blank text has no tokens and is packed nowhere: bucket, batch and place are null.
    Repeated rows are packed one by one. ``batch`` is unique over all buckets. Empty tables give empty results.
    """
    words = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit(common.WORD))).cast("long")
    rows = common.stored(common.id_and_text(docs).select("doc_id", words.alias("n_tokens"), F.crc32(F.col("text").cast("binary")).alias("crc")), "packing-lengths")
    full = rows.where("n_tokens > 0")
    histogram = full.where(F.col("n_tokens") <= budget).groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()
    tops = bounds(np.array([r.n_tokens for r in histogram], np.int64), np.array([r.n for r in histogram], np.int64), buckets).tolist()
    edges = F.array(*[F.lit(x) for x in tops]).cast("array<long>")
    bucket = F.size(F.filter(edges, lambda e: e < F.col("n_tokens")))
    placed = full.withColumn("bucket", bucket).withColumn("bucket_length", F.coalesce(F.get(edges, F.col("bucket")), F.col("n_tokens")))
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length"))).cast("long")
    # rows of one length are spread over blocks; order within a bucket is by hash, so batches mix sources
    placed = common.numbered(placed.withColumn("h", F.xxhash64("doc_id", "crc")), ["bucket"], ["h", "doc_id", "crc", "n_tokens"], "row")
    sizes = placed.groupBy("bucket").agg(F.first(per_batch).alias("m"), F.count("*").alias("n")).orderBy("bucket").collect()
    if not sizes:
        nothing = {"bucket": "int", "bucket_length": "long", "batch": "long", "place": "long", "padding": "long", "oversize": "boolean"}
        return rows.drop("crc").withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    start, first = 0, {}
    for r in sizes:
        first[r.bucket], start = start, start + -(-r.n // r.m)
    starts = F.create_map(*[F.lit(v) for pair in first.items() for v in pair])
    out = placed.withColumn("m", per_batch).select(
        "doc_id", "n_tokens", "bucket", "bucket_length", (starts[F.col("bucket")] + F.floor(F.col("row") / F.col("m"))).cast("long").alias("batch"),
        F.pmod("row", "m").cast("long").alias("place"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"), (F.col("bucket_length") > budget).alias("oversize"),
    )
    return out.unionByName(rows.where("n_tokens = 0").select("doc_id", "n_tokens"), allowMissingColumns=True)
