"""Which filters remove which documents, in every order of the filters, with duplicates found by radix tries.

Texts are dealt to ranges by adaptive prefixes. Each task puts the whole texts of its ranges into compressed
tries that hold the least id at each terminal; a walk over the terminals flags the documents whose text a
smaller id has. A document's failures are a mask of five bits; the counts of masks, at most 32 a part, give
what each filter removes at each step of each order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm import common, tries

FILTERS = "ABCDE"
A, B, C, D, E = (1 << k for k in range(len(FILTERS)))
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
CAPITALS_PERCENT = 10
CAPITALS = bytes(range(65, 91))
SIGNS = re.compile(rb"[#$%&*|]")
# Bytes of text whose copies a task puts together before they are dealt out, and that one trie holds.
HELD = 16 << 20
FOUND = "key int, doc_id long, part string, mask int, copies long, hot boolean, text binary"


def _mask(data: bytes, n_chars: int) -> int:
    n, distinct = 0, set()
    for piece in common.pieces(data):
        words = piece.split()
        n += len(words)
        distinct.update(words)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    mask = A * (n < LEAST_WORDS) | B * (100 * len(distinct) < DISTINCT_PERCENT * n)
    return mask | C * (100 * capitals > CAPITALS_PERCENT * n_chars) | D * bool(SIGNS.search(data))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "doc_id", "part", "mask", "copies", "hot", "text"])


def _judged(starts: list[bytes]):
    """Masks without duplicates; of the copies in a bounded lot only the least id keeps its text.

    Of a hot text the key is the id's, so that its copies stay spread for the first step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("data").cast(pa.large_binary())
            n_chars = pc.fill_null(pc.utf8_length(texts.cast(pa.large_string())), 0).to_pylist()
            ids, parts, hot = (batch.column(c).to_pylist() for c in ("doc_id", "part", "hot"))
            for a, b, *_ in common.text_blocks(texts, HELD):
                lot = [x.as_py() for x in texts.slice(a, b - a)]
                least: dict[bytes, int] = {}
                for text, i in zip(lot, ids[a:b]):
                    if i is not None and i <= least.get(text, i):
                        least[text] = i
                out, alike, masks = [], {}, {}
                for k, text in enumerate(lot, a):
                    mask = masks.get(text)
                    if mask is None:
                        mask = masks[text] = _mask(text, n_chars[k])
                    i = ids[k]
                    if i is None or i > least[text]:
                        out.append((-1 - k % len(starts), i, parts[k], mask | (0 if i is None else E), 1, False, None))
                    else:
                        row = (i % len(starts) if hot[k] else tries.range_of(starts, text), i, parts[k], mask, hot[k], text)
                        alike[row] = alike.get(row, 0) + 1
                out += [(*row[:4], n, *row[4:]) for row, n in alike.items()]
                if out:
                    yield _rows(out)

    return run


def _walked(root: tries.Node, starts: list[bytes]) -> list[tuple]:
    """The rows at all terminals: later ids are duplicates; a hot text that is none here has yet to meet its other copies."""
    out = []
    for node in tries.terminals(root):
        for i, part, mask, copies, hot in node.rows:
            if i > node.least:
                out.append((None, i, part, mask | E, copies, False, None))
            elif hot:
                out.append((tries.range_of(starts, node.text), i, part, mask, copies, False, node.text))
            else:
                out.append((None, i, part, mask, copies, False, None))
    return out


def _flagged(starts: list[bytes]):
    """Rows come sorted by text. A full trie is walked and emptied; the text at hand goes on with its least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, held = tries.Node(b""), 0
        for batch in batches:
            done = []
            for _, i, part, mask, copies, hot, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None:
                    done.append((None, i, part, mask, copies, False, None))
                    continue
                node = tries.insert(root, text, i)
                if node.rows is None:
                    node.rows, node.text = [], text
                    held += 2 * len(text)
                node.rows.append((i, part, mask, copies, hot))
                held += 200
                if held > HELD:
                    done += _walked(root, starts)
                    root, held = tries.Node(b""), 0
                    tries.insert(root, text, node.least)
            if done:
                yield _rows(done)
        if rest := _walked(root, starts):
            yield _rows(rest)

    return run


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, copies), ``copies`` rows of ``docs`` each: which filters a document fails, as bits; see audit()."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), text.alias("data"))
    starts = tries.range_starts(rows, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "audit")
    # a text with so many copies would fill a range by itself; there are fewer such texts than ranges
    copies = rows.groupBy(F.xxhash64("data").alias("hash")).agg(F.count("*").alias("copies"))
    hot = [r.hash for r in copies.where(F.col("copies") > max(64, rows.count() // len(starts))).collect()]
    rows = rows.withColumn("hot", F.xxhash64("data").isin(hot) if hot else F.lit(False))
    found = rows.mapInArrow(_judged(starts), FOUND).repartition("key").sortWithinPartitions("text", "doc_id").mapInArrow(_flagged(starts), FOUND)
    found = common.stored(found, "audit-found")
    slim = found.select("doc_id", "part", "mask", "copies")
    if not hot:
        return slim
    met = found.where("text is not null").repartition("key").sortWithinPartitions("text", "doc_id").mapInArrow(_flagged(starts), FOUND)
    return slim.where(F.col("text").isNull()).unionByName(met.select(*slim.columns))


def _orders() -> Column:
    """An array of the steps of all orders: filter_order, step, the filter's bit and the bits before it."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")))
            before |= bit
    return F.array(*steps)


def _summed(what: str, where) -> Column:
    """Sum of a count over the masks that satisfy ``where``."""
    return F.aggregate(F.filter("masks", lambda x: where(x["mask"])), F.lit(0).cast("long"), lambda total, x: total + x[what])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of all 120 orders: 600 rows per part (language; null is the empty string).

    part, filter_order, step, and counts of documents: kept after the step, removed by it, redundant (failing
    the filter but removed before), unique_fails (failing this filter only), good_lost and toxic_lost (removed
    here, labelled quality 1, toxic 1), shapley (removed by this filter, summed over all orders).

    A null text is empty. Every row counts: repeated rows (same id and text) are no duplicates of each other,
    and a row without an id is neither a duplicate nor has it any. Of labels that repeat a document any 1
    counts. Very long texts are read in pieces and held once. Other columns of either table are not read. An
    empty table gives no rows.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.col("quality").cast("int") == 1).alias("good"), F.max(F.col("toxic").cast("int") == 1).alias("toxic"))
    counted = lambda c: F.sum(F.when(F.col(c), F.col("copies")).otherwise(0)).alias(c)
    masks = failures(docs).join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.sum("copies").alias("n"), counted("good"), counted("toxic"))
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.select("part", "masks", F.inline(_orders()))
    bit, before = F.col("bit"), F.col("before")
    fails, passed = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) == 0
    here = lambda m: fails(m) & passed(m)
    # a document that fails k filters is removed by each of them in the orders that begin with it among the k: 120 / k
    share = F.aggregate(F.filter("masks", lambda x: fails(x["mask"])), F.lit(0).cast("long"), lambda total, x: total + x["n"] * (F.lit(120) / F.bit_count(x["mask"])).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        _summed("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        _summed("n", here).alias("removed"),
        _summed("n", lambda m: fails(m) & ~passed(m)).alias("redundant"),
        _summed("n", lambda m: m == bit).alias("unique_fails"),
        _summed("good", here).alias("good_lost"),
        _summed("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )
