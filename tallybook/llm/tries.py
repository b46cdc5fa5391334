"""Compressed tries over byte strings, and ranges of texts that are adaptive prefixes apart.

A trie holds the least id at each terminal. Ranges start at the shortest prefixes that tell a text from the
one sorted before it: bounded lots of texts are sorted where they lie and cut into even parts, and the cuts of
all lots, summed in their order, give the starts of even ranges. Lots of near copies are told apart by prefixes
as long as that takes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm import common
from tallybook.llm.suffix import cumulated

# Bytes of text that are sorted at once, and the parts that a lot is cut into.
LOT_BYTES, PARTS = 16 << 20, 64
# The starts of ranges are known to every task: at most so many.
MOST_RANGES = 50_000
RANGE_BYTES = 16 << 20


class Node:
    """A node of a trie: the string that leads to it, the nodes below by their first byte, and what ends here."""

    __slots__ = ("edge", "below", "least", "rows", "text")

    def __init__(self, edge: bytes):
        self.edge, self.below, self.least, self.rows, self.text = edge, {}, None, None, None


def _agree(edge: bytes, text: bytes, at: int) -> int:
    """How many bytes of ``edge`` stand in ``text`` from ``at`` on; they differ somewhere."""
    low, high = 0, min(len(edge), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if text.startswith(edge[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


def insert(root: Node, text: bytes, least: int | None) -> Node:
    """The terminal of ``text``, made where it is missing; it keeps the least id."""
    node, at = root, 0
    while at < len(text):
        child = node.below.get(text[at])
        if child is None:
            child = node.below[text[at]] = Node(text[at:])
        elif not text.startswith(child.edge, at):
            k = _agree(child.edge, text, at)
            upper = node.below[text[at]] = Node(child.edge[:k])
            upper.below[child.edge[k]] = child
            child.edge = child.edge[k:]
            child = upper
        node, at = child, at + len(child.edge)
    if least is not None and (node.least is None or least < node.least):
        node.least = least
    return node


def terminals(root: Node) -> Iterator[Node]:
    """Every node at which rows end."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.rows:
            yield node
        stack += node.below.values()


# ---- ranges -------------------------------------------------------------------------------------------------


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(start, weight) of about PARTS even parts of each lot in sorted order; copies in a lot count once."""
    for batch in batches:
        texts = batch.column("data").cast(pa.large_binary())
        for a, b, *_ in common.text_blocks(texts, LOT_BYTES):
            lot = sorted({x.as_py() for x in texts.slice(a, b - a)})
            weights = [len(x) + 16 for x in lot]
            part = max(1, sum(weights) // PARTS)
            starts, sums, held = [b""], [], 0
            for k, (text, weight) in enumerate(zip(lot, weights)):
                if held >= part:
                    starts.append(text[: _agree(lot[k - 1], text, 0) + 1])
                    sums.append(held)
                    held = 0
                held += weight
            sums.append(held)
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.binary()), pa.array(sums, pa.int64())], names=["start", "weight"])


def range_starts(texts: DataFrame, partitions: int, label: str) -> list[bytes]:
    """Sorted strings at which ranges of about RANGE_BYTES start, some for every shuffle partition; the first is empty.

    ``texts`` has ``data``, not null. All texts are weighed, each lot's copies once, as they are dealt out. A
    single text is never parted, so one that outweighs a range is a range.
    """
    cuts = cumulated(texts.select("data").mapInArrow(_cuts, "start binary, weight long"), ["start"], {"weight": F.col("weight")}, label)
    total = cuts.agg(F.coalesce(F.sum("n_weight"), F.lit(0))).first()[0]
    ranges = planned_ranges(total, partitions)
    first = cuts.groupBy(F.floor(F.col("weight") * ranges / max(1, total)).alias("range")).agg(F.min("start").alias("start")).collect()
    common.drop(cuts)
    return sorted({b"", *(bytes(r.start) for r in first)})


def range_of(starts: list[bytes], text: bytes) -> int:
    return bisect_right(starts, text) - 1


def planned_ranges(total: int, partitions: int) -> int:
    """Ranges of about RANGE_BYTES, some for every shuffle partition."""
    return int(np.clip(total // RANGE_BYTES, 4 * partitions, MOST_RANGES))
