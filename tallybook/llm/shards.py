"""K-d tree sharding: split at weighted medians along the widest metadata dimension.

A node is cut so that its two sides hold as many bytes as their shares of shards
ask for. Medians are found by distributed histograms that descend digit by digit
into the entry holding the median, for all nodes of a level at once; no row and no
list of values reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm import common, suffix

SHARDS = 40
DIGIT = 12  # bits of a histogram's entries
ID_BITS = 24
KEY_BITS = 60  # 12 of the dimension, then 24 of the text's hash and 24 of the id's hash that order equal values
CODES = 1 << DIGIT
# An entry with less than this part of a shard's bytes is not divided further.
CLOSE = 0.0005
# Equal texts are divided only if a cut beside them would miss by more than this part of a shard's bytes.
WHOLE = 0.01
# Texts with more rows than this are joined apart from the others.
HOT = 10_000


@dataclass
class Node:
    first: int  # first shard
    n: int  # shards below
    dim: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def _codes(rows: DataFrame, column: str) -> DataFrame:
    """A column ``column``_code of 12 bits: the rank of the value, null last; neighbours share a code if there are more than 4096 values."""
    key = F.coalesce(F.concat(F.lit("s"), column), F.lit("n"))
    values = rows.select((key == "n").alias("last"), key.alias("_key")).distinct()
    ranked = suffix.cumulated(values, ["last", "_key"], {"place": F.lit(1)}, "shards-codes")
    n = ranked.count()
    code = F.when(F.col("last"), F.lit(CODES - 1)).otherwise(F.floor(F.col("place") * CODES / F.lit(max(n, 1)))).cast("long")
    return rows.withColumn("_key", key).join(common.small(ranked.select("_key", code.alias(f"{column}_code"))), "_key").drop("_key")


def _leaf(tree: Node, ids: dict[int, int]) -> Column:
    """The node a row has come to, as a number."""
    if tree.left is None:
        return F.lit(ids[id(tree)])
    return F.when(F.col("keys")[tree.dim] < tree.cut, _leaf(tree.left, ids)).otherwise(_leaf(tree.right, ids))


def _leaves(tree: Node) -> list[Node]:
    return [tree] if tree.left is None else _leaves(tree.left) + _leaves(tree.right)


def grow(rows: DataFrame, shards: int) -> Node:
    """The tree over (keys array<long>, size): level by level, one histogram of all nodes after the other."""
    tree = Node(0, shards)
    total = rows.agg(F.sum("size")).first()[0] or 0
    near, whole = CLOSE * total / shards, WHOLE * total / shards
    while open_ := [x for x in _leaves(tree) if x.n > 1]:
        ids = {id(x): k for k, x in enumerate(_leaves(tree))}
        at = rows.withColumn("node", _leaf(tree, ids))
        shift = KEY_BITS - DIGIT
        wide = at.select("node", "size", F.posexplode("keys").alias("dim", "key"))
        found = wide.groupBy("node", "dim", F.shiftright("key", shift).alias("digit")).agg(F.sum("size").alias("w")).collect()
        hist: dict[tuple[int, int], dict[int, int]] = {}
        for r in found:
            hist.setdefault((r.node, r.dim), {})[r.digit] = r.w
        seek = {}  # node number: [node, key prefix, bytes below the prefix, bytes wanted on the left]
        for x in open_:
            k = ids[id(x)]
            of = {d: h for (n, d), h in hist.items() if n == k}
            if not of:  # nothing came here: all of its shards stay empty
                x.dim, x.left, x.right = 0, Node(x.first, x.n // 2), Node(x.first + x.n // 2, x.n - x.n // 2)
                continue
            x.dim = max(of, key=lambda d: (max(of[d]) - min(of[d]), -d))
            weight = sum(of[x.dim].values())
            seek[k] = [x, 0, 0, weight * (x.n // 2) / x.n]
        now = {k: hist[k, x.dim] for k, (x, *_) in seek.items()}
        while seek:
            deeper = {}
            for k, (x, prefix, below, want) in seek.items():
                for digit in sorted(now[k]):
                    w = now[k][digit]
                    if below + w >= want or digit == max(now[k]):
                        break
                    below += w
                off = min(abs(below - want), abs(below + w - want))
                if w <= near or not shift or (shift == ID_BITS and off <= whole):
                    side = digit + (abs(below + w - want) < abs(below - want))
                    x.cut = ((prefix << DIGIT) + side) << shift
                    x.left, x.right = Node(x.first, x.n // 2), Node(x.first + x.n // 2, x.n - x.n // 2)
                else:
                    deeper[k] = [x, (prefix << DIGIT) + digit, below, want]
            seek = deeper
            if seek:
                key, inside = F.lit(0).cast("long"), F.lit(False)
                for k, (x, prefix, *_) in seek.items():
                    own = F.col("keys")[x.dim]
                    key = F.when(F.col("node") == k, own).otherwise(key)
                    inside = inside | ((F.col("node") == k) & (F.shiftright(own, shift) == prefix))
                shift -= DIGIT
                entries = at.where(inside).groupBy("node", F.shiftright(key, shift).bitwiseAND(CODES - 1).alias("digit")).agg(F.sum("size").alias("w")).collect()
                now = {k: {} for k in seek}
                for r in entries:
                    now[r.node][r.digit] = r.w
    return tree


def _shared(rows: DataFrame) -> DataFrame:
    """Rows with one source and one lang for all rows of a text: the least of them, null if one is null."""
    one = lambda c: F.when(F.count(c) == F.count("*"), F.min(c)).alias(f"one_{c}")
    unlike = lambda c: (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))
    mixed = F.coalesce(unlike("source"), F.lit(False)) | F.coalesce(unlike("lang"), F.lit(False))
    texts = rows.groupBy("text_id").agg(F.count("*").alias("n"), mixed.alias("mixed"), one("source"), one("lang"))
    texts = common.stored(texts.where("mixed").select(F.col("text_id").alias("of"), "n", "one_source", "one_lang"), "shards-mixed")
    # a hot text would end in one task of a shuffle, and few texts are hot
    for part in (texts.where(F.col("n") > HOT), texts.where(F.col("n") <= HOT)):
        own = lambda c: F.when(F.col("of").isNull(), F.col(c)).otherwise(F.col(f"one_{c}")).alias(c)
        rows = rows.join(common.small(part), F.col("text_id") == F.col("of"), "left").select("doc_id", own("source"), own("lang"), "size", "crc", "text_id")
    return rows


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Dimensions are the ranks of source and lang and the logarithm of the size; a null value is one of its own.
    Equal texts count as of one source and lang, the least among them (null if one is null), and rows of equal value
    are cut by a hash of the text and only then of the id: equal texts stay in one shard, unless a cut beside them
    would miss its place by more than a hundredth of a shard's bytes, as with copies that hold most of the rows. Rows
    equal in text and id go to one shard. A null text has size 16 and crc 0, like an empty one. A row without an
    id has the hash 0. The law is ``bytes``: shards hold nearly equal sizes, but for a text that is as large as a
    shard; grown_shard is null. Ties in a slot's order do not matter. Extra columns are not read. Empty tables give
    empty results.
    """
    binary = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = common.id_and_text(docs, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    rows = rows.select("doc_id", "source", "lang", (F.octet_length(binary) + 16).cast("long").alias("size"), F.crc32(binary).alias("crc"), F.xxhash64(binary).alias("text_id"))
    rows = common.stored(rows, "shards-sizes")
    last = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))).cast("long")
    text_hash = F.pmod(F.col("text_id"), F.lit(1 << 24))
    level = F.least(F.floor(F.log2(F.col("size").cast("double")) * 128), F.lit(CODES - 1)).cast("long")
    coded = _codes(_codes(_shared(rows), "source"), "lang")
    key = lambda code: (code.cast("long") * (1 << 48) + text_hash * (1 << ID_BITS) + last)
    keyed = coded.select("doc_id", "size", "crc", F.array(key(F.col("source_code")), key(F.col("lang_code")), key(level)).alias("keys"))
    keyed = common.stored(keyed, "shards-keys")
    tree = grow(keyed, shards)
    placed = keyed.select("doc_id", "size", "crc", _leaf(tree, {id(x): x.first for x in _leaves(tree)}).cast("int").alias("shard"))
    out = common.numbered(placed, ["shard"], ["crc", "size", "doc_id"], "slot")
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
