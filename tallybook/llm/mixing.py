"""Mixing sources to target weights by entropy balancing.

Document rates w minimise the token-weighted entropy sum(size * (w log w - w + 1))
under one token constraint per source and a ceiling on w. The optimum is an
exponential tilt, w = min(ceiling, exp(dual of the source)). All a Newton step on the
convex dual needs of the documents is the tokens of each source, one grouped sum; the
steps then run side by side in the table of sources, which stays in Spark whatever the
number of sources. The rates are rounded into whole copies, and what rounding leaves
over is settled with single documents.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm import common, suffix

WEIGHTS = (5, 2, 1)
CEILING = 3
# Documents of a source and size class that may settle what rounding leaves over.
SETTLERS = 16


def goals(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(_key, source_size, target) from (_key, tokens): shares by weight, stopped at ``ceiling`` times the size, the excess shared again.

    Sources weigh in the order of their code points, a null one last. Each round of sharing is one sum over the
    sources; the driver holds what is left to share and the weight of the sources that it is shared among.
    """
    ranked = suffix.cumulated(sources.select((F.col("_key") == "n").alias("last"), "_key", "tokens"), ["last", "_key"], {"place": F.lit(1), "tokens": F.col("tokens")}, "mixing-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.select("_key", F.col("n_tokens").alias("source_size"), weight.alias("weight"))
    most = F.lit(ceiling) * F.col("source_size")
    total, among = (x or 0 for x in ranked.agg(F.sum("source_size"), F.sum("weight")).first())
    left = total
    while True:
        over = F.col("weight").cast("decimal(10,0)") * F.lit(Decimal(left)) > F.col("source_size").cast("decimal(19,0)") * F.lit(Decimal(ceiling * among))
        stopped, open_ = (x or 0 for x in ranked.agg(F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("weight")))).first())
        if (total - stopped, open_) == (left, among):
            break
        left, among = total - stopped, open_
    share = F.col("weight").cast("double") * float(left) / float(max(among, 1))
    return ranked.select("_key", "source_size", F.when(over, most.cast("double")).otherwise(share).alias("target"))


def balance(goal: DataFrame, ceiling: float = CEILING, steps: int = 60, exact: float = 1e-12) -> DataFrame:
    """(_key, source_size, target, dual, rate): Newton's method on the dual, for all sources side by side.

    The gradient is target tokens minus tilted tokens, the curvature the tilted tokens below the ceiling. A
    source without tokens keeps dual 0; one whose target reaches its ceiling gets a dual at which the ceiling holds.
    """
    tokens, top = F.col("source_size").cast("double"), F.lit(float(ceiling))

    def step(dual: Column) -> Column:
        tilt = F.exp(dual)
        miss = F.col("target") - F.least(tilt, top) * tokens
        done = (F.abs(miss) <= exact * F.greatest(F.lit(1.0), F.col("target"))) | (tokens == 0)
        # at the ceiling the dual is flat: come back from just below it
        moved = dual + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), miss / (tilt * tokens)))
        return F.when(done, dual).when(tilt < top, moved).otherwise(math.log(ceiling) - 1e-9)

    dual = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda dual, _: step(dual))
    return goal.withColumn("dual", dual).withColumn("rate", F.least(top, F.exp("dual")))


def _settled(offers: pd.DataFrame) -> pd.DataFrame:
    """Changes of copies that bring what is left over of one source near 0.

    Larger documents first, by one copy each, as long as that helps; then, again and again, the two changes
    that together come nearest. Copies stay between 0 and the ceiling.
    """
    offers = offers.sort_values(["words", "doc_id"], ascending=[False, True])
    left, most = int(offers["left"].iloc[0]), int(offers["most"].iloc[0])
    words, first = offers["words"].to_numpy(), offers["copies"].to_numpy()
    copies = first.copy()
    for k, size in enumerate(words):
        step = 1 if left > 0 else -1
        if left and 0 <= copies[k] + step <= most and abs(left - step * size) < abs(left):
            copies[k] += step
            left -= step * int(size)
    while left:
        # no change, one copy more and one copy less of each document; a pair of changes is of two documents
        change = np.concatenate([[0], np.where(copies < most, words, 0), np.where(copies > 0, -words, 0)])
        of = np.concatenate([[-1], np.arange(len(words)), np.arange(len(words))])
        after = np.abs(left - change[:, None] - change[None, :])
        after[(of[:, None] == of[None, :])] = np.iinfo(np.int64).max
        i, j = np.unravel_index(int(after.argmin()), after.shape)
        if after[i, j] >= abs(left):
            break
        for k in (i, j):
            if change[k]:
                copies[of[k]] += 1 if change[k] > 0 else -1
        left -= int(change[i] + change[j])
    moved = copies != first
    return pd.DataFrame({"_moved": offers["doc_id"].to_numpy()[moved], "_more": (copies - first)[moved]})


def sized(docs: DataFrame) -> DataFrame:
    """(row, doc_id, _size, _crc, _key) of each row: words, crc of the text, and a key that keeps a null source apart from an empty one."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    words = F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(common.WORD))).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    return docs.select(common.packed(docs), F.col("doc_id").cast("long").alias("doc_id"), words.alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), key.alias("_key"))


def _counted(rows: DataFrame, plan: DataFrame, ceiling: int) -> DataFrame:
    """Rows of sized() with _copies by rate and hash; the plan has a row for each source."""
    chance = F.pmod(F.xxhash64("doc_id", "_crc", F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    drawn = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    return rows.join(plan, "_key").withColumn("_copies", F.least(drawn, F.lit(ceiling)).cast("long"))


def planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(row, doc_id, _size, source_size, target, rate, _copies), ``row`` being the whole row of ``docs``; texts are not shuffled. See mix()."""
    rows = common.stored(sized(docs).drop("row"), "mixing-sizes")
    sources = common.stored(rows.groupBy("_key").agg(F.sum("_size").alias("tokens")), "mixing-tokens")
    plan = common.stored(balance(goals(sources, weights, ceiling), ceiling).drop("dual"), "mixing-plan")
    known = common.small(plan)
    rounded = _counted(rows, known, ceiling)
    got = rounded.groupBy("_key").agg(F.sum(F.col("_copies") * F.col("_size")).alias("got"))
    gap = got.join(plan, "_key").select("_key", (F.round("target").cast("long") - F.col("got")).alias("left"))
    # in each class of sizes, the documents with the smallest hashes may be moved up or down
    able = rounded.where(F.col("doc_id").isNotNull() & (F.col("_size") > 0) & (F.col("rate") < ceiling))
    level, slot = F.floor(F.log2(F.col("_size").cast("double"))), F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(SETTLERS))
    offer = F.min(F.struct(F.xxhash64("doc_id", F.lit(9)).alias("h"), "doc_id", "_size", "_copies")).alias("offer")
    offers = able.groupBy("_key", level.alias("level"), slot.alias("slot")).agg(offer).join(gap, "_key").where("left <> 0")
    offers = offers.select("_key", "left", "offer.doc_id", F.col("offer._size").alias("words"), F.col("offer._copies").alias("copies"), F.lit(ceiling).alias("most"))
    moved = common.stored(offers.groupBy("_key").applyInPandas(_settled, "_moved long, _more long"), "mixing-moves")
    common.drop(rows, sources)
    out = _counted(sized(docs), known, ceiling)
    out = out.join(common.small(moved), F.col("doc_id") == F.col("_moved"), "left")
    return out.withColumn("_copies", F.col("_copies") + F.coalesce("_more", F.lit(0))).drop("_moved", "_more", "_crc", "_key")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, rate, copies, taken.

    Size is the number of words, 0 for a null or blank text; such a row has 0 taken. A null source is a
    source of its own, the last in order. The whole part of a rate is taken always, the rest if a hash of id
    and text falls below it, so reruns agree and equal ids are taken alike. ``taken`` is copies * size and
    never above ``ceiling`` * size. A very long text counts whole; where one is too large for the rest of a source's
    target, smaller ones settle it. Extra columns are not read. Empty tables give empty results.
    """
    rows = planned(common.id_and_text(docs, F.col("source").cast("string").alias("source")), weights, ceiling)
    return rows.select("doc_id", "row.source", F.col("_size").alias("size"), "source_size", "target", "rate", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, with the columns as they are, whatever they are called."""
    rows = planned(docs, weights, ceiling).where("_copies > 0")
    rows = rows.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return common.unpacked(rows, docs)
