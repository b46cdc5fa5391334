"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept. All but the last return the columns of
``documents``, extra ones of any name included; the last one returns the batches. An empty table passes
all stages. A null text is an empty one: the classifier judges it like one, and it has left after the stage
that removes repeats, like any text without a word. Of repeated rows (same id and text) one is left after the
near-duplicate stage; rows without an id are never compared with others. Ties: the smaller id stays. Very long
texts are read whole and become batches of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import common, minhash, mixing, packing, quality, suffix

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


# A passage of more than 50 words has at least this many bytes, but for words of less than four letters on average.
PASSAGE = 240


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id is not in ``gone``; rows without an id stay."""
    gone = common.stored(gone.select(F.col("doc_id").alias("gone")).distinct(), "pipeline-gone")
    rows = docs.select(common.packed(docs)).join(common.small(gone), F.col("row.doc_id") == F.col("gone"), "left_anti")
    return common.unpacked(rows, docs)


def _once(docs: DataFrame) -> DataFrame:
    """One row of those that agree in id and text, the least by its other columns; rows without an id stay."""
    rows = docs.select(common.packed(docs))
    ids = rows.where("row.doc_id is not null").groupBy(F.col("row.doc_id").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again")
    ids = common.stored(ids, "pipeline-again")
    again = common.small(ids)
    same = F.col("row.doc_id") == F.col("again")
    one = rows.join(again, same, "left_semi").groupBy(F.col("row.doc_id").alias("id"), F.col("row.text").alias("text")).agg(F.min("row").alias("row"))
    return common.unpacked(rows.join(again, same, "left_anti").unionByName(one.select("row")), docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.accepted(docs, common.read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one row of each document that is repeated."""
    return _once(_without(docs, minhash.near_duplicates(docs).where("not kept")))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat; documents with no word left go."""
    cut = suffix.cleaned(docs, PASSAGE)
    return cut.where(F.col("text").rlike(common.WORD))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.taken(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of documents of similar length."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", repeat_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# The first stage is a learned classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
