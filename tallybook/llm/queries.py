"""The operators of this folder over the test tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import audit, edits, embeddings, language, minhash, mixing, packing, quality, resampling, rules, shards, suffix, toxicity
from tallybook.llm.common import read, stored
from tallybook.llm.oracles import SQL

__all__ = ["QUERIES", "SQL"]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.detect(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.withColumn("worst", F.array_max(F.transform("offending", lambda x: F.struct(x["score"], x["start"], x["end"])))).select(
        "doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"), F.col("worst.start").alias("worst_start"), F.col("worst.end").alias("worst_end")
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(read(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(read(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked_vectors(read(spark, sf_dir, "embeddings"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.clean(read(spark, sf_dir, "documents")).drop("kept_text")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(edits.fingerprints(read(spark, sf_dir, "documents")), "op12")
    return edits.near_copies(prints)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_shards": op3_shards,
    "op4_minhash": op4_minhash,
    "op5_suffix": op5_suffix,
    "op6_embeddings": op6_embeddings,
    "op7_rules": op7_rules,
    "op8_language": op8_language,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_audit": op11_audit,
    "op12_edits": op12_edits,
    "op13_resampling": op13_resampling,
    "pipeline": pipeline,
}
