"""The registered queries against DuckDB, and the pipeline against its own stages."""

from __future__ import annotations

import re

import compare
import corpus_pipeline
import duckdb
import pytest

from tallybook.llm import queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_oracle(name, spark, sf, duck):
    assert compare.difference(queries.QUERIES[name](spark, sf), duck, queries.SQL[name]) is None


def test_pipeline(spark, sf):
    """Columns of documents up to the last stage; each stage works on what the one before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        if name in ("quality_classifier", "minhash_near_dedup", "suffix_array_dedup"):
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert len(set(ids)) == len(ids) <= n
            n = len(ids)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.select("text").collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.agg({"n_tokens": "sum"}).first()[0] == words and packed.count() == docs.count()


def test_repeated_rows_stay_once(spark, sf):
    """A clean document that stands twice in the table is one document, through the stages that look for copies."""
    texts = ["".join(f"word{(k * 7919 + j * j) % 9973} " for j in range(120)) for k in range(3)]
    rows = [(1, texts[0], "en", "a"), (1, texts[0], "en", "a"), (2, texts[1], "en", "b"), (2, texts[1], "en", "c"), (3, texts[2], None, "a"), (4, None, "en", "a"), (4, None, "en", "a")]
    rows += [(None, "one two", "en", "a")] * 2
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = corpus_pipeline.near_duplicate_stage(spark, docs, sf).cache()
    assert sorted((r.doc_id or 0, r.source) for r in docs.collect()) == [(0, "a"), (0, "a"), (1, "a"), (2, "b"), (3, "a"), (4, "a")]
    left = corpus_pipeline.repeat_stage(spark, docs, sf)
    assert left.columns == docs.columns
    assert sorted(r.text for r in left.where("doc_id is not null").collect()) == sorted(texts)


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r.batch is not None for r in rows)
