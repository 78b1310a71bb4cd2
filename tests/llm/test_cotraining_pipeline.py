from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from groundtally.llm import cotraining as ct
from groundtally.llm import queries as registered
from tests.llm.conftest import messy_texts
from tests.oracle_check import check, duck

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@needs_tables
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else SF
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    unseen = F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(4)) == 0
    model = ct.train(docs, labels.filter(~unseen), ct.Settings())
    rows = model.score(ct.narrow(docs)).join(labels.filter(unseen), F.col("id") == labels.doc_id).select("kept", "quality", "score").collect()
    assert len(model.exchanged) == 2 and len(rows) > 50
    right = np.mean([r.kept == bool(r.quality) for r in rows])
    assert right >= 0.95, right
    assert all(0 <= r.score <= 1 for r in rows)


def test_scores_without_labels_or_documents(messy, make_docs, spark):
    none = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = ct.train(messy, none)
    scored = model.score(ct.narrow(messy)).collect()
    assert len(scored) == len(messy_texts()) and all(r.kept and r.score is None for r in scored)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] * 2, "doc_id long, quality int, toxic int")
    views = ct.add_views(ct.narrow(messy), ct.Settings()).select("id", "words", "meta").collect()
    assert len(views) == len(messy_texts())
    assert ct.train(make_docs([]), labels).score(ct.narrow(make_docs([]))).count() == 0


def test_all_unlabelled_documents_are_exchanged(spark):
    rows = spark.range(13_200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("good"))
    docs = rows.select("doc_id", F.when(F.col("good") == 1, "clear sound prose here").otherwise("BUY CHEAP !!! $$$ 99").alias("text"), F.lit("en").alias("lang"),
                       F.when(F.col("good") == 1, "books").otherwise("spam").alias("source"), F.lit(20).alias("n_chars"))
    labels = rows.filter("doc_id < 200").select("doc_id", F.col("good").alias("quality"))
    model = ct.train(docs, labels, ct.Settings(rounds=2))
    assert model.exchanged == [(13_000, 13_000)]  # both views are sure of every one of them


@needs_tables
def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, before, SF).cache()
        assert docs.columns == columns, name
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        counts.append(docs.count())
        before = docs
    assert counts[1] < counts[0] and counts[4] == counts[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.select("doc_id").distinct().count() == counts[4]
    ran = corpus_pipeline.run(spark, SF)
    assert ran.select("doc_id", "piece", "ids_crc32").exceptAll(packed.select("doc_id", "piece", "ids_crc32")).count() == 0


def test_stages_take_messy_and_empty_tables(spark, messy, make_docs):
    for docs in (messy, make_docs([])):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.count()
            docs = out


@needs_tables
@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_queries_equal_their_sql(spark, name):
    status, *_, why = check(spark, duck(SF), SF, name, registered.QUERIES[name], registered.ORACLES[name])
    assert status == "ok", why


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registered.QUERIES) == list(range(1, 11))
