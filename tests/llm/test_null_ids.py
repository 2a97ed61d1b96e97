"""Rows of null id in the training-data operators and the pipeline."""

import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, neighbours, packing, quality_model, quality_rules, secrets, suffix_dedup

SF = "/root/testdata/sf0.001"


def test_null_ids(spark):
    text = " ".join(f"word{i}" for i in range(90))
    rows = [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (None, None, "en", "s", 1), (3, text, "en", "s", 1), (7, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.components(docs).collect()), key=str)
    assert got == [(3, 86, 3), (7, 86, 3), (None, 0, None), (None, 86, None), (None, 86, None)]
    assert sorted((r["doc_id"] for r in jaccard_join.representatives(docs).collect()), key=str) == [3, None, None, None]
    cut = suffix_dedup.repeated_removed(docs).collect()
    assert sorted(((r["doc_id"], r["n_removed"]) for r in cut), key=str) == sorted(((r[0], len(r[1] or "")) for r in rows), key=str)
    big = 2**53 + 1
    vectors = spark.createDataFrame([(None, [9.0, 0.0]), (big, [1.0, 0.0]), (5, [0.5, 0.5]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.nearest(vectors, vectors, 5).orderBy("query_id").collect()] == [(5, 1, big, 0.5), (big, 1, 5, 0.5)]
    for report in (quality_rules.quality_report, secrets.secret_report, lambda d: packing.pieces(d, packing.default_tokenizer())):
        assert report(docs).filter("doc_id is null").count() >= 2
    labels = spark.createDataFrame([(3, 1), (7, 0), (None, 1)], "doc_id long, quality int")
    assert quality_model.quality_scores(docs, labels).filter("doc_id is null").count() == 3


def test_pipeline_takes_null_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id")))
    n = docs.filter("doc_id is null").count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        left = docs.filter("doc_id is null").count()
        assert left > 0 and (left <= n or name == "best-fit packing")
