"""The pipeline against the same steps done plainly."""

import corpus_pipeline
from test_llm import plain_components

from tessera.llm import mixing, packing, quality_rules, secrets

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in quality_rules.quality_report(docs).filter("kept").collect()}
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good)
    groups = plain_components([t for _, t in texts])
    first = [texts[i] for i, _, c in groups if i == c]
    out = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
        if i == 1:
            assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == first
    words = secrets.automaton()
    assert all(secrets.scan(r["text"].encode(), words) == [] or "[" in r["text"] for r in out.collect())
    taken = {r["doc_id"] for r in mixing.sampled(out).collect()}
    result = corpus_pipeline.run(spark, SF).toPandas()
    assert set(result.doc_id) == taken
    assert (result.groupby("sequence_id").length.sum() <= packing.CAPACITY).all()
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
