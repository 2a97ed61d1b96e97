"""Nulls in every column, empty tables, long texts, repeated rows and clashing names; and the ranking fit against plain code."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, frame, rows, words

from tessera.llm import jaccard_join, packing, quality_model, quality_rules, secrets, suffix_dedup

SF = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
CLASH = "row chunk cls n rep lang_ topic prob weight selected chars commons ref_lang x y score predicted spans piece start length component".split()


def clashing(docs):
    return docs.withColumns({c: F.lit("x") for c in CLASH})


def tokenizer():
    return packing.default_tokenizer()


def test_stages_on_edges(spark):
    rng = random.Random(3)
    a, b, long = words(rng, 60), words(rng, 60), words(rng, 60_000)
    made = [(None, None), (None, a), (1, a), (1, a), (1, b), (2, a + " z"), (3, None), (4, ""), (5, " \n"), (6, long)]
    docs = clashing(spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in made], DOCS).repartition(3))
    want = [(1, a), (1, a), (1, b), (2, a + " z"), (6, long), (None, a)]
    alone = [(1, a), (1, b), (6, long), (None, a)]
    out, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
        kept.append(rows(out.select("doc_id", "text")))
    plain = lambda x: sorted(x, key=str)
    assert kept[:3] == [plain(want), plain(alone), plain(alone)]
    assert set(kept[3]) <= set(alone)
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF).toPandas()
    assert sorted(last.doc_id.dropna().unique()) == [1, 2, 3, 4, 5, 6] and last.length.max() <= packing.CAPACITY
    for _, g in last.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= packing.CAPACITY


def test_stages_on_nothing(spark):
    docs = clashing(frame(spark, ["a"])).limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.collect() == [] and (i == 4 or out.columns == docs.columns)


def reports(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, 1)], "doc_id long, quality int")
    return {
        "suffix": suffix_dedup.repeated_removed,
        "secrets": secrets.secret_report,
        "packing": lambda d: packing.pieces(d, tokenizer()),
        "quality": lambda d: quality_model.quality_scores(d, labels),
        "join": jaccard_join.components,
        "rules": quality_rules.quality_report,
    }


@pytest.mark.parametrize("name", ["suffix", "secrets", "packing", "quality", "join", "rules"])
def test_clashing_names_and_nothing(spark, name):
    report, rng = reports(spark)[name], random.Random(5)
    shared = words(rng, 200)
    docs = frame(spark, [None, "", words(rng, 50), shared, "a " + shared, shared, words(rng, 30_000)])
    plain = report(docs)
    more = report(clashing(docs))
    assert more.columns == plain.columns and rows(more) == rows(plain)
    empty = report(docs.limit(0))
    assert empty.columns == plain.columns and empty.collect() == []


def test_ranking_fit_against_gradient_descent():
    """The same pairs, the same loss, found by small plain steps."""
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.4, 1, (120, 3)), rng.normal(-0.3, 1, (90, 3))
    w = quality_model.bradley_terry(good, bad)
    draws = np.random.default_rng(7)
    n = quality_model.PAIRS_EACH * 90
    first, second = draws.integers(120, size=n), draws.integers(90, size=n)
    plain = np.zeros(3)
    for _ in range(2000):
        slope = -quality_model.RIDGE * plain
        for k in range(3):
            slope[k] += sum((good[first, k] - bad[second, k]) / (1 + np.exp((good[first] - bad[second]) @ plain))) / n
        plain += 0.5 * slope
        if np.abs(slope).max() < 1e-7:
            break
    assert np.allclose(w, plain, atol=1e-4)


def test_scores_against_plain_scores(spark):
    rng = random.Random(9)
    texts = [words(rng, rng.randint(5, 80)) + (" ###" * 5 if i % 2 else "") for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_model.quality_scores(frame(spark, texts), labels).collect()}
    x = np.array(quality_model._features([t.encode() for t in texts])[0])
    known = [i for i in range(60) if not got[i]["held_out"]]
    model = quality_model.fitted(x[known], np.array([1 - i % 2 for i in known]))
    for i in range(60):
        raw = sum((v - m) * w for v, m, w in zip(x[i], model["mean"], model["weight"], strict=True)) - model["cut"]
        plain = 1 / (1 + np.exp(-(raw * model["slope"] + np.log(0.7 / 0.3))))
        assert abs(got[i]["score"] - plain) < 1e-9 and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
    assert all(got[i]["predicted"] == 1 - i % 2 for i in range(60))
