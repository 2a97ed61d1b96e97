"""Quality classifier by pairwise ranking (Bradley-Terry).

Documents become `FEATURES` numbers each. From labelled documents come preference pairs (a good one over a bad one); the
weights minimise the logistic loss of the feature differences. The raw scores are then cut at a quantile: that of the
training scores at which the most training labels are right. The score returned is a logistic of the distance from the cut,
0.7 at the cut.

Bounds of the fit, all parameters: at most about `max_labelled` labelled rows by a hash of their id, and `pairs_each`
pairs for each row of the rarer class. Everything else covers all documents.

Defined cases: null or empty texts have all-zero counts and are scored like any other; a document labelled twice counts
twice; null labels are ignored; with labels of one class only all scores are 0.7 or above for class 1 and below for class 0;
an empty table gives an empty result; label, language, source and id never enter a score; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_text, staged, table
from tessera.llm.quality_rules import WORD_AT, _class_matrix, repeat_words

FEATURES = (
    "log_words", "word_length", "distinct", "common", "upper", "digit", "stop", "symbol", "wide", "repeat_words", "repeat_lines",
    "adjacent", "caps_words", "marked_words", "bars", "exclaims", "line_bars", "line_caps", "line_marks", "line_exclaims", "line_adjacent", "line_distinct",
)
MARKS = (b"###", b"$$$", b"***", b"&&&", b"%%%", b"#", b"$", b"*", b"&", b"%", b"<", b">")
MAX_LABELLED, PAIRS_EACH, RIDGE, STEPS = 20_000, 20, 1e-4, 25


def _words_part(words: list[bytes]) -> tuple[float, float, float, float, float, float]:
    """Shares of bars, capital words, marked words, shouted words and equal neighbours; and of distinct words."""
    n = len(words) or 1
    bars = words.count(b"|")
    caps = sum(w.isupper() and len(w) > 1 for w in words)
    marked = sum(w.endswith(MARKS) for w in words)
    shouted = sum(w.endswith(b"!!") for w in words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return bars / n, caps / n, marked / n, shouted / n, same / n, len(set(words)) / n


def _features(texts: list[bytes]) -> list[list]:
    matrix, out = _class_matrix(), []
    for b in texts:
        words = b.split()
        n, size = len(words) or 1, len(b) or 1
        share = (np.bincount(np.frombuffer(b, np.uint8), minlength=256) @ matrix) / size
        lines = [x for x in (line.split() for line in b.split(b"\n")) if x]
        most = np.zeros(6)
        most[5] = 1.0
        for line in lines:
            if len(line) >= 5:
                p = _words_part(line)
                most[:5] = np.maximum(most[:5], p[:5])
                if len(line) >= 15:
                    most[5] = min(most[5], p[5])
        bars, caps, marked, shouted, same, distinct = _words_part(words)
        again = 1 - len({tuple(x) for x in lines}) / (len(lines) or 1)
        out.append([
            math.log1p(len(words)), sum(map(len, words)) / n / 10, distinct, sum(w in WORD_AT for w in b.lower().split()) / n,
            float(share[1]), float(share[2]), float(share[4]), float(share[5]), float(share[6]), repeat_words(words) / n, again,
            same, caps, marked, bars, shouted, float(most[0]), float(most[1]), float(most[2]), float(most[3]), float(most[4]), float(most[5]),
        ])
    return [out]


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The `keep` columns and `x`, the features of the whole text."""
    return map_text(docs, "text", [("x", "array<double>")], _features, keep)


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs_each: int = PAIRS_EACH, steps: int = STEPS) -> np.ndarray:
    """Weights that maximise the likelihood of the good row's win in pairs (good, bad), by Newton steps."""
    rng = np.random.default_rng(7)
    n = pairs_each * min(len(good), len(bad))
    d = good[rng.integers(len(good), size=n)] - bad[rng.integers(len(bad), size=n)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        lost = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        slope = d.T @ lost / n - RIDGE * w
        curve = (d * (lost * (1 - lost))[:, None]).T @ d / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 3 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fitted(x: np.ndarray, y: np.ndarray) -> dict:
    """mean, deviation, weights, cut and slope of the score."""
    if not len(x):
        return {"mean": [0.0] * len(FEATURES), "weight": [0.0] * len(FEATURES), "cut": 0.0, "slope": 1.0}
    mean, dev = x.mean(0), x.std(0)
    z = (x - mean) / np.where(dev > 1e-9, dev, 1.0)
    good, bad = z[y == 1], z[y == 0]
    if not len(good) or not len(bad):
        return {"mean": mean.tolist(), "weight": [0.0] * len(mean), "cut": -1.0 if len(good) else 1.0, "slope": 1.0}
    w = bradley_terry(good, bad)
    raw = z @ w
    order = np.argsort(raw, kind="stable")
    ones = np.cumsum(y[order] == 1)
    right = len(good) - ones + np.arange(1, len(y) + 1) - ones  # cut above the i-th: zeros below and ones above are right
    at = int(np.argmax(right))
    quantile = (at + 1) / len(y)
    cut = float((raw[order[at]] + raw[order[min(at + 1, len(y) - 1)]]) / 2)
    scale = float(np.abs(np.quantile(raw, 0.9) - cut)) or 1.0
    return {"mean": mean.tolist(), "weight": (w / np.where(dev > 1e-9, dev, 1.0)).tolist(), "cut": cut, "slope": 3.0 / scale, "quantile": quantile}


def score(x: Column, model: dict) -> Column:
    """The logistic of the distance from the cut: 0.7 at the cut, in (0, 1)."""
    shift = -model["cut"] - sum(m * w for m, w in zip(model["mean"], model["weight"], strict=True))
    raw = F.lit(float(shift))
    for i, w in enumerate(model["weight"]):
        raw = raw + x[i] * float(w)
    return 1 / (1 + F.exp(-(raw * float(model["slope"]) + math.log(0.7 / 0.3))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    x = staged(features(docs, ["doc_id"]))
    known = labels.filter("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("y")).filter(~held_out(F.col("doc_id")))
    total = known.count()
    part = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_labelled / max(1, total))))
    rows = x.join(part, "doc_id").orderBy("doc_id", "y", "x").select("x", "y").collect()  # about max_labelled rows
    model = fitted(np.array([r["x"] for r in rows], np.float64).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows]))
    out = x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("x"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
