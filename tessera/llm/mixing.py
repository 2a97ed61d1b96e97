"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed into cells (source, language, topic). The cells are raked: their weights are scaled to the
target sums of each dimension in turn until all margins hold. A cell's raked weight over its tokens, times a common
scale, is the probability with which its documents are taken; the draw is a hash of the document's id, so it is the
same on every run and on every executor.

Only cells are raked, and their number is that of the distinct (source, language, topic) triples (one group-by of the
documents, with partial sums, so a hot source is summed before it moves). Up to `FEW_CELLS` of them are counted, then raked
on the driver in one go (some 100 bytes each: 5 MB); more stay in a DataFrame, with the same steps as windows.

Defined cases: a null in a dimension is the value `(none)`; a null or empty text has no tokens, probability 0 and is
not taken; rows with the same id share one draw; an empty table gives an empty result; columns of the input with names
of the output's are kept apart, as the input travels in a struct.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import staged, table

DIMENSIONS = ("source", "lang", "topic")
#: A margin's target share of a value is in proportion to its tokens to this power (1: as found, 0: even).
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
ROUNDS, ROUNDS_A_WRITE, SCALE_ROUNDS, BUDGET, SEED = 12, 3, 10, 0.6, "mix-1"
FEW_CELLS = 50_000
NONE = "(none)"
BLANKS = " \t\n\r"


def tokens(text: Column) -> Column:
    """Words of a text as its blanks plus one (an estimate: runs of blanks count each); no words if empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.translate(t, BLANKS, "")) + 1).cast("bigint")


def topic(text: Column) -> Column:
    """A coarse topic by form: tables, marked-up text, records with many digits, long and short prose."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    share = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))) / n
    return F.when(share("|") > 0.01, "tables").when(share("#$%&*<>{}") > 0.02, "markup").when(share("0123456789") > 0.03, "records").when(n >= 4000, "long").otherwise("short")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def raked(cells: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS) -> DataFrame:
    """cells (dimensions and `n`, tokens > 0) with `w`: weights whose sums over every dimension meet its targets."""
    dims = list(powers)
    total = cells.agg(F.sum("n").alias("total"))
    targets = {}
    for d in dims:
        sums = cells.groupBy(d).agg(F.sum("n").alias("s")).select(d, F.pow("s", F.lit(powers[d])).alias("p"))
        targets[d] = sums.crossJoin(total).select(d, (F.col("p") / F.sum("p").over(Window.partitionBy()) * F.col("total")).alias(f"target_{d}"))
    out = cells.withColumn("w", F.col("n").cast("double"))
    for d in dims:
        out = out.join(targets[d], d)
    out = staged(out)
    for k in range(rounds):
        for d in dims:
            out = out.withColumn("w", F.col("w") * F.col(f"target_{d}") / F.sum("w").over(Window.partitionBy(d)))
        if (k + 1) % ROUNDS_A_WRITE == 0:
            out = staged(out)
    return out.select(*dims, "n", "w")


def probabilities(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Raked cells with `prob`: their documents' chance, at most 1, so that `budget` of all tokens are expected.

    Where the scale would pass 1 for a cell, the cell is full and the rest is spread over the others, again and again.
    """
    every = Window.partitionBy()
    out = cells.withColumns({"ratio": F.col("w") / F.col("n"), "goal": F.sum("n").over(every) * budget, "full": F.lit(False)})
    scale = F.col("scale")
    for k in range(SCALE_ROUNDS):
        spent = F.sum(F.when(F.col("full"), F.col("n")).otherwise(0)).over(every)
        open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every)
        out = out.withColumn("scale", F.when(open_ > 0, (F.col("goal") - spent) / open_).otherwise(0.0))
        if k + 1 < SCALE_ROUNDS:
            out = out.withColumn("full", F.col("full") | (F.col("ratio") * scale >= 1))
        if k % ROUNDS_A_WRITE == 2:
            out = staged(out)
    return out.withColumn("prob", F.when(F.col("full"), 1.0).otherwise(F.least(F.lit(1.0), F.col("ratio") * scale)))


def measured(docs: DataFrame, row: Column) -> DataFrame:
    """`row`, n_tokens, topic, source and lang of every document."""
    return docs.select(row.alias("row"), tokens(F.col("text")).alias("n_tokens"), topic(F.col("text")).alias("topic"), *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in ("source", "lang")])


def mixed(docs: DataFrame, powers: dict[str, float] = POWERS, budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """`row` (the input row), source, lang, topic, n_tokens, weight (raked weight a token), prob and selected."""
    return weighed(measured(docs, F.struct("*")), powers, budget, seed)


def few_probabilities(cells: DataFrame, powers: dict[str, float] = POWERS, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """The same as probabilities(raked(cells)) for cells that fit the driver."""
    rows = cells.select(*powers, "n").collect()
    n = np.array([float(r["n"]) for r in rows])
    w, total = n.copy(), n.sum()
    numbers = {d: np.unique([r[d] for r in rows], return_inverse=True)[1] for d in powers} if rows else {}
    targets = {}
    for d, at in numbers.items():
        p = np.bincount(at, n) ** powers[d]
        targets[d] = p / p.sum() * total
    for _ in range(rounds):
        for d, at in numbers.items():
            w *= (targets[d] / np.bincount(at, w))[at]
    ratio, full, scale = w / n, np.zeros(len(n), bool), 0.0
    for k in range(SCALE_ROUNDS):
        free = w[~full].sum()
        scale = (total * budget - n[full].sum()) / free if free > 0 else 0.0
        if k + 1 < SCALE_ROUNDS:
            full |= ratio * scale >= 1
    prob = np.where(full, 1.0, np.minimum(1.0, ratio * scale))
    made = {d: pa.array([r[d] for r in rows], pa.string()) for d in powers} | {"n": pa.array([r["n"] for r in rows], pa.int64()), "w": pa.array(w, pa.float64()), "prob": pa.array(prob, pa.float64())}
    return cells.sparkSession.createDataFrame(pa.table(made))  # rows of Python objects would start a second set of Python workers


def weighed(base: DataFrame, powers: dict[str, float] = POWERS, budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """Measured rows with weight, prob and selected; the draw is by the exact probability, the columns are rounded."""
    cells = staged(base.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n")).filter("n > 0"))
    few = cells.count() <= FEW_CELLS
    made = few_probabilities(cells, powers, budget) if few else probabilities(raked(cells, powers), budget)
    chances = made.select(*DIMENSIONS, (F.col("w") / F.col("n")).alias("weight"), F.col("prob").alias("chance"))
    out = base.join(F.broadcast(chances) if few else staged(chances), list(DIMENSIONS), "left")
    chance = F.when(F.col("n_tokens") > 0, F.coalesce("chance", F.lit(0.0))).otherwise(0.0)
    out = out.withColumns({"selected": draw(F.col("row.doc_id"), seed) < chance, "prob": F.round(chance, 6), "weight": F.round(F.coalesce("weight", F.lit(0.0)), 6)})
    return out.drop("chance")


def sampled(docs: DataFrame, powers: dict[str, float] = POWERS, budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """The rows of docs that are taken, with the columns of docs unchanged."""
    return mixed(docs, powers, budget, seed).filter("selected").select("row.*")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = staged(measured(table(spark, sf_dir, "documents"), F.struct("doc_id")))  # texts are read once
    return weighed(base).select(F.col("row.doc_id").alias("doc_id"), "source", "lang", "topic", "n_tokens", "weight", "prob", "selected")


def _sql() -> str:
    """The same sums, rakes and draws as one DuckDB statement."""

    def share(chars: str) -> str:
        return f"(length(t) - length(translate(t, '{chars}', ''))) / greatest(length(t), 1)"

    steps = [
        f"""base as materialized (select doc_id, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang, t,
        case when length(t) = 0 then 0 else length(t) - length(translate(t, ' ' || chr(9) || chr(10) || chr(13), '')) + 1 end as n_tokens,
        case when {share("|")} > 0.01 then 'tables' when {share("#$%&*<>{}")} > 0.02 then 'markup' when {share("0123456789")} > 0.03 then 'records'
        when length(t) >= 4000 then 'long' else 'short' end as topic from (select *, coalesce(text, '') as t from documents))""",
        "cells as materialized (select source, lang, topic, sum(n_tokens)::bigint as n from base group by all having sum(n_tokens) > 0)",
        "total as materialized (select sum(n)::double as total from cells)",
    ]
    for d in DIMENSIONS:
        steps.append(f"target_{d} as materialized (select {d}, p / sum(p) over () * total as target_{d} from (select {d}, pow(sum(n)::double, {POWERS[d]}) as p from cells group by {d}), total)")
    steps.append("r0 as materialized (select source, lang, topic, n, n::double as w, target_source, target_lang, target_topic from cells join target_source using (source) join target_lang using (lang) join target_topic using (topic))")
    k = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            steps.append(f"r{k + 1} as materialized (select * replace (w * target_{d} / sum(w) over (partition by {d}) as w) from r{k})")
            k += 1
    steps.append(f"s0 as materialized (select source, lang, topic, n, w, w / n as ratio, (sum(n) over ())::double * {BUDGET} as goal, false as is_full from r{k})")
    for j in range(SCALE_ROUNDS):
        last = j + 1 == SCALE_ROUNDS
        scaled = f"select *, case when sum(case when is_full then 0.0 else w end) over () > 0 then (goal - (sum(case when is_full then n else 0 end) over ())::double) / sum(case when is_full then 0.0::double else w end) over () else 0.0::double end as scale from s{j}"
        inner = "*" if last else "* exclude (scale) replace (is_full or ratio * scale >= 1 as is_full)"
        steps.append(f"s{j + 1} as materialized (select {inner} from ({scaled}))")
    steps.append(f"chances as materialized (select source, lang, topic, round(w / n, 6) as weight, case when is_full then 1.0::double else least(1.0::double, ratio * scale) end as prob from s{SCALE_ROUNDS})")
    return f"""with {", ".join(steps)}
    select doc_id, source, lang, topic, n_tokens::bigint as n_tokens, coalesce(weight, 0.0::double) as weight, round(case when n_tokens > 0 then coalesce(prob, 0.0::double) else 0.0::double end, 6) as prob,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / {1 << 52}::double) < (case when n_tokens > 0 then coalesce(prob, 0.0::double) else 0.0::double end) as selected
    from base left join chances using (source, lang, topic)"""


QUERIES = {"op1_source_mixing": op1_source_mixing}
ORACLES = {"op1_source_mixing": _sql()}
