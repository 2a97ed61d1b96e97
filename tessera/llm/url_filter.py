"""URL filters: host and path rules first, else logistic regression on hashed character n-grams. DataFrame functions only.

The model is fitted to a small labelled table of URLs: their n-grams come from the same DataFrame expressions, at most
`MAX_LABELLED` rows of them (the smallest by a hash) come to the driver in one job, and gradient descent over those few
numbers gives the weights, which go back as a literal of `BUCKETS` numbers.

Defined cases: a null URL or one without `://` has an empty host and an empty path, fits no rule and is judged by the
model; equal rows get equal verdicts; of the rules that fit, the longest wins, then the one first in the alphabet; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

# The rules of the query, as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# Words of the labelled table, by subject, written from general knowledge; `labelled` makes hosts of pairs of them.
BLOCK_WORDS = (
    "casino poker roulette blackjack slots betting lottery jackpot bookmaker gamble "  # gambling
    "pills pharmacy viagra steroids slimming detox weightloss miracle "  # quack medicine
    "payday loans forex cash profit millionaire crypto doubler "  # money schemes
    "adult porn escort nude webcam dating singles hookup "  # adult pages
    "replica warez crack keygen torrent counterfeit "  # copies
    "ads adserver popunder banner tracker clickbait affiliate doorway "  # advertising
    "spam phishing malware giveaway prize winner cheap free bonus discount"  # lures
)
ALLOW_WORDS = (
    "news journal gazette herald magazine review opinion "
    "library museum archive gallery theatre heritage history "
    "school university college science physics chemistry biology math "
    "hospital clinic health nutrition cooking recipes garden farm nature birds "
    "city council parliament ministry justice weather travel railway airport "
    "software docs manual code forum engineering design music film book poetry sport"
)
# Allowed hosts without meaning, so that an unknown name alone speaks for nothing: letters drawn by these weights (percent in English).
LETTERS = dict(zip("etaoinshrdlcumwfgypbvk", (12.7, 9.1, 8.2, 7.5, 7.0, 6.7, 6.3, 6.1, 6.0, 4.3, 4.0, 2.8, 2.8, 2.4, 2.4, 2.2, 2.0, 2.0, 1.9, 1.5, 1.0, 0.8), strict=True))
NAMES = 600
MAX_LABELLED = 5_000
BLOCK_AT = 0.45
PATH_SHARE = 0.25  # the labelled paths say little, and long ones hold many n-grams that were never seen
BUCKETS, SIZES, ROUNDS, RATE, MOMENTUM, DECAY = 4096, (3, 4, 5), 400, 8.0, 0.93, 3e-5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(tail, F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def grams(part: Column, mark: str) -> Column:
    """Bucket numbers of the distinct character n-grams of a host (mark h) or a path (mark p), kept apart by their mark."""
    text = F.concat(F.lit("^"), part, F.lit("$"))

    def of_size(n: int) -> Column:  # a second parameter of the lambda would be the index
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))), lambda i: text.substr(i, F.lit(n)))

    each = [of_size(n) for n in SIZES]
    return F.array_distinct(F.transform(F.array_distinct(F.concat(*each)), lambda g: F.pmod(F.xxhash64(g, F.lit(mark)), F.lit(BUCKETS)).cast("int")))


def labelled(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, label (1: block). Tops, subdomains and paths are dealt alike to both labels."""
    rng, chance = np.random.default_rng(7), np.array(list(LETTERS.values())) / sum(LETTERS.values())
    names = ["".join(rng.choice(list(LETTERS), size=k, p=chance)) for k in rng.integers(4, 13, NAMES)]
    pairs = lambda words: [f"{a}-{words[(i + j) % len(words)]}" for j in (1, 5, 11) for i, a in enumerate(words)]
    rows = []
    for label, hosts in ((1, pairs(BLOCK_WORDS.split())), (0, pairs(ALLOW_WORDS.split()) + names)):
        for i, w in enumerate(hosts):
            sub, top, lang = ("", "www.", "m.", "blog.", "shop.")[i % 5], ("com", "org", "net", "info")[i // 5 % 4], ("en", "fr", "de", "es")[i // 3 % 4]
            page, other = rng.integers(1, 9_999, 2).tolist()
            rows += [f"{label} https://{sub}{w}.example.{top}/{lang}/{page}.html", f"{label} http://{sub}{w}.{top}/{lang}/{page}/{other}"]
    return spark.range(1).select(F.explode(F.split(F.lit("\n".join(rows)), "\n")).alias("r")).select(F.substring("r", 3, 1000).alias("url"), F.substring("r", 1, 1).cast("int").alias("label"))


def _weights(w: list[float]) -> Column:
    return F.split(F.lit(",".join(repr(x) for x in w)), ",").cast("array<double>")


def margin(host: Column, path: Column, w: Column) -> Column:
    """Bias (the last weight) plus, for host and path, the sum of the weights of the buckets over the root of their number; paths count less."""
    total = lambda buckets: F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.element_at(w, b + 1)) / F.sqrt(F.size(buckets))
    return F.element_at(w, BUCKETS + 1) + total(grams(host, "h")) + total(grams(path, "p")) * PATH_SHARE


def fitted(table_: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> list[float]:
    """Weights of the BUCKETS features and the bias, by gradient descent with momentum on the logistic loss.

    Rows of null label are left out; a table without rows gives a bias of -20, so that nothing is blocked.
    """
    host, path = host_and_path(F.col("url"))
    few = table_.filter("label is not null").orderBy(F.xxhash64("url", F.lit(7)), "url", "label").limit(MAX_LABELLED)
    rows = few.select("label", grams(host, "h").alias("h"), grams(path, "p").alias("p")).collect()
    if not rows:
        return [0.0] * BUCKETS + [-20.0]
    x, y = np.zeros((len(rows), BUCKETS + 1)), np.array([float(r["label"]) for r in rows])
    for at, r in enumerate(rows):
        for b, share in ((r["h"], 1.0), (r["p"], PATH_SHARE)):
            x[at, b] += share * len(b) ** -0.5
    x[:, BUCKETS] = 1
    w, speed = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(rounds):
        slope = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(y)
        slope[:BUCKETS] += DECAY * w[:BUCKETS]
        speed = MOMENTUM * speed - rate * slope
        w += speed
    return [round(v, 6) for v in w.tolist()]


def url_verdicts(pages: DataFrame, rules=RULES, train: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (the probability of block) of every row."""
    w = _weights(fitted(train if train is not None else labelled(pages.sparkSession)))
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-margin(F.col("host"), F.col("path"), w))))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= BLOCK_AT, "block").otherwise("allow")).alias("verdict"), "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


QUERIES = {"op7_url_filter": op7_url_filter}
