"""Document fingerprints by consistent weighted sampling of a text's words.

A text is a bag of words with their counts as weights. For every word w and every sample k three numbers are drawn from a
hash of (w, k) alone: r and c from a gamma distribution of shape 2, and b uniform. A word of weight x then has the level
t = floor(ln x / r + b) and the rank value ln c - r (t - b) - r; the sample of a text is the word of the least value,
with its level. Two texts agree in a sample with the probability sum(min) / sum(max) of their weights, the generalised
Jaccard similarity, so the share of equal samples estimates it. A fingerprint keeps 16 bits of a hash of each sample.

The next document is found without one global sort: ids are dealt into ranges by approximate quantiles, each range is
sorted by itself, and the first row of a range is sent to the range before it (that of the first range to the last one)
as a guest. Texts are shuffled once and read as a stream; no range is held in memory.

Defined cases: a null text is an empty one; a text without words has the fingerprint of `EMPTY` marks, equal to that of
other such texts only; documents follow each other by id (null ids first), those of one id by their text in code-point
order, so repeated rows follow each other; the only document is its own next one; texts of any length are read whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices, table

SAMPLES = 128
#: A range of ids holds about so many bytes of text; beyond MAX_RANGES ranges (their bounds are held by the driver) they grow.
RANGE_BYTES, MAX_RANGES = 8_000_000, 100_000
#: Sampled values of so many (word, weight) pairs are kept by a task, 1 KB each; older ones are drawn again.
CACHED = 24_000
#: Distinct words taken at a time, so that a text of millions of words needs little memory.
CHUNK = 4_096
EMPTY = "f" * 4
#: Of 65,536 parts of c's distribution the lowest ones, within which a variate is placed exactly.
FINE = 256

U = np.uint64
STEP, MIX_A, MIX_B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


def term_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def gamma_2_at(p: np.ndarray) -> np.ndarray:
    """The number below which a gamma variate of shape 2 lies with probability p = 1 - (1 + x) exp(-x), by halving."""
    low, high = np.zeros(len(p)), np.full(len(p), 60.0)
    for _ in range(90):
        mid = (low + high) / 2
        below = -np.expm1(-mid) - mid * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Variates at the middles of 65,536 equal parts, their logarithms, and logarithms of small p and of the variates there."""
    middle = gamma_2_at((np.arange(65_536) + 0.5) / 65_536)
    small = np.linspace(-42 * np.log(2), np.log(FINE / 65_536), 4_096)
    return middle.astype(np.float32), np.log(middle).astype(np.float32), small, np.log(gamma_2_at(np.exp(small)))


def variates(keys: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c, b and a mark of 16 bits for each term and sample, from a hash of both.

    Gamma variates are taken from a table of quantiles; the smallest ones of c, which decide, are worked out from 24 more bits.
    """
    odd = _mixed((np.arange(samples, dtype=np.uint64) + U(1)) * STEP) | U(1)
    x = keys[:, None] * odd[None]
    x ^= x >> U(32)
    x *= MIX_A
    x ^= x >> U(29)
    lanes = x.view(np.uint16).reshape(*x.shape, 4)
    quantiles, logs, small, small_logs = _tables()
    at = lanes[..., 1].ravel()
    log_c = logs.take(at)
    low = np.flatnonzero(at < FINE)
    more = ((x.ravel()[low] * MIX_B) >> U(40)).astype(np.float64) + 0.5
    log_c[low] = np.interp(np.log((at[low] + more * 2.0**-24) / 65_536), small, small_logs)
    b = lanes[..., 2].astype(np.float32)
    b *= np.float32(2.0**-16)
    return quantiles.take(lanes[..., 3]), log_c.reshape(x.shape), b, lanes[..., 0]


def sampled_values(keys: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """For each (term, weight) and sample the value whose minimum picks the term, as an ordered number.

    Its upper bits order the values, its lower 16 are the mark of (term, level) that enters the fingerprint.
    """
    r, value, b, mark = variates(keys, samples)
    mark = mark.astype(np.uint64)
    more = np.flatnonzero(weights != 1)  # the level of a weight of 1 is 0
    if len(more):
        t = np.floor(np.log(weights[more]).astype(np.float32)[:, None] / r[more] + b[more])
        b[more] -= t
        mark[more] = (mark[more] + t.astype(np.int64).astype(np.uint64) * U(40503)) & U(0xFFFF)
    b -= np.float32(1)
    b *= r
    value += b  # ln c - r (t - b) - r
    bits = value.view(np.int32)
    ordered = (bits ^ (bits >> 31 | np.int32(-(2**31)))).view(np.uint32).astype(np.uint64)  # same order as the numbers
    ordered <<= U(16)
    ordered |= mark
    return ordered


class Sampler:
    """Fingerprints of texts; values of frequent (word, count) pairs are kept."""

    def __init__(self, samples: int = SAMPLES, cached: int = CACHED):
        self.samples, self.room = samples, cached
        self.rows: dict[tuple[bytes, int], int] = {}
        self.held = np.empty((cached, samples), np.uint64)

    def _values(self, terms: list[tuple[bytes, int]]) -> np.ndarray:
        """Least value of each sample over the terms."""
        if len(self.rows) + len(terms) > self.room:
            self.rows.clear()
        at = list(map(self.rows.get, terms))
        new = [t for t, k in zip(terms, at, strict=True) if k is None]
        least = self.held[[k for k in at if k is not None]].min(axis=0) if len(new) < len(terms) else None
        if new:
            keys = np.array([term_key(w) for w, _ in new], np.uint64)
            weights = np.array([n for _, n in new], np.float64)
            first = len(self.rows)
            values = self.held[first : first + len(new)] = sampled_values(keys, weights, self.samples)
            self.rows.update(zip(new, range(first, first + len(new)), strict=True))
            least = values.min(axis=0) if least is None else np.minimum(least, values.min(axis=0))
        return least

    def fingerprint(self, text: bytes) -> str:
        terms = list(Counter(text.split()).items())
        if not terms:
            return EMPTY * self.samples
        least = None
        step = min(CHUNK, self.room)
        for s in range(0, len(terms), step):
            part = self._values(terms[s : s + step])
            least = part if least is None else np.minimum(least, part)
        return (least & U(0xFFFF)).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal samples; texts without words are like each other only."""
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    if (a == EMPTY * len(x)) != (b == EMPTY * len(y)):
        return 0.0
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by the first as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def ranged(docs: DataFrame) -> DataFrame:
    """range, guest, doc_id, text: rows by ranges of ids, and the first rows of each range once more as guests of the range before."""
    from pyspark.ml.feature import Bucketizer

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_bytes = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(MAX_RANGES, n_bytes // RANGE_BYTES + 1))
    cuts = base.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else None
    bounds = sorted({float(x) for x in cuts or ()})
    if bounds:
        by_id = Bucketizer(splits=[-np.inf, *bounds, np.inf], inputCol="id", outputCol="at", handleInvalid="keep").transform(base.withColumn("id", F.col("doc_id").cast("double")))
        base = by_id.select(F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("at").cast("int")).alias("range"), "doc_id", "text")
    else:
        base = base.select(F.when(F.col("doc_id").isNull(), -1).otherwise(0).alias("range"), "doc_id", "text")
    firsts = sorted((r["range"], r["least"]) for r in base.groupBy("range").agg(F.min("doc_id").alias("least")).collect())  # at most MAX_RANGES + 1 rows
    before = [(r, least, firsts[k - 1][0]) for k, (r, least) in enumerate(firsts)]
    # At most MAX_RANGES + 1 rows of some 20 bytes: 2 MB.
    known = F.broadcast(docs.sparkSession.createDataFrame(before, "range int, least bigint, before int"))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    guest = F.when(F.col("doc_id").eqNullSafe(F.col("least")), F.struct(F.col("before").alias("range"), F.lit(True).alias("guest")))
    out = base.join(known, "range").select(F.explode(F.array_compact(F.array(own, guest))).alias("s"), "doc_id", "text").select("s.range", "s.guest", "doc_id", "text")
    return out.repartition(n, "range").sortWithinPartitions("range", "guest", "doc_id", "text")


def fingerprinted(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, and how like the edited and the next text are to each document."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, sampler, last = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], Sampler(samples), None
        for batch in batches:
            for part in slices(batch, batch.column(3)):
                out = []
                for guest, doc, text in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    if guest and last is None:  # only the first guest of a range is needed
                        continue
                    mark = sampler.fingerprint(text.encode())
                    if last is not None:
                        id_, before, own = last
                        changed = edited(before, text).encode()
                        other = sampler.fingerprint(changed)
                        out.append((id_, len(before), hashlib.sha256(changed).hexdigest(), own, other, likeness(own, other), likeness(own, mark)))
                    last = None if guest else (doc, text, mark)
                columns = list(zip(*out, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return ranged(docs).mapInArrow(run, FIELDS)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))


QUERIES = {"op13_fingerprints": op13_fingerprints}
