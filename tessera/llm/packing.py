"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Documents are tokenized once and written as pieces (no ids, only lengths and checksums). Only the histogram of piece
lengths, at most `capacity` rows, reaches the driver. There best-fit decreasing runs over it: lengths fall, and a
segment tree over the remaining capacities finds the tightest open bin in logarithmic time; documents of one length are
placed in runs, which gives the bins that placing them one by one gives. Each piece then looks up its run by its rank
among the pieces of its length; ranks come from counts per (length, bucket), so no length is gathered in one task.

Defined cases: a null text is an empty one (one piece, the end mark); a document of at most `capacity` tokens is never
cut; a longer one, of any length, is cut into full pieces with the remainder first; equal rows are placed as often as they occur, in
any order among themselves; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import slices, staged, table

CAPACITY, END_ID = 1024, 2
PIECES_PER_BUCKET = 50_000
#: Texts of these characters only, without long runs of blanks (on which the fast encoder's expression runs out of stack),
#: go the fast way; any other text goes to the tokenizer itself.
PLAIN = r"[^\n\t\r\x20-\x7eÀ-ɏ]|<\|endoftext\|>|\s{4096}"
# Fixed value: the split of the byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts as packed little-endian uint32.

    The vocabulary file's ids are the ranks of its merges, so a rank-based encoder gives the tokenizer's ids several
    times faster; texts with rare characters, whose classes libraries may see differently, go to the tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.rare = Tokenizer.from_file(path), re.compile(PLAIN)
        value = byte_values()
        ranks = {bytes(value[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in value for c in t)}
        marked = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in marked}
        self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if self.rare.search(text) else self.fast.encode_ordinary(text)
        return array("I", ids).tobytes()


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for part in slices(batch, batch.column(1)):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(text or "") + end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    rows += [(doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


class CapacityTree:
    """Segment tree over the capacities 0..capacity; a node holds whether any open bin lies below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def change(self, at: int, by: int) -> None:
        at += self.size
        while at:
            self.open[at] += by
            at //= 2

    def tightest(self, least: int) -> int:
        """The smallest capacity >= least with an open bin, or -1."""
        at = least + self.size
        while not self.open[at]:
            while at & 1:  # a right child has no right sibling: go up
                at //= 2
                if at <= 1:
                    return -1
            if at <= 1:
                return -1
            at += 1
            if at & (at - 1) == 0:
                return -1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first bin, offset) of best-fit decreasing over a histogram of lengths."""
    tree, runs, out, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room < 0:  # no open bin fits: as many new ones as one document each leaves fitting room for no second
                per_bin = capacity // length
                many = -(-left // per_bin)
                first, bins = bins, bins + many
                for level in range(per_bin):
                    n = min(left, many if level < per_bin - 1 else left)
                    out.append((length, rank, n, first, level * length))
                    rank, left = rank + n, left - n
                    if n < many:
                        _open(tree, runs, capacity - level * length, first + n, many - n)
                        many = n
                    if not left:
                        _open(tree, runs, capacity - (level + 1) * length, first, many)
                        break
                continue
            first, n = runs[room].pop()
            take = min(n, left)
            tree.change(room, -n)
            if take < n:
                _open(tree, runs, room, first + take, n - take)
            out.append((length, rank, take, first, capacity - room))
            _open(tree, runs, room - length, first, take)
            rank, left = rank + take, left - take
    return out


def _open(tree: CapacityTree, runs: list, room: int, first: int, n: int) -> None:
    if room > 0 and n > 0:
        runs[room].append((first, n))
        tree.change(room, n)


def placed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = np.array(plan(counts, capacity) or np.empty((0, 5)), np.int64).reshape(-1, 5)
    n_buckets = max(1, -(-sum(counts.values()) // PIECES_PER_BUCKET))
    keyed = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)).cast("int"))
    each = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = keyed.withColumn("r", F.row_number().over(each)).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("r") - 1)
    # The plan has at most some thousand runs a length, whatever the input: its size does not follow the data.
    key = spark.sparkContext.broadcast((runs[:, 0] * (1 << 40) + runs[:, 1], runs))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table_ = key.value
        order = np.argsort(keys)
        keys, table_ = keys[order], table_[order]
        for b in batches:
            if not b.num_rows:
                continue
            rank = b.column(5).to_numpy()
            at = np.searchsorted(keys, b.column(3).to_numpy() * (1 << 40) + rank, "right") - 1
            found = table_[at]
            arrays = [b.column(i) for i in range(5)] + [pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(run, f"{PIECES}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its place: sequence_id and offset."""
    return placed(staged(pieces(docs, tokenizer_path, capacity, end_id)), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
