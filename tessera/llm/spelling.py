"""Spelling variants: words one edit apart, each word's likely intended form, and the root of its chain of forms.

Words are counted over whole texts. They are dealt into shards by length, and each shard becomes a compact trie: nodes in
order of depth with one byte of label each, branches of a single word stored as tails. The tries are sent to all tasks, a
bounded number of bytes at a time, and the automaton that accepts what is one edit from a word is run over every shard
depth-first: it goes down the word's own path, leaves it once by an inserted, deleted or replaced code point, and has to
meet the word's rest exactly from there. A shard holds its words backwards too, for edits in the first half. Shards without a word of a length within one of the word's are passed over: the
automaton accepts nothing in them. A task gives one row a word, so no pair of words is ever listed.

All code points of a word lie below U+0100, so one byte stands for one code point, and bytes sort as code points do.

Defined cases: a null text has no words; a null id is written as the empty string where words are hashed; repeated rows
count again; of equally frequent near words the smallest in code-point order is the form; a run of any length is one word
(a word too long for a shard has one of its own); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, slices, staged, table

MIN_POINTS, MIN_COUNT, FORM_RATIO, DELETE_EVERY = 7, 2, 10, 31
RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: A shard holds about so many words and characters; tries of at most WAVE_BYTES (or one trie) are broadcast at a time.
SHARD_WORDS, SHARD_CHARS, WAVE_BYTES = 250_000, 4_000_000, 96_000_000
#: Words of a task's count table before it is passed on, and words of a task that searches.
COUNTED, SEARCHED = 200_000, 10_000


def shortened(run: str, seed: int) -> str:
    """The run without the code point that its hash names, where the hash is divisible by DELETE_EVERY."""
    h = zlib.crc32(run.encode(), seed)
    if h % DELETE_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: every word of at least MIN_POINTS code points that occurs at least MIN_COUNT times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for part in slices(batch, batch.column(1)):
                for doc, text in zip(part.column(0).to_pylist(), bytes_of(part.column(1)), strict=True):
                    seed = zlib.crc32(f"{doc or ''}:".encode())
                    for w, n in Counter(RUN.findall(text.translate(LOWER).decode())).items():
                        if len(w) >= MIN_POINTS and len(w := shortened(w, seed)) >= MIN_POINTS:
                            counts[w] += n
                if len(counts) >= COUNTED:
                    yield out()
        yield out()

    found = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


class Trie:
    """Words as a compact trie; `dump` and `load` turn it into bytes and back.

    Node v has the children first[v] .. first[v + 1] - 1, in the order of their labels; word[v] is the number of the word
    that ends at v, or -1. A node without children is the end of one word, whose remaining letters are its tail.
    """

    def __init__(self, label: bytes, first: array, word: array, tail_at: array, tails: bytes, n: array):
        self.label, self.first, self.word, self.tail_at, self.tails, self.n = label, first, word, tail_at, tails, n

    @classmethod
    def build(cls, words: list[bytes], n: list[int]) -> Trie:
        """From distinct sorted words and their counts."""
        label, first, word, tail_at, tails = bytearray(b"\0"), array("I", [1]), array("i"), array("I", [0]), bytearray()
        level, made = [(0, len(words))] if words else [], 1
        depth = 0
        while level:
            below = []
            for lo, hi in level:
                ends = len(words[lo]) == depth
                if hi - lo == 1:
                    word.append(lo)
                    tails += words[lo][depth:]
                else:
                    word.append(lo if ends else -1)
                    at = lo + ends
                    while at < hi:
                        c, to = words[at][depth], at + 1
                        while to < hi and words[to][depth] == c:
                            to += 1
                        label.append(c)
                        below.append((at, to))
                        made += 1
                        at = to
                first.append(made)
                tail_at.append(len(tails))
            level, depth = below, depth + 1
        return cls(bytes(label), first, word, tail_at, bytes(tails), array("q", n))

    def dump(self) -> bytes:
        parts = [self.label, *(x.tobytes() for x in (self.first, self.word, self.tail_at)), self.tails, self.n.tobytes()]
        return np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> Trie:
        at, parts = 48, []
        for size in np.frombuffer(data, "<i8", 6).tolist():
            parts.append(data[at : at + size])
            at += size
        return cls(parts[0], array("I", parts[1]), array("i", parts[2]), array("I", parts[3]), parts[4], array("q", parts[5]))

    def _exact(self, v: int, w: bytes, i: int) -> int:
        """Number of the word that goes from v by w[i:], or -1."""
        first, label, size = self.first, self.label, len(w)
        while True:
            a, b = first[v], first[v + 1]
            if a == b:
                s, e = self.tail_at[v], self.tail_at[v + 1]
                return self.word[v] if e - s == size - i and self.tails[s:e] == w[i:] else -1
            if i == size:
                return self.word[v]
            v = label.find(w[i], a, b)
            if v < 0:
                return -1
            i += 1

    def near(self, w: bytes, start: int = 0) -> dict[bytes, int]:
        """The words one edit from w and their counts: all whose edit lies at `start` or later."""
        first, label, word, n, size = self.first, self.label, self.word, self.n, len(w)
        found: dict[bytes, int] = {}
        if not n:
            return found
        v = i = 0
        while i < start:  # no edit so far: the path of w itself
            a, b = first[v], first[v + 1]
            if a == b:
                break
            v = label.find(w[i], a, b)
            if v < 0:
                return found
            i += 1
        while True:
            a, b = first[v], first[v + 1]
            if a == b:  # one word is left: its tail against the rest of w
                tail, rest = self.tails[self.tail_at[v] : self.tail_at[v + 1]], w[i:]
                if one_edit(tail, rest):
                    found[w[:i] + tail] = n[word[v]]
                return found
            here = w[i] if i < size else -1
            after = w[i + 1] if i + 1 < size else -1
            for u in range(a, b):
                c = label[u]
                if c == here:
                    continue
                c1, c2 = first[u], first[u + 1]
                if i < size:  # c in place of w[i]
                    if (c1 == c2 or (word[u] >= 0 if after < 0 else label.find(after, c1, c2) >= 0)) and (k := self._exact(u, w, i + 1)) >= 0:
                        found[w[:i] + bytes((c,)) + w[i + 1 :]] = n[k]
                    if (c1 == c2 or label.find(here, c1, c2) >= 0) and (k := self._exact(u, w, i)) >= 0:  # c before w[i]
                        found[w[:i] + bytes((c,)) + w[i:]] = n[k]
                elif word[u] >= 0 and (k := self._exact(u, w, i)) >= 0:  # c after the end
                    found[w + bytes((c,))] = n[k]
            if i == size:
                return found
            if after != here and (k := self._exact(v, w, i + 1)) >= 0:  # without w[i]; of a run of one letter the last
                found[w[:i] + w[i + 1 :]] = n[k]
            v = label.find(here, a, b)
            if v < 0:
                return found
            i += 1


class Shard:
    """The words of a shard as a trie of the words and one of the words read backwards.

    An edit in the second half of a word is found in the first, one in the first half in the second, so that neither walk
    leaves the word's own path near the root, where branches are many.
    """

    def __init__(self, forward: Trie, backward: Trie):
        self.forward, self.backward = forward, backward

    @classmethod
    def build(cls, rows: list[tuple[bytes, int]]) -> Shard:
        tries = []
        for those in (sorted(rows), sorted((w[::-1], n) for w, n in rows)):
            tries.append(Trie.build([w for w, _ in those], [n for _, n in those]))
        return cls(*tries)

    def dump(self) -> bytes:
        first = self.forward.dump()
        return len(first).to_bytes(8, "little") + first + self.backward.dump()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        at = 8 + int.from_bytes(data[:8], "little")
        return cls(Trie.load(data[8:at]), Trie.load(data[at:]))

    def near(self, w: bytes) -> dict[bytes, int]:
        """The words one edit from w and their counts."""
        half = len(w) // 2
        found = self.forward.near(w, half)
        for x, n in self.backward.near(w[::-1], len(w) - half).items():
            found[x[::-1]] = n
        return found


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced byte."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    low, high = 0, len(b)  # length of the common prefix, by halves
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + 1 :] == b[low + (len(a) == len(b)) :]


def shard_plan(lengths: list[tuple[int, int]], most_words: int = SHARD_WORDS, most_chars: int = SHARD_CHARS) -> list[tuple[int, int, int]]:
    """(length, first shard, shards) from (length, words) in order: short lengths share a shard, long lists of one length are split."""
    out, shard, words, chars = [], 0, 0, 0
    for length, n in lengths:
        if words and (words + n > most_words or chars + n * length > most_chars):
            shard, words, chars = shard + 1, 0, 0
        parts = max(-(-n // most_words), -(-n * length // most_chars))
        out.append((length, shard, parts))
        if parts > 1:
            shard, words, chars = shard + parts, 0, 0
        else:
            words, chars = words + n, chars + n * length
    return out


def shards(words: DataFrame, most_words: int = SHARD_WORDS, most_chars: int = SHARD_CHARS) -> DataFrame:
    """shard, shortest, longest, size, trie: every word in one trie of bounded size."""
    points = F.length("word")
    lengths = words.groupBy(points.alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()  # a row a length
    plan = words.sparkSession.createDataFrame(shard_plan([tuple(r) for r in lengths], most_words, most_chars), "length int, shard bigint, parts bigint")
    dealt = words.withColumn("length", points).join(plan, "length").select((F.col("shard") + F.pmod(F.xxhash64("word"), F.col("parts"))).alias("shard"), "word", "n")

    def build(t: pa.Table) -> pa.Table:
        rows = [(w.encode("latin-1"), n) for w, n in zip(t.column("word").to_pylist(), t.column("n").to_pylist(), strict=True)]
        sizes = [len(w) for w, _ in rows]
        data = Shard.build(rows).dump()
        return pa.table({"shard": t.column("shard")[:1], "shortest": [min(sizes)], "longest": [max(sizes)], "size": [len(data)], "trie": pa.array([data], pa.binary())})

    return dealt.groupBy("shard").applyInArrow(build, "shard bigint, shortest bigint, longest bigint, size bigint, trie binary")


def waves(sizes: list[tuple[int, int, int, int]], most: int = WAVE_BYTES) -> list[list[tuple[int, int, int, int]]]:
    """(shard, shortest, longest, size) in groups of at most `most` bytes, one shard at least."""
    out: list[list] = []
    total = 0
    for s in sorted(sizes):
        if not out or total + s[3] > most:
            out.append([])
            total = 0
        out[-1].append(s)
        total += s[3]
    return out


def nearest(words: DataFrame, tries: DataFrame, most: int = WAVE_BYTES) -> DataFrame:
    """word, n, n_near, form_n, form: how many words are one edit away, and the most frequent of them."""
    spark = words.sparkSession
    sizes = [tuple(r) for r in tries.select("shard", "shortest", "longest", "size").collect()]  # a row for SHARD_WORDS words
    total = words.count()
    out = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("form_n"), F.lit(None).cast("string").alias("form"))
    for wave in waves(sizes, most):
        ids = [s for s, *_ in wave]
        low, high = min(s[1] for s in wave) - 1, max(s[2] for s in wave) + 1
        # At most WAVE_BYTES, or one trie of at most SHARD_WORDS words and SHARD_CHARS letters (or of one longer word).
        sent = spark.sparkContext.broadcast([(r["shortest"], r["longest"], bytes(r["trie"])) for r in tries.filter(F.col("shard").between(ids[0], ids[-1])).collect()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            each = [(a - 1, b + 1, Shard.load(t)) for a, b, t in sent.value]
            for batch in batches:
                counts, forms, form_ns = [], [], []
                for word in batch.column(0).to_pylist():
                    w, n, best = word.encode("latin-1"), 0, (0, b"")
                    for a, b, trie in each:
                        if a <= len(w) <= b:
                            found = trie.near(w)
                            n += len(found)
                            best = min([best, *((-k, x) for x, k in found.items())])
                    counts.append(n)
                    form_ns.append(-best[0] if n else None)
                    forms.append(best[1].decode("latin-1") if n else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(form_ns, pa.int64()), pa.array(forms, pa.string())], names=["word", "n", "n_near", "form_n", "form"])

        asked = words.filter(F.length("word").between(low, high)).repartition(max(1, -(-total // SEARCHED)), "word")
        out = out.union(staged(asked.mapInArrow(run, "word string, n bigint, n_near bigint, form_n bigint, form string")))
        sent.destroy()
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), "form")))
    return out.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("s")).select("word", "n", "n_near", (-F.col("s.m")).alias("form_n"), "s.form")


def roots(links: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms of each word that has one (word, form).

    Every step of a chain leads to a word FORM_RATIO times as frequent, so chains have no circle; each round doubles the
    length of what is followed.
    """
    now = links.select("word", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = staged(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, most_words: int = SHARD_WORDS, most: int = WAVE_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs."""
    words = staged(word_counts(docs))
    found = nearest(words, staged(shards(words, most_words)), most)
    likely = F.col("form_n") >= FORM_RATIO * F.col("n")
    found = staged(found.select("word", F.when(likely, F.col("form")).alias("form"), "n", "n_near", F.when(likely, F.col("form_n")).alias("form_n")))
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
SQL = r"""with recursive bits as materialized (select list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as t, i from (select unnest(range(256)) as i)),
    crc as materialized (select list(t order by i) as t from bits),
    runs as (select coalesce(doc_id::varchar, '') as d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as w from documents),
    each as (select d, w, count(*) as n from runs where length(w) >= 7 group by all),
    bytes as (select d, w, n, list_prepend(4294967295::bigint, flatten(list_transform(string_split(d || ':' || w, ''), lambda x: case when ord(x) < 128 then [ord(x)::bigint] else [(192 + ord(x) // 64)::bigint, (128 + ord(x) % 64)::bigint] end))) as b from each),
    hashed as (select w, n, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) as h from bytes, crc),
    cut as (select case when h % 31 = 0 then substr(w, 1, (h % length(w))::bigint) || substr(w, (h % length(w))::bigint + 2) else w end as word, n from hashed),
    words as materialized (select word, sum(n)::bigint as n from cut where length(word) >= 7 group by word having sum(n) >= 2),
    less as materialized (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as short from (select word, unnest(range(1, length(word) + 1)) as i from words)),
    pairs as materialized (select a.word as a, b.word as b from less a join less b on a.short = b.short and a.i = b.i and a.word <> b.word union select l.word, w.word from less l join words w on l.short = w.word union select w.word, l.word from less l join words w on l.short = w.word),
    ranked as (select a, b, k.n as n, count(*) over (partition by a) as n_near, row_number() over (partition by a order by k.n desc, encode(b)) as r from pairs join words k on k.word = b),
    best as materialized (select w.word, w.n, coalesce(r.n_near, 0) as n_near, case when r.n >= 10 * w.n then r.b end as form, case when r.n >= 10 * w.n then r.n end as form_n from words w left join ranked r on r.a = w.word and r.r = 1),
    chain as (select word, coalesce(form, word) as at from best union select c.word, b.form from chain c join best b on b.word = c.at where b.form is not null),
    ends as (select c.word, c.at as root from chain c join best b on b.word = c.at where b.form is null)
    select word, form, root, n, n_near, form_n from best join ends using (word)"""

ORACLES = {"op12_spelling_variants": SQL}
