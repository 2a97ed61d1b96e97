"""N-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric, so regions around pivots can be joined apart. Random pivots do not help for text: all
prose is at a distance near 1 from all of it. The regions here are therefore seeded by rare shingles: sets within the
radius share one of their rarest shingles (with n shingles, one of the n - ceil(t n) + 1 rarest). All sets with such a
shingle in common form a region.

 1. One pass turns texts into shingle sets; shingles are dealt into buckets of bounded size as packed numbers, counted
    over all documents, and only those of two documents or more go back to their documents. A document whose rarest
    shingles are all its own is alone and goes no further.
 2. Equal sets are one class with one member that is compared (copies never meet as pairs).
 3. Regions of the same members are one region. Each picks a pivot, the set with the smallest share of shingles of its own,
    and the distances of its members to the pivot are exact. Members within the radius are linked to it and so to each
    other. A member x beyond the radius may still link to a member y within it, but only if |d(x, p) - d(y, p)| <= radius:
    such boundary members are kept with those outside, the others leave.
 4. What is left of regions with the same first member forms larger regions. One of more than BLOCK sets is divided into the
    Voronoi cells of up to PIVOTS pivots drawn from its own members: every set goes to its nearest pivot, and a copy of it
    to each other pivot q with d(x, q) <= d(x, nearest) + 2 radius and d(x, q) <= (radius of q's cell) + radius. By the
    triangle inequality both sets of a link then meet in the nearest cell of either. Cells are divided in the same way until
    they hold at most BLOCK sets, or until the copies would leave more than half of the comparisons.
 5. The cells that remain are joined in blocks of at most BLOCK sets, each pair of blocks a task of its own, by counting the
    shingles that sets share. Only links that connect something new come back.

So every link between different sets is either taken or implied by links taken: components are exact. Step 3 is linear in
region sizes and settles groups of copies, which lie around few pivots. A cell that no pivots divide (sets that share rare
shingles and are about equally far from each other) costs the square of its distinct sets in step 5.

Defined cases: a null, empty or blank text has an empty set, which links with nothing; with fewer than five words the
whole sequence is one shingle; a row of null id links with nothing and has a null component; repeated rows are one class; an empty table gives an empty result; other columns of the
input are ignored (`representatives` returns them unchanged). Shingles are compared by 64-bit hashes, of which 56 bits travel;
the bucket tells the other 8, some of them only below 256 buckets (2 GB of text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, connected_components, packed_ids, slices, staged, table, unpacked_ids

WIDTH, PERCENT, RADIUS = 5, 75, 0.25
TOKENS_A_BUCKET, TOKENS_A_CHUNK, BLOCK = 1_000_000, 400_000, 512
PIVOTS, SALTS = 16, 32  # SALTS copies of PIVOTS pivots are no more rows than a region of over BLOCK sets has
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95  # odd: it has an inverse modulo 2^64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


class WordHasher:
    """64-bit hashes of all words of many texts at once, from running sums of byte values times powers of BASE."""

    def __init__(self):
        rng = np.random.default_rng(5)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.value[65:91] = self.value[97:123]  # A-Z as a-z
        self.blank = np.zeros(256, bool)
        self.blank[[32, *range(9, 14)]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 1 << 20)
            inverse = pow(BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]), dtype=np.uint64)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of every word."""
        b = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self._grow(len(b))
        held = ~self.blank[b]
        edge = np.flatnonzero(np.diff(held, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.value[b] * self.up[: len(b)], dtype=np.uint64)])
            h = (sums[end] - sums[start]) * self.down[start]
            h = _mixed(h + (end - start).astype(np.uint64))
        last = np.cumsum([len(t) + 1 for t in texts])
        return h, np.searchsorted(last, start, "right")


def shingle_sets(texts: list[bytes], hasher: WordHasher, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, at = hasher.words(texts)
    bounds = np.searchsorted(at, np.arange(len(texts) + 1))
    with np.errstate(over="ignore"):
        grams = h[: max(0, len(h) - width + 1)].copy()
        for j in range(1, width):
            grams = grams * MIX + h[j : len(h) - width + 1 + j]
        grams = _mixed(grams)
        out = []
        for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            if e - s >= width:
                out.append(np.unique(grams[s : e - width + 1]))
            elif e > s:
                whole = np.uint64(e - s)
                for x in h[s:e]:
                    whole = whole * MIX + x
                out.append(_mixed(np.array([whole + np.uint64(1)], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def linked(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= PERCENT * (a + b - shared)


LOW_BITS = np.uint64((1 << 56) - 1)


def _steps(doc: np.ndarray) -> bytes:
    """Ascending document numbers below 65,536 as their steps: all low bytes, then all high bytes."""
    return np.diff(doc.astype(np.int64), prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _numbers(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.uint8).reshape(2, -1).T.copy().view("<u2").ravel(), dtype=np.int64)


PARTS = "bucket int, chunk long, docs boolean, a binary, b binary, c binary"


def _dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed shingles by (bucket, chunk of documents), and one row for each chunk's documents."""
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("docs", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, hasher, held, ids, size = TaskContext.get().partitionId(), 0, WordHasher(), [], [], 0

        def flush() -> pa.RecordBatch:
            n = np.array([len(s) for s in held], np.uint32)
            tokens, doc = np.concatenate(held), np.repeat(np.arange(len(held)), n)
            at = (((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            doc = doc[order]
            tokens, cut, chunk = tokens[order], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=buckets))]), part << 24 | seq
            rows = [(chunk % buckets, chunk, True, packed_ids(ids), b"".join(hashlib.blake2b(s.tobytes(), digest_size=8).digest() for s in held), n.tobytes())]
            for k in np.flatnonzero(np.diff(cut)).tolist():
                t = tokens[cut[k] : cut[k + 1]]
                rows.append((k, chunk, False, t.astype("<u4").tobytes(), (t >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), _steps(doc[cut[k] : cut[k + 1]])))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for piece in slices(batch, batch.column(1), 1_000_000):
                for doc, s in zip(piece.column(0).to_pylist(), shingle_sets(bytes_of(piece.column(1)), hasher), strict=True):
                    held.append(s)
                    ids.append(doc)
                    size += len(s)
                if size >= TOKENS_A_CHUNK or len(held) >= 20_000:
                    yield flush()
                    seq, held, ids, size = seq + 1, [], [], 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PARTS)


def _repeated(key: tuple, t: pa.Table) -> pa.Table:
    """Of one bucket: the shingles of two documents or more, with their number of documents (255 at most) in front."""
    docs, chunk = t.column("docs").to_pylist(), t.column("chunk").to_pylist()
    a, b, c = (t.column(x).to_pylist() for x in "abc")
    own = [i for i, d in enumerate(docs) if not d]
    rows = [(key[0].as_py(), chunk[i], True, a[i], b[i], c[i]) for i, d in enumerate(docs) if d]
    if own:
        full = np.zeros((sum(len(a[i]) // 4 for i in own), 8), np.uint8)
        full[:, :4] = np.concatenate([np.frombuffer(a[i], np.uint8).reshape(-1, 4) for i in own])
        full[:, 4:7] = np.concatenate([np.frombuffer(b[i], np.uint8).reshape(-1, 3) for i in own])
        full = full.view("<u8").ravel()
        order = np.argsort(full)
        ranked = full[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.cumsum(new) - 1
        df = np.empty(len(full), np.int64)
        df[order] = np.bincount(group)[group]
        at = 0
        for i in own:
            n = len(a[i]) // 4
            mine, part = df[at : at + n], full[at : at + n]
            keep = mine >= 2
            if keep.any():
                rows.append((key[0].as_py(), chunk[i], False, part[keep].tobytes(), np.minimum(mine[keep], 255).astype(np.uint8).tobytes(), _steps(_numbers(c[i])[keep])))
            at += n
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("docs", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


DOCS = "doc_id long, n long, cls long, rare int, alone long, shared binary"


def _assembled(t: pa.Table, buckets: int) -> pa.Table:
    """Of one chunk: each document with its repeated shingles, rarest first, where its rarest ones hold any of them."""
    docs, bucket = t.column("docs").to_pylist(), t.column("bucket").to_pylist()
    a, b, c = (t.column(x).to_pylist() for x in "abc")
    i = docs.index(True)
    ids, cls, n = unpacked_ids(a[i]), np.frombuffer(b[i], np.int64), np.frombuffer(c[i], np.uint32).astype(np.int64)
    own = [k for k, d in enumerate(docs) if not d]
    token = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(a[k], np.uint64) & LOW_BITS | np.uint64((bucket[k] << 8) // buckets << 56) for k in own]]).view(np.int64)
    df = np.concatenate([np.empty(0, np.uint8), *[np.frombuffer(b[k], np.uint8) for k in own]])
    doc = np.concatenate([np.empty(0, np.int64), *[_numbers(c[k]) for k in own]])
    order = np.lexsort((token, df, doc))
    token, cut = token[order], np.searchsorted(doc[order], np.arange(len(ids) + 1))
    alone = n - np.diff(cut)
    rare = np.where(n > 0, np.maximum(0, n + (-PERCENT * n) // 100 + 1 - alone), 0)
    shared = [token[s:e].tobytes() if r > 0 and e > s else None for s, e, r in zip(cut, cut[1:], rare, strict=False)]
    held = np.array([x is not None for x in shared], bool)
    return pa.table({"doc_id": ids, "n": n, "cls": cls, "rare": pa.array(np.where(held, rare, 0), pa.int32()), "alone": alone, "shared": pa.array(shared, pa.binary())})


POSTINGS = "token long, cls long, n long, room long"


def _postings(nodes: DataFrame) -> DataFrame:
    """A row for each of a set's rarest shingles; `room` is the number of its shingles that any other document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, alone, rare, shared = (batch.column(i).to_pylist() for i in range(5))
            parts = [np.frombuffer(s, np.int64)[:r] for s, r in zip(shared, rare, strict=True)]
            m = [len(p) for p in parts]
            if sum(m):
                each = [np.repeat(np.array(x, np.int64), m) for x in (cls, n, np.array(n) - np.array(alone))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), *map(pa.array, each)], names=["token", "cls", "n", "room"])

    return nodes.select("cls", "n", "alone", "rare", "shared").mapInArrow(run, POSTINGS)


def _distances(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cls, pivot, d, link) of the pairs, exact over both sets."""
    left = nodes.select("cls", F.col("n").alias("n_a"), F.col("shared").alias("s_a"))
    right = nodes.select(F.col("cls").alias("pivot"), F.col("n").alias("n_b"), F.col("shared").alias("s_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, s_a, n_b, s_b = (batch.column(i).to_pylist() for i in range(2, 6))
            d, link = [], []
            for x, p, y, q in zip(n_a, s_a, n_b, s_b, strict=True):
                both = len(np.intersect1d(np.frombuffer(p, np.int64), np.frombuffer(q, np.int64), assume_unique=True))
                d.append(1 - both / (x + y - both))
                link.append(linked(both, x, y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64()), pa.array(link, pa.bool_())], names=["cls", "pivot", "d", "link"])

    joined = pairs.distinct().join(left, "cls").join(right, "pivot")
    return joined.select("cls", "pivot", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "cls long, pivot long, d double, link boolean")


def _may_link(n_a: str, room_a: str, n_b: str, room_b: str) -> Column:
    """Whether sets of these sizes can link when they share no more than the smaller room."""
    return PERCENT * (F.col(n_a) + F.col(n_b)) <= (100 + PERCENT) * F.least(room_a, room_b)


def _leaf(key: tuple, t: pa.Table) -> pa.Table:
    """Links of a pair of blocks of one region between sets of different labels, as many as connect something new."""
    p, q = key[1].as_py(), key[2].as_py()
    t = t.sort_by("cls")
    cls, n, lab, block = (t.column(c).to_numpy() for c in ("cls", "n", "lab", "block"))
    held = [np.frombuffer(x, np.int64) for x in t.column("shared").to_pylist()]
    a, b = np.flatnonzero(block == p), np.flatnonzero(block == q)
    found = []
    if len(a) and len(b):
        row = np.repeat(np.arange(len(held)), [len(x) for x in held])
        token = np.unique(np.concatenate(held), return_inverse=True)[1]
        wide = int(token.max()) + 1
        in_a, in_b = (np.bincount(token[np.isin(row, x)], minlength=wide) for x in (a, b))
        useful = (in_a > 0) & (in_b > 0) & ((p != q) | (in_a > 1))
        number = np.where(useful, np.cumsum(useful) - 1, -1)[token]
        row, number = row[number >= 0], number[number >= 0]
        order = np.argsort(number, kind="stable")
        row, number = row[order], number[order]
        inter = np.zeros((len(a), len(b)), np.float32)
        for start in range(0, int(useful.sum()), 4096):
            s, e = np.searchsorted(number, [start, start + 4096])
            part = np.zeros((len(held), 4096), np.float32)
            part[row[s:e], number[s:e] - start] = 1
            inter += part[a] @ part[b].T
        total = n[a][:, None] + n[b][None, :]
        near = (100 * inter >= PERCENT * (total - inter)) & (lab[a][:, None] != lab[b][None, :])
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            x, y = find(int(lab[a[i]])), find(int(lab[b[j]]))
            if x != y:
                up[max(x, y)] = min(x, y)
                found.append((int(cls[a[i]]), int(cls[b[j]])))
    columns = list(zip(*found, strict=True)) or [(), ()]
    return pa.table({"cls": pa.array(columns[0], pa.int64()), "pivot": pa.array(columns[1], pa.int64())})


def _cells(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Regions (region, cls, lab) divided into Voronoi cells as far as that saves comparisons, and the links met on the way."""
    done, links = [], []
    while True:
        sizes = rows.groupBy("region").agg(F.count("*").alias("size"), F.min("lab").alias("a"), F.max("lab").alias("b"))
        sizes = staged(sizes.filter("a <> b").select("region", "size"))
        large = sizes.filter(F.col("size") > BLOCK)
        done.append(rows.join(sizes.filter(F.col("size") <= BLOCK), "region", "left_semi"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, links) if links else None
        wide = rows.join(large, "region", "left_semi")
        # Classes are hashes, so the least of a slot is a random member.
        drawn = wide.groupBy("region", F.pmod(F.xxhash64("cls", "region"), F.lit(PIVOTS)).alias("slot")).agg(F.min("cls").alias("pivot"))
        pivots = drawn.select("region", "pivot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        asked = staged(wide.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS))).join(pivots, ["region", "salt"]).drop("salt"))
        d = staged(_distances(asked.select("cls", "pivot"), nodes))
        links.append(d.filter("link and cls <> pivot").select("cls", "pivot"))
        d = asked.join(d, ["cls", "pivot"])
        per_set = d.groupBy("region", "cls", "lab").agg(F.min(F.struct("d", "pivot")).alias("home"), F.collect_list(F.struct("pivot", "d")).alias("each"))  # PIVOTS at most
        per_set = staged(per_set)
        radii = per_set.groupBy("region", F.col("home.pivot").alias("pivot")).agg(F.max("home.d").alias("far"))
        seen = per_set.select("region", "cls", "lab", "home", F.explode("each").alias("e")).select("region", "cls", "lab", "home", "e.pivot", "e.d")
        near = F.col("d") <= F.least(F.col("home.d") + 2 * RADIUS, F.col("far") + RADIUS) + 1e-9
        cells = seen.join(radii, ["region", "pivot"]).filter((F.col("pivot") == F.col("home.pivot")) | near)
        cells = staged(cells.select(F.col("region").alias("parent"), F.xxhash64("region", "pivot").alias("region"), "cls", "lab"))
        work = cells.groupBy("parent", "region").agg(F.count("*").cast("double").alias("m")).groupBy("parent").agg(F.sum(F.col("m") * F.col("m")).alias("work"))
        saved = large.join(work, F.col("region") == F.col("parent")).filter(2 * F.col("work") <= F.col("size").cast("double") * F.col("size"))
        saved = staged(saved.select("parent"))
        done.append(wide.join(saved, F.col("region") == F.col("parent"), "left_anti"))
        rows = cells.join(saved, "parent", "left_semi").select("region", "cls", "lab")


def _links(nodes: DataFrame) -> DataFrame:
    """(cls, pivot) links that connect whatever is connected."""
    rest = staged(_postings(nodes))
    regions = rest.groupBy("token").agg(F.count("*").alias("size"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("members"), F.min(F.struct((-F.col("room") / F.col("n")).alias("o"), "cls", "n", "room")).alias("p"))
    regions = regions.filter("size > 1").groupBy("size", "members").agg(F.min(F.struct("token", "p")).alias("r"))
    regions = staged(regions.select("r.token", F.col("r.p.cls").alias("pivot"), F.col("r.p.n").alias("n_p"), F.col("r.p.room").alias("room_p")))
    members = rest.join(regions, "token").filter(F.col("cls") != F.col("pivot"))
    pairs = members.filter(_may_link("n", "room", "n_p", "room_p")).select("cls", "pivot")
    d = staged(_distances(pairs, nodes))
    links = d.filter("link").select("cls", "pivot")

    # A set's label: the least pivot that it links to, and that one's in turn; sets of one label are connected already.
    one = links.groupBy("cls").agg(F.min("pivot").alias("to"))
    two = one.select(F.col("cls").alias("to"), F.col("to").alias("then"))
    label = one.join(two, "to", "left").select("cls", F.coalesce("then", "to").alias("lab"))

    least = 1 - F.least("room", "room_p") / (F.col("n") + F.col("n_p") - F.least("room", "room_p"))  # where not measured
    seen = members.join(d, ["cls", "pivot"], "left").withColumns({"d": F.coalesce("d", least), "link": F.coalesce("link", F.lit(False))})
    seen = seen.join(label, "cls", "left").select("token", "cls", "n", "room", "d", "link", F.coalesce("lab", "cls").alias("lab"))
    reach = (100 + PERCENT) * F.col("room") / PERCENT - F.col("n")  # the largest partner
    bounds = seen.groupBy("token").agg(F.min(F.when(~F.col("link"), F.col("d"))).alias("out"), F.min("n").alias("least_n"), F.max(reach).alias("most_n"), F.min("lab").alias("lab_a"), F.max("lab").alias("lab_b"), F.min("cls").alias("region"))
    kept = seen.join(bounds.filter("out is not null and lab_a <> lab_b"), "token")
    kept = kept.filter((~F.col("link") | (F.col("d") >= F.col("out") - RADIUS - 1e-9)) & (reach >= F.col("least_n")) & (F.col("n") <= F.col("most_n")))
    rows, met = _cells(staged(kept.select("region", "cls", "lab").distinct()), nodes)
    if met is not None:
        links = links.union(met)
    rows = staged(rows)
    sizes = rows.groupBy("region").agg(F.count("*").alias("size"), F.min("lab").alias("a"), F.max("lab").alias("b")).filter("a <> b")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.join(sizes.select("region", blocks.alias("blocks")), "region").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("region", "cls", "lab", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    far = dealt.join(nodes.select("cls", "n", "shared"), "cls").groupBy("region", "p", "q").applyInArrow(_leaf, "cls long, pivot long")
    return links.union(staged(far)).distinct()


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    size = docs.agg((F.sum(F.length("text")) / 5).alias("n")).first()["n"] or 0
    buckets = int(max(1, -(-size // TOKENS_A_BUCKET)))
    back = _dealt(docs, buckets).groupBy("bucket").applyInArrow(_repeated, PARTS)
    rows = staged(back.groupBy("chunk").applyInArrow(lambda t: _assembled(t, buckets), DOCS))
    reps = staged(rows.filter("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep")))
    nodes = staged(rows.filter("shared is not null and doc_id is not null").dropDuplicates(["cls"]))
    links = _links(nodes)
    name = lambda c: reps.select(F.col("cls").alias(c), F.col("rep").alias(f"rep_{c}"))
    edges = links.join(name("cls"), "cls").join(name("pivot"), "pivot").select("rep_cls", "rep_pivot")
    group = connected_components(edges, "rep_cls", "rep_pivot")
    classes = reps.join(group, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("component_id"))
    full = rows.select("doc_id", "n", "cls").join(classes, "cls", "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


IDS_TO_SEND = 2_000_000  # 16 MB


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs whose id is their component's, one for each id and text, and every row of null id; columns unchanged.

    Texts stay where they are: only ids meet, and where there are at most `IDS_TO_SEND` of them they go to the rows. Rows of
    an id that occurs again are the exception; those with equal texts are one document, whatever their other columns hold.
    """
    gone = staged(components(docs.select("doc_id", "text")).filter("doc_id <> component_id").select("doc_id").distinct())
    again = staged(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    sent = lambda ids: F.broadcast(ids) if ids.count() <= IDS_TO_SEND else ids
    left = docs.join(sent(gone), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return left
    again = sent(again)
    one = left.join(again, "doc_id", "left_semi").withColumn("__key", F.sha2("text", 256)).dropDuplicates(["doc_id", "__key"])
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}

_BLANKS = r"[^\x20\x09-\x0D]+"
ORACLES = {
    "op8_jaccard_join": f"""with recursive
    words as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANKS}') as w from documents),
    sets as materialized (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < {WIDTH} then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) end as s from words),
    grams as materialized (select doc_id, len(s) as n, unnest(s) as g from sets),
    links as materialized (select a.doc_id as a, b.doc_id as b from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id
        group by a.doc_id, b.doc_id having 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
    ab as materialized (select a, b from links union select b, a from links),
    reach as (select a as node, a as c from ab union select ab.b, reach.c from reach join ab on reach.node = ab.a),
    least as materialized (select node, min(c) as c from reach group by node)
    select doc_id, len(s)::bigint as n_shingles, coalesce(c, doc_id) as component_id from sets left join least on node = doc_id"""
}
