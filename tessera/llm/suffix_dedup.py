"""Removal of repeated byte strings by merging the Burrows-Wheeler transforms of shards.

Texts are cut into phrases at places that depend on nearby bytes alone, so equal strings are cut alike: in each window of
`WINDOW` places the one with the least hash of `GRAM` bytes is an anchor. A string of `LENGTH` bytes holds an anchor in its
first `WINDOW` places, and the cuts of the next `CORE` bytes and more are the same in all its copies.

 1. A shard holds the phrases of some MB of whole documents. Its suffixes (read backwards, so that they grow to the right)
    are sorted once, which gives its transform: for each row the phrase that comes next and the row it leads to.
 2. Shards are merged by refining the interleave: a block is a string of phrases with one interval of rows in each shard.
    The blocks in order, with their widths in each shard, are the interleave of the merged transform, run by run. Every round
    follows the transforms until all blocks are `STEP` bytes longer, sums the widths of equal blocks over the shards and
    drops those of width one; the length of the block is the common prefix so far. No suffix is sorted again, and a string
    that a third of all documents hold is one interval a shard. Blocks of `CORE` bytes are complete, after at most
    CORE / STEP rounds however short the phrases are.
 3. The rows of complete blocks are places where strings of `LENGTH` bytes may repeat. An exact check follows: anchors whose
    whole surroundings repeat are settled at once; for the others each window of `LENGTH` bytes is compared by its hash.

Shards lie in a table bucketed by shard, so every step meets its shard without moving it; between steps only packed hashes
move, dealt by hash into buckets of bounded size. One string can stand in every shard; where there are more than
`SHARDS_A_GROUP` shards, equal strings are therefore counted within groups of shards first and then over the groups.

Defined cases: a null text is empty; a row of null id is a document like any other, with a null id in the result; a document shorter than `LENGTH` has nothing removed; repeated rows are separate
documents and so remove each other's strings; an empty table gives an empty result; other columns are ignored. Strings are
compared by 64-bit hashes. A document is never split: its bytes, and those of the shard that it ends, meet in one task and
must stay below 2 GB, the limit of a cell. `text` is what is left, without bytes that no longer form a character.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, packed_ids, slices, staged, table, unpacked_ids

LENGTH, WINDOW, GRAM = 400, 96, 16
CORE = LENGTH + 2 - 3 * WINDOW - GRAM
STEP = 25
SHARDS_A_GROUP = 4096
PIECE = 1 << 20
SHARD_BYTES, BYTES_A_TABLE_BUCKET, BYTES_A_BUCKET = 1_200_000, 16_000_000, 48_000_000
BASE, MIX = 0xD1342543DE82EF95, np.uint64(0x9E3779B97F4A7C15)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any substrings of a byte array, from running sums of byte values times powers of BASE."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, b: np.ndarray):
        cls, n = type(self), len(b)
        if len(cls._up) <= n:
            size = max(n + 1, SHARD_BYTES * 5 // 4)
            with np.errstate(over="ignore"):
                cls._up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, BASE, np.uint64)]), dtype=np.uint64)
                cls._down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, pow(BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
        value = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(value[b] * cls._up[:n], dtype=np.uint64, out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self._down[start] + (end - start).astype(np.uint64))


def anchors(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window start, number of the document) of every anchor, in text order."""
    n, span = len(b), WINDOW + GRAM - 1
    if n < span:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    rolling = Rolling(b)
    m = n - GRAM + 1
    h = _mixed((rolling.sums[GRAM:] - rolling.sums[:m]) * rolling._down[:m])
    low, chosen = np.uint64((1 << 24) - 1), np.empty(m - WINDOW + 1, np.int64)  # by window start
    for s in range(0, len(chosen), PIECE):
        part = h[s : s + PIECE + WINDOW - 1]
        key = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))  # of equal hashes the last place
        width = 1
        while width * 2 <= WINDOW:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < WINDOW:
            key = np.minimum(key[: len(key) - (WINDOW - width)], key[WINDOW - width :])
        chosen[s : s + PIECE] = s + (low - (key & low)).astype(np.int64)
    start = np.arange(len(chosen))
    doc = np.searchsorted(ends, start, "right")
    valid = start + span <= ends[doc]
    chosen, start, doc = chosen[valid], start[valid], doc[valid]
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    return chosen[first], start[first], doc[first]


def sorted_rows(sym: np.ndarray) -> np.ndarray:
    """Phrase numbers in the order of their strings read backwards, to the start of the document; 0 ends a document."""
    n = len(sym)
    rank = np.unique(sym, return_inverse=True)[1].astype(np.int64)
    ended = sym == 0
    last_end = np.maximum.accumulate(np.where(ended, np.arange(n), -1))  # the string may not pass an end to its left
    reach = np.arange(n) - np.where(ended, np.arange(n) - 0, last_end)
    h = 1
    while True:
        before = np.full(n, -1, np.int64)
        before[h:] = rank[:-h]
        before[reach <= h] = -1
        new = np.unique(rank * (n + 2) + before + 1, return_inverse=True)[1].astype(np.int64)
        same = int(new.max()) == int(rank.max())
        rank, h = new, 2 * h
        if same or h >= n:
            break
    return np.argsort(rank, kind="stable")


SHARDS = "shard long, text binary, ids binary, ends binary, place binary, back binary, sym binary, rows binary"


def _shard(shard: int, ids: list, texts: list[bytes]) -> tuple:
    joined = b"".join(texts)
    b, ends = np.frombuffer(joined, np.uint8), np.cumsum([len(t) for t in texts])
    place, first, doc = anchors(b, ends)
    sym = np.zeros(len(place), np.uint64)
    if len(place) > 1:
        same = np.flatnonzero(doc[1:] == doc[:-1])
        sym[same] = Rolling(b).hashes(place[same], place[same + 1]) | np.uint64(1)
    packed = (place.astype(np.uint32), (place - first).astype(np.uint8), sym, sorted_rows(sym).astype(np.uint32) if len(sym) else np.empty(0, np.uint32))
    return (shard, joined, packed_ids(ids), ends.astype(np.int64).tobytes(), *(x.tobytes() for x in packed))


def _sharded(docs: DataFrame) -> DataFrame:
    types = [pa.int64(), *[pa.binary()] * 7]
    names = [x.split()[0] for x in SHARDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        batch_of = lambda row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)
        for batch in batches:
            for piece in slices(batch, batch.column(1), SHARD_BYTES // 4):
                ids += piece.column(0).to_pylist()
                more = bytes_of(piece.column(1))
                texts += more
                size += sum(map(len, more))
                if size >= SHARD_BYTES:
                    yield batch_of(_shard(part << 24 | seq, ids, texts))
                    seq, ids, texts, size = seq + 1, [], [], 0
        if ids:
            yield batch_of(_shard(part << 24 | seq, ids, texts))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SHARDS)


class Tree:
    """One shard's transform: of each row the next phrase and the row that it leads to."""

    def __init__(self, row: dict):
        self.place, self.sym, self.rows = np.frombuffer(row["place"], np.uint32), np.frombuffer(row["sym"], np.uint64), np.frombuffer(row["rows"], np.uint32).astype(np.int64)
        n = len(self.rows)
        self.at = np.empty(n, np.int64)
        self.at[self.rows] = np.arange(n)

    def start(self) -> np.ndarray:
        """(hash, low, width) of the one-phrase blocks."""
        s = self.sym[self.rows]
        first = np.flatnonzero(np.diff(s, prepend=np.uint64(0), append=np.uint64(0)) != 0) if len(s) else np.empty(0, np.int64)
        cut = np.unique(np.concatenate([first, [0, len(s)]])) if len(s) else np.zeros(1, np.int64)
        low, width = cut[:-1], np.diff(cut)
        keep = s[low] != 0 if len(s) else np.empty(0, bool)
        return _blocks(s[low[keep]], low[keep], width[keep])

    def extended(self, blocks: np.ndarray) -> np.ndarray:
        """The blocks longer by one phrase, by one step of the transform."""
        which = np.repeat(np.arange(len(blocks)), blocks["width"])
        row = np.repeat(blocks["low"], blocks["width"]) + _within(blocks["width"])
        after = self.rows[row] + 1
        has = after < len(self.sym)
        which, after = which[has], after[has]
        s = self.sym[after]
        has = s != 0
        which, s, to = which[has], s[has], self.at[after[has]]
        if not len(s):
            return _blocks(s, to, to)
        begin = np.flatnonzero(np.diff(which, prepend=-1))  # rows of a block stand together
        varied = np.repeat(np.maximum.reduceat(s, begin) != np.minimum.reduceat(s, begin), np.diff(np.append(begin, len(s))))
        if varied.any():  # only blocks with several continuations are sorted
            at = np.flatnonzero(varied)
            order = at[np.lexsort((s[at], which[at]))]
            which[at], s[at], to[at] = which[order], s[order], to[order]
        new = np.ones(len(s), bool)
        new[1:] = (which[1:] != which[:-1]) | (s[1:] != s[:-1])
        first = np.flatnonzero(new)
        width = np.diff(np.append(first, len(s)))
        return _blocks(_mixed(blocks["hash"][which[first]] * MIX + s[first]), np.minimum.reduceat(to, first), width)

    def reached(self, blocks: dict[int, np.ndarray], least: int) -> dict[int, np.ndarray]:
        """The blocks, by number of phrases, longer by as many phrases as give each `least` bytes."""
        out: dict[int, np.ndarray] = {}
        waiting = {p: b for p, b in blocks.items() if len(b)}
        while waiting:
            p = min(waiting)
            b = waiting.pop(p)
            long = self.bytes_long(b, p) >= least
            if long.any():
                out[p] = b[long]
            if len(more := self.extended(b[~long])):
                waiting[p + 1] = np.concatenate([waiting[p + 1], more]) if p + 1 in waiting else more
        return out

    def bytes_long(self, blocks: np.ndarray, phrases: int) -> np.ndarray:
        last = self.rows[blocks["low"]]
        return self.place[last + 1].astype(np.int64) - self.place[last - phrases + 1]


BLOCK = np.dtype([("hash", "<u8"), ("low", "<i8"), ("width", "<i8")])


def _blocks(h: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    out = np.empty(len(h), BLOCK)
    out["hash"], out["low"], out["width"] = h, low, width
    return out


WIRE = np.dtype([("low", "<u4"), ("width", "<u4")])


def _sent(blocks: np.ndarray) -> np.ndarray:
    """Intervals of blocks as they travel, beside their hashes."""
    out = np.empty(len(blocks), WIRE)
    out["low"], out["width"] = blocks["low"], blocks["width"]
    return out


def _received(rows: list[dict], kind: int) -> np.ndarray:
    load = _loads(rows, kind, WIRE)
    h = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(r["hash"], np.uint64) for r in rows if r["kind"] == kind]])
    return _blocks(h, load["low"], load["width"])


def _within(width: np.ndarray) -> np.ndarray:
    """0..w-1 for each width w, one after the other."""
    return np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)


SENT = "bucket int, shard long, kind int, hash binary, part binary, load binary"
SENT_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
SENT_NAMES = ["bucket", "shard", "kind", "hash", "part", "load"]


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, SENT_TYPES, strict=True)], names=SENT_NAMES)


def _dealt(shard: int, kind: int, h: np.ndarray, part: np.ndarray, load: np.ndarray, buckets: int) -> list[tuple]:
    """Rows that carry hashes with a second key (or a count) and a load, by bucket of the hash."""
    if not len(h):
        return []
    bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    h, part, load = h[order], part[order], load[order]
    return [(k, shard, kind, h[cut[k] : cut[k + 1]].tobytes(), part[cut[k] : cut[k + 1]].tobytes(), load[cut[k] : cut[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(cut)).tolist()]


def _classed(h: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the number of its class of equal (string, surroundings), and the first entry of every class."""
    order = np.lexsort((np.arange(len(h)), span, h))
    hs, ss = h[order], span[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1])
    cls = np.empty(len(h), np.int64)
    cls[order] = np.cumsum(new) - 1
    return cls, order[new]


def _status(h: np.ndarray, span: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Of each entry: 1 where its class repeats, and 2 for one entry of a class whose string has several classes."""
    if not len(h):
        return np.empty(0, np.uint8)
    cls, first = _classed(h, span)
    total = np.bincount(cls, copies)
    block = np.unique(h[first], return_inverse=True)[1]
    several = np.bincount(block)[block] > 1
    out = (total >= 2)[cls] * np.uint8(1)
    out[first] |= several * np.uint8(2)
    return out


class Kind:
    """How the entries of a step are read: their surroundings (0 where a step has none) and number of copies."""

    def __init__(self, name: str):
        self.name = name

    def entries(self, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(r["hash"], np.uint64) for r in rows]])
        part = lambda t: np.concatenate([np.empty(0, t), *[np.frombuffer(r["part"], t) for r in rows]])
        if self.name == "classes":
            load = np.concatenate([np.empty((0, 2), np.uint32), *[np.frombuffer(r["load"], np.uint32).reshape(-1, 2) for r in rows]])
            return h, part(np.uint64), load[:, 1].astype(np.int64)
        return h, np.zeros(len(h), np.uint64), part(np.uint8).astype(np.int64) if self.name == "blocks" else np.ones(len(h), np.int64)

    def counted(self, t: pa.Table) -> pa.Table:
        """One group of shards: its classes with their copies (2 at most)."""
        rows = t.to_pylist()
        h, span, copies = self.entries(rows)
        cls, first = _classed(h, span)
        total = np.minimum(np.bincount(cls, copies), 2).astype(np.uint8)
        return _table([(rows[0]["bucket"], rows[0]["salt"], 0, h[first].tobytes(), span[first].tobytes(), total.tobytes())])

    @staticmethod
    def summed(t: pa.Table) -> pa.Table:
        """All groups of a bucket: the classes that repeat or must be compared, back to their groups."""
        rows = t.to_pylist()
        h = np.concatenate([np.frombuffer(r["hash"], np.uint64) for r in rows])
        span = np.concatenate([np.frombuffer(r["part"], np.uint64) for r in rows])
        status = _status(h, span, np.concatenate([np.frombuffer(r["load"], np.uint8) for r in rows]))
        out, at = [], 0
        for r in rows:
            n = len(r["load"])
            mine = status[at : at + n] > 0
            if mine.any():
                out.append((r["bucket"], r["shard"], 0, h[at : at + n][mine].tobytes(), span[at : at + n][mine].tobytes(), status[at : at + n][mine].tobytes()))
            at += n
        return _table(out)

    def answered(self, t: pa.Table, told: list[dict] | None = None) -> pa.Table:
        """The entries of one group of shards that repeat or must be compared, each back to its shard."""
        rows = t.to_pylist()
        h, span, copies = self.entries(rows)
        if told is None:
            status = _status(h, span, copies)
        else:
            known = [np.concatenate([np.empty(0, d), *[np.frombuffer(r[c], d) for r in told]]) for c, d in (("hash", np.uint64), ("part", np.uint64), ("load", np.uint8))]
            cls, first = _classed(np.concatenate([known[0], h]), np.concatenate([known[1], span]))
            n, of = len(known[0]), np.zeros(len(first), np.uint8)
            of[cls[:n]] = known[2]
            status, mine = of[cls[n:]] & np.uint8(1), _classed(h, span)[1]
            status[mine] |= of[cls[n:]][mine] & np.uint8(2)
        return _table(_returned(rows, h, status > 0, status if self.name == "classes" else None))


def _returned(rows: list[dict], h: np.ndarray, keep: np.ndarray, part: np.ndarray | None = None) -> list[tuple]:
    out, at = [], 0
    for r in rows:
        n = len(r["hash"]) // 8
        mine = keep[at : at + n]
        if mine.any():
            load = np.frombuffer(r["load"], np.uint8).reshape(n, -1)[mine].tobytes()
            out.append((r["bucket"], r["shard"], r["kind"], h[at : at + n][mine].tobytes(), part[at : at + n][mine].tobytes() if part is not None else b"", load))
        at += n
    return out


def _loads(rows: list[dict], kind: int, dtype) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *[np.frombuffer(r["load"], dtype) for r in rows if r["kind"] == kind]])


def _classes(row: dict, told: list[dict]):
    """(anchor, block hash, hash of surroundings, rolling hashes, first and last window start) of complete blocks' anchors."""
    tree, b, ends = Tree(row), np.frombuffer(row["text"], np.uint8), np.frombuffer(row["ends"], np.int64)
    anchor, block = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for kind in sorted({r["kind"] for r in told if r["kind"] > 0}):
        blocks = _received(told, kind)
        at = np.repeat(blocks["low"], blocks["width"]) + _within(blocks["width"])
        anchor.append(tree.rows[at] - kind + 1)
        block.append(np.repeat(blocks["hash"], blocks["width"]))
    anchor, block = np.concatenate(anchor), np.concatenate(block)
    place, back = tree.place.astype(np.int64), np.frombuffer(row["back"], np.uint8).astype(np.int64)
    doc_end = ends[np.searchsorted(ends, place, "right")] if len(place) else place
    first = place - back
    next_first = np.append(first[1:], len(b))
    last = np.minimum(doc_end - LENGTH, np.where(np.append(first[1:], 0) < doc_end, next_first - 1, doc_end - LENGTH))
    held = first[anchor] <= last[anchor]
    anchor, block = anchor[held], block[held]
    rolling = Rolling(b)
    first, last = first[anchor], last[anchor]
    span = _mixed(rolling.hashes(first, last + LENGTH) + back[anchor].astype(np.uint64))
    return anchor, block, span, rolling, first, last


def _step_check(row: dict, told: list[dict], buckets: int) -> list[tuple]:
    """One entry for each (block, surroundings) of the shard, with an anchor and the number of anchors."""
    anchor, block, span, _, _, _ = _classes(row, told)
    order = np.lexsort((anchor, span, block))
    new = np.ones(len(order), bool)
    new[1:] = (block[order][1:] != block[order][:-1]) | (span[order][1:] != span[order][:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(order)))
    load = np.stack([anchor[order][first], np.minimum(count, 2)], 1).astype(np.uint32) if len(order) else np.empty((0, 2), np.uint32)
    return _dealt(row["shard"], -1, block[order][first], span[order][first], load, buckets)


def _step_windows(row: dict, told: list[dict], buckets: int) -> list[tuple]:
    """Hashes of the windows of anchors whose surroundings differ from others of their block."""
    status = [(np.frombuffer(r["part"], np.uint8), np.frombuffer(r["load"], np.uint32).reshape(-1, 2)[:, 0]) for r in told if r["kind"] == -1]
    wanted = np.concatenate([np.empty(0, np.uint32), *[a[s & 2 > 0] for s, a in status]]).astype(np.int64)
    anchor, _, _, rolling, first, last = _classes(row, told)
    own = np.isin(anchor, wanted)
    anchor, first, last = anchor[own], first[own], last[own]
    _, one = np.unique(anchor, return_index=True)
    first, last = first[one], last[one]
    width = last - first + 1
    at = np.repeat(first, width) + _within(width)
    return _dealt(row["shard"], -2, rolling.hashes(at, at + LENGTH), np.zeros(len(at), np.uint8), at.astype(np.uint32), buckets)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, n_chars long"


def _covered(row: dict, told: list[dict]) -> np.ndarray:
    """Of each byte of the shard, whether a repeated string covers it."""
    edge = np.zeros(len(row["text"]) + 1, np.int64)
    if told:
        anchor, block, span, _, first, last = _classes(row, told)
        again = [(np.frombuffer(r["hash"], np.uint64), np.frombuffer(r["part"], np.uint8), np.frombuffer(r["load"], np.uint32).reshape(-1, 2)[:, 0]) for r in told if r["kind"] == -1]
        heads = np.concatenate([np.empty(0, np.uint32), *[a[s & 1 > 0] for _, s, a in again]]).astype(np.int64)
        classes = np.unique(span[np.isin(anchor, heads)] ^ block[np.isin(anchor, heads)])
        settled = np.isin(span ^ block, classes)
        np.add.at(edge, first[settled], 1)
        np.add.at(edge, last[settled] + LENGTH, -1)
        at = _loads(told, -2, np.uint32).astype(np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(row: dict, told: list[dict]) -> Iterator[tuple[int | None, bytes, np.ndarray]]:
    """(doc_id, bytes, mask of covered bytes) of each document of the shard."""
    mask, text, at = _covered(row, told), row["text"], 0
    for doc, end in zip(unpacked_ids(row["ids"]).to_pylist(), np.frombuffer(row["ends"], np.int64).tolist(), strict=True):
        yield doc, text[at:end], mask[at:end]
        at = end


def _step_result(row: dict, told: list[dict]) -> pa.Table:
    out = []
    for doc, b, mask in _cut(row, told):
        removed = int(mask.sum())
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes() if removed else b
        text = kept.decode("utf-8", "ignore")
        out.append((doc, len(b), removed, int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), text, len(text)))
    types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])


def repeated_removed(docs: DataFrame, shards_a_group: int = SHARDS_A_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what is left) and n_chars (its length) of every document."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    name = f"tessera_shards_{uuid.uuid4().hex}"
    try:
        _sharded(docs).write.option("compression", "zstd").bucketBy(int(max(1, -(-size // BYTES_A_TABLE_BUCKET))), "shard").saveAsTable(name)
        return _removed(spark.table(name), int(max(1, -(-size // BYTES_A_BUCKET))), shards_a_group)
    finally:
        spark.sql(f"drop table if exists {name}")


def _removed(shards: DataFrame, buckets: int, shards_a_group: int) -> DataFrame:
    slim = shards.select("shard", "place", "sym", "rows")
    groups = max(1, -(-slim.count() // shards_a_group))

    def sent(tree: Tree, shard: int, blocks: dict[int, np.ndarray]) -> list[tuple]:
        out = []
        for p, b in blocks.items():
            out += _dealt(shard, p, b["hash"], np.minimum(b["width"], 2).astype(np.uint8), _sent(b), buckets)
        return out

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree(row)
                yield from _table(sent(tree, row["shard"], tree.reached({1: tree.start()}, STEP))).to_batches()

    def longer(least: int):
        """Complete blocks, in bucket -1, and the others, of `least` bytes now."""

        def run(a: pa.Table, told: pa.Table) -> pa.Table:
            if not a.num_rows or not told.num_rows:
                return _table([])
            row, rows = a.to_pylist()[0], told.to_pylist()
            tree, out, rest = Tree(row), [], {}
            for p in sorted({r["kind"] for r in rows}):
                b = _received(rows, p)
                done = tree.bytes_long(b, p) >= CORE
                if done.any():
                    out.append((-1, row["shard"], p, b["hash"][done].tobytes(), b"", _sent(b[done]).tobytes()))
                rest[p] = b[~done]
            return _table(out + sent(tree, row["shard"], tree.reached(rest, least)))

        return run

    def meet(left: DataFrame, told: DataFrame, run, schema: str = SENT) -> DataFrame:
        return left.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(run, schema)

    def merged(entries: DataFrame, kind: Kind) -> DataFrame:
        if groups == 1:
            return entries.groupBy("bucket").applyInArrow(lambda t: kind.answered(t), SENT)
        salted = staged(entries.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(groups))))
        known = salted.groupBy("bucket", "salt").applyInArrow(lambda t: kind.counted(t), SENT).groupBy("bucket").applyInArrow(Kind.summed, SENT).withColumnRenamed("shard", "salt")
        keys = ("bucket", "salt")
        return salted.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(lambda t, k: kind.answered(t, k.to_pylist()) if t.num_rows and k.num_rows else _table([]), SENT)

    blocks, classes, windows = Kind("blocks"), Kind("classes"), Kind("windows")
    least, complete, live = STEP, [], merged(slim.mapInArrow(first, SENT), blocks)
    while True:
        least += STEP
        state = staged(meet(slim, live, longer(min(least, CORE))))
        complete.append(state.filter("bucket < 0"))
        rest = state.filter("bucket >= 0")
        if rest.isEmpty():
            break
        live = merged(rest, blocks)
    told = complete[0]
    for x in complete[1:]:
        told = told.union(x)

    def with_text(step):
        def run(a: pa.Table, t: pa.Table) -> pa.Table:
            return _table(step(a.to_pylist()[0], t.to_pylist(), buckets)) if a.num_rows and t.num_rows else _table([])

        return run

    told = told.union(staged(merged(meet(shards, told, with_text(_step_check)), classes)))
    told = told.union(staged(merged(meet(shards, told, with_text(_step_windows)), windows)))
    return staged(meet(shards, told, lambda a, t: _step_result(a.to_pylist()[0], t.to_pylist()), RESULT))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_removed(table(spark, sf_dir, "documents"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
