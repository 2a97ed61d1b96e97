"""Filter audit, spelling variants and fingerprints against plain versions, and their edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from test_llm import EDGE, frame, rows, words

from tessera.llm import filter_audit, fingerprints, spelling

CLASH = "part mask length blocks class h n again good toxic word form root shard trie size range guest least before id at s own".split()


def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in CLASH if c not in docs.columns})


# ---- filter audit ----


def plain_audit(docs, labels):
    """docs: (id, text, source); labels: (id, quality, toxic)."""
    seen = collections.defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            seen[t or ""].append(i)
    counts = collections.defaultdict(list)
    for i, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > min(seen[t])}
        good = any(q == 1 for j, q, _ in labels if j == i and j is not None)
        toxic = any(x == 1 for j, _, x in labels if j == i and j is not None)
        counts[source or ""].append((fails, good, toxic))
    out = []
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for part, those in counts.items():
        shapley = collections.Counter()
        made = []
        for order in orders:
            left = those
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                shapley[f] += len(gone)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in those)
                made.append((f, part, order, step, len(left), len(gone), sum(d[0][f] for d in those) - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*m[1:], shapley[m[0]]) for m in made]
    return sorted(out, key=str)


AUDIT = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def audit_case():
    rng = random.Random(2)
    long = words(rng, 9_000)
    texts = [*EDGE, words(rng, 300), "AB " * 220, words(rng, 250) + " 5%", long, long[:-1] + "!", long]
    docs = [(i, t, rng.choice(["a", "b", None, ""])) for i, t in enumerate(texts * 3)]
    docs += [(None, long, "a"), (None, None, "c"), (3, docs[3][1], "b"), (5, long, "b"), (-4, words(rng, 300), None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(len(texts) * 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (10**9, 1, 1)]
    return docs, labels


def test_audit_against_plain(spark):
    docs, labels = audit_case()
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit(docs, labels)
    assert rows(filter_audit.filter_audit(d, known).select(*AUDIT)) == want
    assert rows(filter_audit.filter_audit(clashing(d), clashing(known)).select(*AUDIT)) == want
    assert filter_audit.filter_audit(d.limit(0), known.limit(0)).collect() == []


def test_refinement_drops_singles_and_compares_texts(spark):
    """All texts of one length; with hashes that say nothing, only the texts tell them apart."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(400)) for _ in range(40)]
    docs = [(i, texts[i % 40] if i % 3 else texts[0], "s") for i in range(100)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    first = {}
    want = {i for i, t, _ in docs if first.setdefault(t, i) != i}
    for same in (False, True):
        m = filter_audit.measured(d)
        if same:
            m = m.withColumn("blocks", F.array(F.lit(1), F.lit(2)).cast("array<bigint>"))
        left = {r["doc_id"] for r in filter_audit.refined(m).collect()}
        n = collections.Counter(t for _, t, _ in docs)
        assert left == (set(range(100)) if same else {i for i, t, _ in docs if n[t] > 1})
        assert {r["doc_id"] for r in filter_audit.duplicates(d, m).collect()} == want


# ---- spelling ----


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    n = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: x for w, x in best.items() if n[x] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def spelling_case(rng):
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 10))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "×÷" * 5, "ab" * 2_000, "ab" * 1_999 + "a"]
    docs = []
    for i in range(120):
        run = []
        for _ in range(60):
            w = rng.choice(stems[: rng.choice([3, 10, len(stems)])])
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcé") + w[at:], w[:at] + "z" + w[at + 1 :]])
            run.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        docs.append((i if i % 17 else None, rng.choice([" ", "-", "7", "Ā"]).join(run)))
    docs += [(601, "xxlongwords " * 2), (602, "xlongwords " * 25), (603, "longwords " * 300)]
    return [*docs, (500, None), (501, ""), docs[5], docs[5]]


@pytest.mark.parametrize("most_words, most_bytes", [(250_000, 64_000_000), (25, 1_000)])
def test_variants_against_plain(spark, most_words, most_bytes):
    docs = spelling_case(random.Random(6))
    want = plain_variants(docs)
    assert sum(w[1] is not None for w in want) > 20 and any(w[2] not in (w[0], w[1]) for w in want if w[1])
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = spelling.variants(d, most_words, most_bytes)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and rows(got) == want
    if most_words == 25:
        assert rows(spelling.variants(clashing(d), most_words)) == want
        assert spelling.variants(d.limit(0)).collect() == []


def test_trie_against_all_pairs():
    rng = random.Random(8)
    made = sorted({bytes(rng.choice(b"abc\xe9") for _ in range(rng.randint(1, 7))) for _ in range(900)} | {b"a" * k for k in range(1, 40)})
    trie = spelling.Trie.load(spelling.Trie.build(made, list(range(1, len(made) + 1))).dump())
    shard = spelling.Shard.load(spelling.Shard.build([(w, k) for k, w in enumerate(made, 1)]).dump())
    for w in [*made, b"", b"zzz", b"a" * 60, b"abcabcab"]:
        want = {x: k + 1 for k, x in enumerate(made) if one_apart(w, x)}
        assert trie.near(w) == shard.near(w) == want
    assert spelling.Trie.build([], []).near(b"abc") == {}
    assert all(spelling.one_edit(a, b) == one_apart(a, b) for a in made[:120] for b in made[:120])


def test_chain_of_long_words_takes_no_square_time():
    import time

    a = [b"a" * 300_000, b"a" * 300_001, b"a" * 299_999 + b"b", b"b" + b"a" * 299_999]
    shard = spelling.Shard.build(list(zip(a, [1, 2, 3, 4], strict=True)))
    began = time.time()
    assert len(shard.near(a[0])) == 3
    assert time.time() - began < 10


def test_shards_are_bounded():
    plan = spelling.shard_plan([(7, 10), (8, 95), (9, 20), (10, 20), (11, 900), (5_000_000, 2)], 100, 4_000_000)
    assert plan == [(7, 0, 1), (8, 1, 1), (9, 2, 1), (10, 2, 1), (11, 3, 9), (5_000_000, 12, 3)]
    assert [[s[0] for s in w] for w in spelling.waves([(0, 7, 7, 60), (1, 8, 8, 60), (2, 9, 9, 40), (3, 9, 9, 500)], 100)] == [[0], [1, 2], [3]]


# ---- fingerprints ----


def plain_sample(counts, k):
    """The sampled (term, level) by the definition, from the same variates."""
    best = None
    for word, n in counts.items():
        r, log_c, b = (float(x[0, k]) for x in fingerprints.variates(np.array([fingerprints.term_key(word)], np.uint64), k + 1)[:3])
        t = math.floor(math.log(n) / r + b)
        y = math.exp(r * (t - b))
        a = math.exp(log_c) / (y * math.exp(r))
        if best is None or a < best[0]:
            best = (a, word, t)
    return best[1:]


def test_samples_by_definition():
    rng = random.Random(3)
    texts = [words(rng, n).encode() for n in (1, 5, 40, 120)]
    texts.append(texts[2] + b" " + texts[3])
    s = fingerprints.Sampler(16)
    marks = [s.fingerprint(t) for t in texts]
    want = [[plain_sample(collections.Counter(t.split()), k) for k in range(16)] for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert fingerprints.likeness(marks[i], marks[j]) == sum(a == b for a, b in zip(want[i], want[j], strict=True)) / 16
    small = fingerprints.Sampler(16, cached=7)  # a small store of values changes nothing
    assert [small.fingerprint(t) for t in texts] == marks


def test_variates_have_their_distributions():
    """Mean, variance and quantiles of gamma variates of shape 2 and of uniforms."""
    keys = np.array([fingerprints.term_key(str(i).encode()) for i in range(3000)], np.uint64)
    r, c, b, mark = fingerprints.variates(keys, 64)
    c = np.exp(c)
    low = np.sort(c.ravel())[: len(c.ravel()) // 2_000]  # the part that is placed exactly
    assert len(np.unique(low)) == len(low) and abs(np.median(low) / fingerprints.gamma_2_at(np.array([0.00025]))[0] - 1) < 0.1
    for g in (r, c):
        assert abs(g.mean() - 2) < 0.02 and abs(g.var() - 2) < 0.06 and abs((g < 0.5).mean() - (1 - 1.5 * math.exp(-0.5))) < 0.005
    assert abs(b.mean() - 0.5) < 0.005 and b.min() >= 0 and b.max() < 1 and abs(mark.mean() - 32767.5) < 150
    each = np.stack([r.ravel(), c.ravel(), b.ravel(), mark.ravel()])
    assert np.abs(np.corrcoef(each) - np.eye(4)).max() < 0.01
    assert np.abs(np.corrcoef(c[:, :20].T) - np.eye(20)).max() < 0.08 and np.abs(np.corrcoef(c[:20]) - np.eye(20)).max() < 0.6


def test_likeness_is_generalised_jaccard():
    rng = random.Random(5)
    s, errors = fingerprints.Sampler(1024, 3_000), []
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        a = words(rng, 200).split()
        b = a[: int(200 * share)] + words(rng, 200 - int(200 * share)).split()
        x, y = collections.Counter(a), collections.Counter(b)
        exact = sum((x & y).values()) / sum((x | y).values())
        errors.append(abs(fingerprints.likeness(s.fingerprint(" ".join(a).encode()), s.fingerprint(" ".join(b).encode())) - exact))
    assert max(errors) < 0.07


FINGER = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()


def plain_fingerprints(docs):
    s, out = fingerprints.Sampler(), []
    order = sorted(((i, t or "") for i, t in docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        marks = [s.fingerprint(x.encode()) for x in (t, e, nxt)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), *marks[:2], fingerprints.likeness(marks[0], marks[1]), fingerprints.likeness(marks[0], marks[2])))
    return sorted(out, key=str)


@pytest.mark.parametrize("range_bytes", [8_000_000, 900])
def test_fingerprints_against_plain(spark, monkeypatch, range_bytes):
    rng = random.Random(7)
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", range_bytes)
    texts = [*EDGE, "\U0001f600é b" * 9, words(rng, 6_000), *[words(rng, rng.randint(1, 90)) for _ in range(60)]]
    docs = [(rng.randrange(-50, 2**60), t) for t in texts] + [(7, "b a"), (7, "a b c"), (7, "a b c"), (None, "q r"), (None, None), (2**62, "last one")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = plain_fingerprints(docs)
    got = fingerprints.fingerprinted(clashing(d))
    assert got.columns == FINGER and rows(got) == want
    by_text = collections.defaultdict(set)
    text_of = dict(docs)
    for r in got.filter("doc_id > 7").collect():
        by_text[text_of[r["doc_id"]] or ""].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.fingerprinted(d.limit(0)).collect() == []
    assert rows(fingerprints.fingerprinted(d.filter("doc_id = 1"))) == []
    one = [(1, "only this text")]
    assert rows(fingerprints.fingerprinted(spark.createDataFrame(one, "doc_id long, text string"))) == plain_fingerprints(one)
