"""Very long texts of one kind: results as for short ones, in time that grows with the length."""

import base64
import json
import random
import re
import time

from test_llm import frame

from tessera.llm import packing, secrets


def spent(f, *args):
    began = time.time()
    out = f(*args)
    return out, time.time() - began


def test_runs_without_a_dot_are_scanned_once():
    words = secrets.automaton()
    header = base64.urlsafe_b64encode(json.dumps({"alg": "none", "x": "eyJ eyJ"}).encode()).rstrip(b"=")
    token = header + b".eyJhIjoxfQ.c2ln"
    for text in (b"eyJ" * 350_000, b"eyJ" * 300_000 + b".eyJ" + b"eyJ" * 50_000, b"EYJeyJ." * 150_000, (b"eyJ" * 50 + b" ") * 7_000, b"token " * 170_000, b"-----BEGIN A " * 80_000, b"0" * 1_000_000):
        found, took = spent(secrets.scan, text, words)
        assert took < 5 and all(k != "web_token" for k, _, _ in found)
        whole = text + b" " + token
        kinds = {k: whole[a:z] for k, a, z in secrets.scan(whole, words)}
        assert kinds["web_token"] == token


def test_skipping_changes_no_match():
    """Against the expression tried at every hit."""
    rng, words = random.Random(2), secrets.automaton()
    header = base64.urlsafe_b64encode(b'{"alg":1}').rstrip(b"=").decode()
    parts = ["eyJ", "EYJ", "a_", ".", " ", header, header + ".eyJx.y", "eyJx", ".eyJ"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14))).encode()
        want, done = [], 0
        for m in re.finditer(rb"(?=(eyJ))", text):
            if m.start() >= done and (x := secrets.PATTERNS["web_token"].match(text, m.start())):
                done = x.end()
                if secrets.header_holds(x.group(1)):
                    want.append((m.start(), done))
        assert [(s, e) for k, s, e in secrets.scan(text, words) if k == "web_token"] == want


def test_long_blank_runs_are_encoded(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain, fast = Tokenizer.from_file(path), packing.Encoder(path)
    for text in (" " * 1_000_000, "a" + "\n" * 300_000 + "b", ("x" + " " * 5_000) * 100, " " * 4_095 + "x"):
        assert fast.encode(text) == packing.array("I", plain.encode(text, add_special_tokens=False).ids).tobytes()
    out = packing.packed(frame(spark, [" " * 1_000_000, "a b", None]), path).toPandas()
    assert set(out.doc_id) == {0, 1, 2} and out.length.max() <= packing.CAPACITY
