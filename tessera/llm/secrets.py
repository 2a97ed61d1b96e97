"""Secret scans: keyword automaton first, anchored regular expressions only near its hits, then checksums.

An Aho-Corasick automaton over the lower-cased bytes finds the keywords of all kinds in one pass; for runs of one
character class (hex) the keyword is a run of the class's mark in the class-mapped text. At each hit the kind's regular
expression is tried anchored at that place alone. Kinds with a checksum inside the value are kept only if it holds.

Kinds, in the order of `KINDS`: assign, access, hex (the base), then github and npm tokens (CRC-32 in base 62), private
key blocks, web tokens (a header that decodes to JSON) and card numbers (Luhn). Spans are in code points, end exclusive.

Defined cases: null text counts as empty and has no spans; matches of one kind never overlap, the leftmost is taken and
one that fails its length or checksum is dropped with what it covered; texts of any length are scanned whole, in time that
grows with their length (a run that cannot be a web token is read once, not from every start in it); repeated rows give repeated results; an empty
table gives an empty result; `redacted` leaves all other columns as they are.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_text, table

KINDS = ("assign", "access", "hex", "github", "npm", "private_key", "web_token", "card")
BASE_KINDS = KINDS[:3]
# Keywords by kind (lower-cased bytes), and the expressions tried at them.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "private_key": ("-----begin ",),
    "web_token": ("eyj",),
}
PATTERNS = {
    "assign": re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]+"),
    "github": re.compile(rb"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "npm": re.compile(rb"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "private_key": re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
    "web_token": re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    "card": re.compile(rb"[0-9]{13,19}(?![0-9])"),
}
TOKEN_PART = re.compile(rb"eyJ[A-Za-z0-9_-]*")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_HEX, MIN_CARD = 24, 13
HEX_CLASS = bytes(ord("x") if chr(i) in "0123456789abcdef" else ord(".") for i in range(256))
DIGIT_CLASS = bytes(ord("x") if 48 <= i <= 57 else ord(".") for i in range(256))


def crc_holds(value: bytes) -> bool:
    """The last six characters are the CRC-32 of the thirty before, in base 62."""
    body, n, out = value[-36:-6], zlib.crc32(value[-36:-6]), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return len(body) == 30 and out.encode() == value[-6:]


def luhn_holds(value: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(value)):
        d = c - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0 and len(set(value)) > 1


def header_holds(part: bytes) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


def _accepts(kind: str, m: re.Match) -> bool:
    value = m.group()
    if kind == "assign":
        return len(m.group(2)) >= 6
    if kind == "access":
        return len(value) >= 20
    if kind == "hex":
        return len(value) >= MIN_HEX
    if kind in ("github", "npm"):
        return crc_holds(value)
    if kind == "web_token":
        return header_holds(m.group(1))
    return luhn_holds(value) if kind == "card" else True


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _runs(mapped: bytes, least: int) -> list[int]:
    """Starts of the runs of at least `least` marks."""
    mark, out, at = b"x" * least, [], 0
    while (i := mapped.find(mark, at)) >= 0:
        out.append(i)
        at = mapped.find(b".", i)
        if at < 0:
            break
    return out


def scan(b: bytes, words) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start, then kind as listed."""
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in words.iter(b.lower().decode("latin-1")):
        starts.setdefault(kind, []).append(end - n + 1)
    for kind, mapping, least in (("hex", HEX_CLASS, MIN_HEX), ("card", DIGIT_CLASS, MIN_CARD)):
        if found := _runs(b.translate(mapping), least):
            starts[kind] = found
    spans = []
    for rank, kind in enumerate(KINDS):
        done = 0
        for s in sorted(starts.get(kind, ())):
            if s < done:
                continue
            if m := PATTERNS[kind].match(b, s):
                done = m.end()
                if _accepts(kind, m):
                    spans.append((s, rank, done))
            elif kind == "web_token" and (m := TOKEN_PART.match(b, s)):
                done = m.end()  # what follows this run is no token's second part: no other start in it can succeed either
    return [(KINDS[k], s, e) for s, k, e in sorted(spans)]


def _in_points(b: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if not spans or b.isascii():
        return spans
    at, points, where = 0, 0, {}
    for x in sorted({p for _, s, e in spans for p in (s, e)}):
        points += len(b[at:x].decode("utf-8", "replace"))
        at = where[x] = x
        where[x] = points
    return [(k, where[s], where[e]) for k, s, e in spans]


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _report(texts: list[bytes]) -> list[list]:
    words, out = automaton(), []
    for b in texts:
        spans = _in_points(b, scan(b, words))
        base = [x for x in spans if x[0] in BASE_KINDS]
        counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
        out.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
    return [list(x) for x in zip(*out, strict=True)]


def _cleaned(texts: list[bytes]) -> list[list]:
    words, out = automaton(), []
    for b in texts:
        at, parts = 0, []
        for kind, s, e in scan(b, words):
            if e > at:
                parts += [b[at : max(s, at)], b"[%s]" % kind.encode() if s >= at else b""]
                at = e
        out.append(b"".join([*parts, b[at:]]).decode() if parts else None)
    return [out]


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    fields = [("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    return map_text(docs, "text", fields, _report, ["doc_id"])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of a secret in `text` replaced by its kind in brackets; all else unchanged."""
    out = map_text(docs.select(F.struct("*").alias("__row")), "text", [("__clean", "string")], _cleaned, ["__row"])
    return out.select(*[(F.coalesce("__clean", F.col("__row.text")) if c == "text" else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


QUERIES = {"op4_secret_scan": op4_secret_scan}

