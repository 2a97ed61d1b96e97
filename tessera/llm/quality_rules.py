"""Quality rules by distribution divergence.

Every document gets two histograms: its character classes and its common words. Both are compared with the histograms
of its language over the whole corpus by Jensen-Shannon distance (base 2, from 0 to 1). Guards: a histogram over too
few characters or words is not judged, and the fewer words a text has, the farther its own may lie. Fixed rules on length and repetition come first.

Defined cases: null text counts as empty (no words, fails the length rule); a language that is null or has fewer than
`MIN_REFERENCE_CHARS` characters is compared with the reference over all languages; ties and repeated rows are judged
row by row; an empty table gives an empty result; columns of the input other than those named are carried on by
`keep_good` and ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_text, staged, table

# The commonest function words of each language.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be by are this at from",
    "fr": "de la le et les en des un du une que est pour par dans avec qui pas sur au",
    "de": "der die und in den von zu das sich mit des auf für ist im nicht dem ein eine als",
    "es": "de la que el en y los las se del un por con no una su para es al lo",
}
WORDS = sorted({w for s in COMMON_WORDS.values() for w in s.split()})
WORD_AT = {w.encode(): i for i, w in enumerate(WORDS)}
N_WORDS = len(WORDS) + 1  # and one for every other word
# The character classes, by their first bytes.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "wide")
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED, MIN_REFERENCE_CHARS = 200, 40, 20_000
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.24
#: A sample of n words lies from its own source at a squared distance in proportion to 1 / n; short texts get that much more.
WORD_SAMPLING = 4.0
MAX_LANGUAGES = 1000


def _class_matrix() -> np.ndarray:
    m = np.zeros((256, len(CLASSES)), np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            m[b, 6] = 1
        elif b >= 0x80:
            continue
        elif "a" <= c <= "z":
            m[b, 0] = 1
        elif "A" <= c <= "Z":
            m[b, 1] = 1
        elif c.isdigit():
            m[b, 2] = 1
        elif c in " \t\n\r\x0b\x0c":
            m[b, 3] = 1
        elif c in ".,;:'\"!?-()":
            m[b, 4] = 1
        else:
            m[b, 5] = 1
    return m


def repeat_words(words: list[bytes], window: int = 8) -> int:
    """Words covered by runs of `window` words that occur twice or more (exact: runs are numbered by doubling)."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    width = 1
    while width < window:  # 1 -> 2 -> 4 -> 8: a run's number is that of its two halves
        code = np.unique(code[:-width] * (n + 1) + code[width:], return_inverse=True)[1]
        width *= 2
    again = np.bincount(code)[code] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    edge[:-window] += again
    edge[window:] -= again
    return int((np.cumsum(edge)[:n] > 0).sum())


FIELDS = [
    ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"),
    ("n_repeat_words", "bigint"), ("chars", "array<bigint>"), ("commons", "array<bigint>"),
]


def _measure(texts: list[bytes]) -> list[list]:
    matrix, out = _class_matrix(), []
    symbols, blank = list(SYMBOLS), list(b" \t\n\r\x0b\x0c")
    for b in texts:
        words = b.split()
        by_byte = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        points = len(b) - int(by_byte[0x80:0xC0].sum())
        seen, again = set(), 0
        for line in b.split(b"\n"):
            if line.strip():
                again += line in seen
                seen.add(line)
        commons = [0] * N_WORDS
        for w in b.lower().split():
            commons[WORD_AT.get(w, N_WORDS - 1)] += 1
        out.append((len(words), points - int(by_byte[blank].sum()), int(by_byte[symbols].sum()), again, repeat_words(words), (by_byte @ matrix).tolist(), commons))
    return [list(x) for x in zip(*out, strict=True)]


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The `keep` columns with the counts of FIELDS for every row's whole text."""
    return map_text(docs, text_col, FIELDS, _measure, keep)


def references(stats: DataFrame, lang_col: str = "lang") -> DataFrame:
    """(ref_lang, ref_chars, ref_commons): summed histograms of each language, and of all under null."""

    def sums(name: str, n: int) -> Column:
        return F.array(*[F.sum(F.col(name)[i]) for i in range(n)])

    each = stats.groupBy(F.col(lang_col).alias("ref_lang")).agg(sums("chars", len(CLASSES)).alias("ref_chars"), sums("commons", N_WORDS).alias("ref_commons"))
    whole = each.groupBy().agg(sums("ref_chars", len(CLASSES)).alias("ref_chars"), sums("ref_commons", N_WORDS).alias("ref_commons"))
    large = each.filter(F.col("ref_lang").isNotNull() & (F.aggregate("ref_chars", F.lit(0).cast("bigint"), lambda a, x: a + x) >= MIN_REFERENCE_CHARS))
    return large.union(whole.filter("ref_chars[0] is not null").select(F.lit(None).cast("string"), "ref_chars", "ref_commons"))


def _js(p: str, q: str) -> Column:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    tp, tq = total(F.col(p)), total(F.col(q))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = F.zip_with(p, q, lambda a, b: F.struct((a / tp).alias("a"), (b / tq).alias("b")))
    each = F.transform(both, lambda s: part(s["a"], (s["a"] + s["b"]) / 2) + part(s["b"], (s["a"] + s["b"]) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), total(each) / 2))


def judged(stats: DataFrame, refs: DataFrame, lang_col: str = "lang") -> DataFrame:
    """stats with char_distance, word_distance (null where a guard holds), base_failed and kept."""
    known = refs.filter("ref_lang is not null")
    pooled = refs.filter("ref_lang is null").select(F.col("ref_chars").alias("all_chars"), F.col("ref_commons").alias("all_commons"))
    if refs.limit(MAX_LANGUAGES + 1).count() <= MAX_LANGUAGES:  # each some 700 bytes: under 1 MB
        known = F.broadcast(known)
    out = stats.join(known, F.col(lang_col) == F.col("ref_lang"), "left").join(F.broadcast(pooled), how="left")  # pooled: one row
    out = out.withColumns({"ref_chars": F.coalesce("ref_chars", "all_chars"), "ref_commons": F.coalesce("ref_commons", "all_commons")})
    n_chars = F.aggregate("chars", F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = out.withColumns({
        "char_distance": F.when(n_chars >= MIN_CHARS_JUDGED, _js("chars", "ref_chars")),
        "word_distance": F.when(F.col("n_words") >= MIN_WORDS_JUDGED, _js("commons", "ref_commons")),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | F.coalesce(F.col("word_distance") * F.col("word_distance") > MAX_WORD_DISTANCE**2 + WORD_SAMPLING / F.col("n_words"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, both distances, base_failed and kept of every document."""
    stats = staged(measured(docs, ["doc_id", "lang"]))
    return judged(stats, references(stats)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs unchanged.

    The text stays where it is: one pass sums the references, a second judges row by row, and no text is shuffled.
    """
    inner = docs.select(F.struct("*").alias("__row"), F.col("lang").alias("__lang"))
    refs = staged(references(measured(docs, ["lang"])))
    stats = map_text(inner, "text", FIELDS, _measure, ["__row", "__lang"])
    return judged(stats, refs, "__lang").filter("kept").select("__row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


QUERIES = {"op10_quality_rules": op10_quality_rules}


def _sql() -> str:
    """The same counts, references and distances as one DuckDB statement."""
    word, lower = r"[^\x20\x09-\x0D]+", "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    n_of = lambda chars: f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"
    classes = [n_of("a-z"), n_of("A-Z"), n_of("0-9"), n_of(r"\x20\x09-\x0D"), n_of(r""".,;:''"!?()-"""), n_of(r"""\x00-\x08\x0E-\x1F\x7F#$%&*+/<=>@\[\\\]\^_`{|}~"""), n_of(r"^\x00-\x7F").replace("[^^", "[")]
    listed = ", ".join(f"('{w}')" for w in WORDS)

    def distance(kind: str) -> str:
        part = "case when {x} > 0 then {x} * log2({x} / ((p + q) / 2)) else 0 end"
        return f"""{kind}_distance as materialized (select doc_id, sqrt(greatest(0, sum({part.format(x="p")} + {part.format(x="q")}) / 2)) as d from
            (select o.doc_id, coalesce(h.c, 0) / o.n as p, r.c / r.total as q from {kind}_own o join {kind}_ref r on r.ref is not distinct from o.ref left join {kind}_hist h on h.doc_id = o.doc_id and h.k = r.k) group by doc_id)"""

    def parts(kind: str) -> str:
        return f"""{kind}_by as (select lang, k, sum(c) as c from {kind}_hist join docs using (doc_id) group by lang, k),
        {kind}_ref as materialized (select ref, k, c, sum(c) over (partition by ref) as total from (select lang as ref, k, c from {kind}_by where lang in (select lang from large) union all select null, k, sum(c) from {kind}_by group by k) where c > 0),
        {kind}_own as (select doc_id, case when lang in (select lang from large) then lang end as ref, sum(c) as n from {kind}_hist join docs using (doc_id) group by all having sum(c) > 0), {distance(kind)}"""

    return f"""with docs as materialized (select doc_id, lang, coalesce(text, '') as t from documents),
    words as materialized (select doc_id, regexp_extract_all(t, '{word}') as w, regexp_extract_all({lower}, '{word}') as l from docs),
    char_hist as materialized (select doc_id, unnest(range(7)) as k, unnest([{", ".join(classes)}]) as c from docs),
    common as (select * from (values {listed}) v(word)),
    word_hist as materialized (select doc_id, coalesce(word, '') as k, count(*) as c from (select doc_id, unnest(l) as x from words) left join common on x = word group by all),
    large as (select lang from char_hist join docs using (doc_id) where lang is not null group by lang having sum(c) >= {MIN_REFERENCE_CHARS}),
    {parts("char")}, {parts("word")},
    runs as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from words where len(w) >= 8)),
    again as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from runs) where n > 1),
    covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from again) group by doc_id),
    lines as (select doc_id, count(*) - count(distinct x) as n from (select doc_id, unnest(string_split(t, chr(10))) as x from docs) where regexp_matches(x, '{word}') group by doc_id),
    counts as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, {n_of("#*$%&|<>")}::bigint as n_symbols, coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
        (select sum(c) from char_hist h where h.doc_id = docs.doc_id) as n_chars from docs join words using (doc_id) left join lines using (doc_id) left join covered using (doc_id)),
    judged as (select c.*, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed, case when n_chars >= {MIN_CHARS_JUDGED} then cd.d end as cd, case when n_words >= {MIN_WORDS_JUDGED} then wd.d end as wd
        from counts c left join char_distance cd using (doc_id) left join word_distance wd using (doc_id))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(cd, 0) <= {MAX_CHAR_DISTANCE} and coalesce(wd * wd <= {MAX_WORD_DISTANCE**2!r}::double + {WORD_SAMPLING}::double / n_words, true) as kept, round(cd, 6) as char_distance, round(wd, 6) as word_distance from judged"""


ORACLES = {"op10_quality_rules": _sql()}
