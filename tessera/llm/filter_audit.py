"""Filter interaction audit: what each filter removes, alone and behind the others, in every order of the filters.

Four filters look at one text each and give a bit of a mask in one pass. The fifth, exact duplicates, refines a partition:
documents are split by their length in code points, then by the hash of one block of the text after another (each four
times as long as the one before), and after every split classes of one document are dropped. Texts are compared whole
only for what is left, by grouping class and text; all but the smallest id of a text get the fifth bit. Then documents
are counted by part, mask and labels (32 masks at most), and all orders are worked out from these counts.

Rows of one class never meet in one task: classes are counted with partial sums, and a class of one is removed by its
document, which is a key without weight.

Defined cases: a null text is an empty one, and equal to it; a null source is the part of the empty string; a document is
a duplicate only of a smaller id, so rows that repeat an id with its text are not; a row of null id is a duplicate of none
and makes none; of several labels of an id one that says 1 counts; texts of any length are hashed and compared whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_text, staged, table

LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 2
UPPER, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Bytes of the first block of a text and how much longer each next one is.
FIRST_BLOCK, GROWTH = 64, 4


def block_hashes(text: bytes) -> list[int]:
    out, at, size = [], 0, FIRST_BLOCK
    while at < len(text):
        out.append(int.from_bytes(blake2b(text[at : at + size], digest_size=8).digest(), "little", signed=True))
        at, size = at + size, size * GROWTH
    return out


def _measure(texts: list[bytes]) -> list[list]:
    masks, lengths, blocks = [], [], []
    for b in texts:
        words, n = b.split(), len(b.decode())
        upper = len(b) - len(b.translate(None, UPPER))
        fails = (
            len(words) < MIN_WORDS,
            100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
            100 * upper > MAX_UPPER_PERCENT * n,
            len(b.translate(None, SYMBOLS)) < len(b),
        )
        masks.append(sum(f << i for i, f in enumerate(fails)))
        lengths.append(n)
        blocks.append(block_hashes(b))
    return [masks, lengths, blocks]


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, h, part, text: h tells rows of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, h, part, mask of the four filters, length in code points and block hashes, from one reading of the texts."""
    return map_text(_hashed(docs), "text", [("mask", "int"), ("length", "bigint"), ("blocks", "array<bigint>")], _measure, ["doc_id", "h", "part"])


def refined(rows: DataFrame) -> DataFrame:
    """doc_id, h, class: the documents (doc_id, h, length, blocks) whose class has at least two when all blocks are used up.

    Each round splits the classes by one more block and drops those of one document. The number of rounds is that of the
    blocks of the longest text that is left: it grows with the logarithm of its length.
    """
    left = rows.select("doc_id", "h", F.col("length").alias("class"), "blocks")
    at = 0
    while True:
        single = left.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h")).alias("s")).filter("n = 1").select("s.doc_id", "s.h", "class")
        deeper = F.when(F.size("blocks") > at, F.xxhash64("class", F.col("blocks")[at])).otherwise(F.col("class"))
        more = F.max(F.size("blocks")).alias("most")
        left = staged(left.join(single, ["doc_id", "h", "class"], "left_anti").withColumn("class", deeper))
        most = left.agg(more).first()["most"]  # null where nothing is left
        if most is None or at >= most:
            return left.select("doc_id", "h", "class")
        at += 1


def duplicates(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, h of the rows whose text stands under a smaller id too."""
    left = refined(rows.filter("doc_id is not null").select("doc_id", "h", "length", "blocks"))
    texts = _hashed(docs).select("doc_id", "h", "text").join(left.distinct().hint("merge"), ["doc_id", "h"])
    kept = texts.groupBy("class", "text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "class")
    return left.join(kept, ["doc_id", "class"], "left_anti").select("doc_id", "h").distinct()


def counted(rows: DataFrame, again: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail exactly the filters of the mask."""
    is_1 = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").filter("doc_id is not null").groupBy("doc_id").agg(is_1("quality").alias("good"), is_1("toxic").alias("toxic"))
    marked = rows.select("doc_id", "h", "part", "mask").join(again.withColumn("again", F.lit(1 << LETTERS.index("E"))), ["doc_id", "h"], "left").join(known, "doc_id", "left")
    whole = (F.col("mask") + F.coalesce("again", F.lit(0))).alias("mask")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return marked.select("part", whole, "good", "toxic").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def _summed(counts: str, wanted) -> Column:
    """Sum of the array's counts over the masks for which wanted(mask) holds."""
    add = lambda acc, m: acc + F.when(wanted(m), F.col(counts)[m]).otherwise(F.lit(0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("bigint"), add)


def all_orders(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the counts by mask."""
    each = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(MASKS)])
    parts = counts.groupBy("part").agg(each("n").alias("n"), each("good").alias("good"), each("toxic").alias("toxic"))
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)]))
    rows = parts.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    bit = lambda text: sum(F.when(F.instr(text, c) > 0, 1 << i).otherwise(0) for i, c in enumerate(LETTERS))
    rows = rows.withColumn("own", bit(F.col("filter_order").substr(F.col("step"), F.lit(1)))).withColumn("before", bit(F.col("filter_order").substr(F.lit(1), F.col("step") - 1)))
    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~gone(m)
    # A document of k failures goes by each of them in a k-th part of the 120 orders.
    share = F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("bigint"), lambda acc, m: acc + F.when(fails(m), F.col("n")[m] * (F.lit(120) / F.bit_count(m)).cast("bigint")).otherwise(F.lit(0)))
    return rows.select(
        "part", "filter_order", "step",
        _summed("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        _summed("n", here).alias("removed"),
        _summed("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        F.col("n")[F.col("own")].alias("unique_fails"),
        _summed("good", here).alias("good_lost"),
        _summed("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows = staged(measured(docs))
    return all_orders(staged(counted(rows, duplicates(docs, rows), labels)))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op11_filter_audit": op11_filter_audit}

SQL = r"""with docs as materialized (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
    words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as first from docs),
    known as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
    fails as materialized (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
        [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] as f
        from words left join known using (doc_id)),
    counts as materialized (select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from fails group by all),
    l as (select unnest(range(1, 6)) as i),
    orders as materialized (select [a.i, b.i, c.i, d.i, e.i] as o from l a, l b, l c, l d, l e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
    steps as materialized (select array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') as filter_order, s as step, o[s] as own, o[1:s - 1] as before from orders, (select unnest(range(1, 6)) as s)),
    seen as (select part, filter_order, step, own, n, good, toxic, f[own] as fails, len(list_filter(before, lambda x: f[x])) > 0 as gone, len(list_filter(f, lambda x: x)) as k from counts, steps),
    sums as (select part, filter_order, step, any_value(own) as own,
        sum(case when not fails and not gone then n else 0 end)::bigint as kept, sum(case when fails and not gone then n else 0 end)::bigint as removed,
        sum(case when fails and gone then n else 0 end)::bigint as redundant, sum(case when fails and k = 1 then n else 0 end)::bigint as unique_fails,
        sum(case when fails and not gone then good else 0 end)::bigint as good_lost, sum(case when fails and not gone then toxic else 0 end)::bigint as toxic_lost
        from seen group by part, filter_order, step)
    select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, own)::bigint as shapley from sums"""

ORACLES = {"op11_filter_audit": SQL}
