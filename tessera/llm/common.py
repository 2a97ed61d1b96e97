"""Shared pieces of the training-data operators: table reading, staging, batching, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only where none is set and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def packed_ids(ids: Sequence[int | None]) -> bytes:
    """Ids as 64-bit numbers, and after them a byte each: 1 where there is an id, 0 where it is null."""
    return np.array([x or 0 for x in ids], np.int64).tobytes() + bytes(x is not None for x in ids)


def unpacked_ids(packed: bytes) -> pa.Array:
    n = len(packed) // 9
    return pa.array(np.frombuffer(packed, np.int64, n), mask=np.frombuffer(packed, np.uint8, n, 8 * n) == 0)


def map_text(df: DataFrame, text_col: str, fields: Sequence[tuple[str, str]], make, keep: Sequence[str]) -> DataFrame:
    """One output row per input row: the `keep` columns and what make(list of bytes) returns.

    make gets the UTF-8 texts of a slice of about 1 MB and returns one list of values per field, in order. Where the first
    of `keep` is a struct that holds `text_col`, the text is taken from it and does not travel a second time.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    inside = text_col not in df.columns
    base = df.select(*[F.col(f"`{c}`") for c in (keep if inside else [*keep, text_col])])
    added = _parse_datatype_string(", ".join(f"{n} {t}" for n, t in fields))
    schema = StructType([*[df.schema[c] for c in keep], *added.fields])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        texts = lambda b: b.column(0).field(text_col) if inside else b.column(n_keep)
        for batch in batches:
            for part in slices(batch, texts(batch)):
                made = make(bytes_of(texts(part)))
                arrays = [part.column(i).cast(out.field(i).type) for i in range(n_keep)]
                arrays += [pa.array(v, out.field(n_keep + i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return base.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, texts: pa.Array, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in row slices of about `most` bytes of its texts (one row at least), so that what a task holds stays small."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, by alternating large-star and small-star rounds.

    Each round maps edges to edges; hubs shrink onto their smallest neighbour, so the number of rounds grows with the
    logarithm of the longest path. Every round is written to the shared folder.
    """
    e = staged(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").distinct())
    last = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = down.join(low, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s"))
        e = staged(small.select("s.a", "s.b").filter("a <> b").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = state
