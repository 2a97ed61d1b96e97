"""Column functions on vectors and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def total(a: Column) -> Column:
    """Sum of an array from left to right."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def gmean(x) -> Column:
    """Geometric mean of the positive values (aggregate)."""
    c = F.col(x) if isinstance(x, str) else x
    return F.exp(F.avg(F.when(c > 0, F.log(c))))


def code(c: str | Column) -> Column:
    """Number of a label in the sorted list of labels, from 0 (over a table of labels)."""
    return F.dense_rank().over(Window.orderBy(c)) - 1


def average_rank(value: Column, *by: Column | str, descending: bool = False) -> Column:
    """Mean of the ranks that equal values share, from 1."""
    order = value.desc() if descending else value.asc()
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def percent_rank(value: Column, *by: Column | str, descending: bool = False) -> Column:
    """Average rank over the size of the group."""
    return average_rank(value, *by, descending=descending) / F.count(F.lit(1)).over(Window.partitionBy(*by))


def standardized(df: DataFrame, value: str, *by: str) -> DataFrame:
    """`value` as z-scores within groups; the groups' statistics are aggregated (with partial sums) and joined."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.join(stats, list(by)).withColumn(value, (F.col(value) - F.col("__m")) / F.col("__s")).drop("__m", "__s")


def robust_scaled(df: DataFrame, value: str, *by: str) -> DataFrame:
    """`value` less the mean over the interquartile range of its group, with a range of 0 as 1; statistics as above."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    stats = df.groupBy(*by).agg(F.avg(value).alias("__m"), q.alias("__q"))
    width = F.col("__q")[1] - F.col("__q")[0]
    return df.join(stats, list(by)).withColumn(value, (F.col(value) - F.col("__m")) / F.when(width == 0, 1.0).otherwise(width)).drop("__m", "__q")


def rotated_all(df: DataFrame, vec: str, degree: float) -> DataFrame:
    """2-D vectors turned about the mean of all rows, which is one row of an aggregate."""
    import math

    centre = df.agg(F.avg(F.col(vec)[0]).alias("__x"), F.avg(F.col(vec)[1]).alias("__y"))
    s, c, x, y = math.sin(math.radians(degree)), math.cos(math.radians(degree)), F.col(vec)[0] - F.col("__x"), F.col(vec)[1] - F.col("__y")
    return df.crossJoin(F.broadcast(centre)).withColumn(vec, F.array(F.col("__x") + x * c - y * s, F.col("__y") + x * s + y * c)).drop("__x", "__y")
