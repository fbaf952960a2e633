"""Exact row numbers and running totals that never sort a whole group in one task.

A window over one label, one model or the whole table would be one task. Here
rows are first spread over ordered buckets; only the small bucket totals go
through a window of their own and give each bucket its offset.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from lendframe.session import checkpoint, saved

#: Hex digits of the hash that name a bucket: 16^3 = 4096 buckets per group.
HASH_DIGITS = 3


def hash_key(id_col: str | Column, seed: int | str | Column = 0) -> Column:
    """md5 of id and seed: a shuffle order that does not depend on partitioning."""
    x = F.col(id_col) if isinstance(id_col, str) else id_col
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(x.cast("string"), F.lit("-"), s.cast("string")))


def hash_fraction(key: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _offsets(sizes: DataFrame, by: list[str], bucket: str, measures: list[str]) -> DataFrame:
    """Sum of the earlier buckets of the group; at most (groups x buckets) rows."""
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*by, bucket, *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(f"_off_{m}") for m in measures])


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(r, cond).drop(*[f"_r_{k}" for k in keys])


def hash_offsets(df: DataFrame, key: str, by: list[str] = ()) -> DataFrame:
    """``by, _b, n, _off_n``: rows of the buckets of a hex hash key and of those before them in the group, stored.

    A stored table has a size that Spark knows, so the rows that it is joined to are not shuffled for it while it is small.
    """
    by = list(by)
    sizes = df.groupBy(*by, F.substring(key, 1, HASH_DIGITS).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return saved(sizes.withColumn("_off_n", F.coalesce(F.sum("n").over(w), F.lit(0))), "offsets")


def hash_row_number(df: DataFrame, key: str, by: list[str] = (), name: str = "rn", offsets: DataFrame | None = None) -> DataFrame:
    """``row_number() over (partition by <by> order by <key>)`` for a hex hash key; ``offsets`` are its :func:`hash_offsets`."""
    by = list(by)
    d = df.withColumn("_b", F.substring(key, 1, HASH_DIGITS))
    off = (hash_offsets(df, key, by) if offsets is None else offsets).drop("n")
    w = Window.partitionBy(*by, "_b").orderBy(key)
    return _null_safe(d, off, [*by, "_b"]).withColumn(
        name, F.row_number().over(w) + F.col("_off_n")).drop("_b", "_off_n")


def ordered_row_number(df: DataFrame, order: list[Column | str], name: str = "rn") -> DataFrame:
    """1-based global row number in the given total order.

    A range sort by the full order (so ties in the leading column still spread),
    written once to the checkpoint folder, then partition offsets.
    """
    s = df.orderBy(*order).withColumn("_pid", F.spark_partition_id()).withColumn(
        "_pos", F.monotonically_increasing_id())
    s = checkpoint(s)
    sizes = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    off = sizes.select("_pid", (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("_first") + 1).alias("_off"))
    return s.join(off, "_pid").withColumn(name, F.col("_pos") + F.col("_off")).drop("_pid", "_pos", "_off")


def range_buckets(df: DataFrame, column: str, n: int | None = None) -> tuple[DataFrame, str]:
    """Add an ordered bucket number with about equal bucket sizes (bounds from a mergeable sketch)."""
    n = n or max(8, min(4096, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    r = df.agg(F.percentile_approx(F.col(column).cast("double"), F.lit(np.arange(1, n) / n), 10_000)).first()[0]
    splits = sorted(set(r or []))
    d = df.withColumn("_x", F.col(column).cast("double"))
    d = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="_x", outputCol="_b", handleInvalid="keep").transform(
        d) if splits else d.withColumn("_b", F.lit(0.0))
    return d.drop("_x"), "_b"


def running_totals(df: DataFrame, order: str, measures: list[str], by: list[str] = ()) -> DataFrame:
    """Running sums ``cum_<m>`` in ascending order of a numeric column, one row per (by, order) value."""
    return running(df, order, measures, by, "sum")


def running(df: DataFrame, order: str, measures: list[str], by: list[str] = (), how: str = "sum") -> DataFrame:
    """Running sum, max or min of measures: totals of the earlier buckets combined with a window inside the bucket."""
    by = list(by)
    fn = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    d, b = range_buckets(df, order)
    sizes = d.groupBy(*by, b).agg(*[fn(m).alias(m) for m in measures])
    wb = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    off = sizes.select(*by, b, *[fn(m).over(wb).alias(f"_off_{m}") for m in measures])
    w = Window.partitionBy(*by, b).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    join = {"sum": lambda x, o: x + F.coalesce(o, F.lit(0)), "max": F.greatest, "min": F.least}[how]
    j = _null_safe(d, off, [*by, b])
    return j.select("*", *[join(fn(m).over(w), F.col(f"_off_{m}")).alias(f"cum_{m}") for m in measures]).drop(
        b, *[f"_off_{m}" for m in measures])
