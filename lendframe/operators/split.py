"""Samples, splits and folds. Assignments hash the row id, so they do not depend on partitioning."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, functions as F

from lendframe.operators.ranking import hash_fraction, hash_key, hash_offsets, hash_row_number, ordered_row_number, running_totals


def sample_rows(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order: a top-k per task, then a merge."""
    return df.withColumn("_h", hash_key(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h")


def stratified_split(df: DataFrame, id_col: str, label: str, test: float = 0.2, val: float = 0.0,
                     seed: int = 42) -> DataFrame:
    """Add ``split`` (train / val / test) with exact per-label sizes (rounded down)."""
    keyed = df.withColumn("_h", hash_key(id_col, seed))
    offsets = hash_offsets(keyed, "_h", [label])
    counts = offsets.groupBy(F.col(label).alias("_l")).agg(F.sum("n").alias("_cnt"))
    ranked = hash_row_number(keyed, "_h", [label], offsets=offsets)
    out = ranked.join(counts, F.col(label).eqNullSafe(F.col("_l")))
    t, v = F.floor(F.col("_cnt") * test), F.floor(F.col("_cnt") * (test + val))
    split = F.when(F.col("rn") <= t, "test").when(F.col("rn") <= v, "val").otherwise("train")
    return out.withColumn("split", split).drop("_h", "rn", "_cnt", "_l")


def random_split(df: DataFrame, id_col: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` by hash fraction; no shuffle."""
    return df.withColumn("split", F.when(hash_fraction(hash_key(id_col, seed)) < test, "test").otherwise("train"))


def kfold(df: DataFrame, id_col: str, k: int = 5, label: str | None = None, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..k-1 with sizes that differ by at most one (per label when given)."""
    d = hash_row_number(df.withColumn("_h", hash_key(id_col, seed)), "_h", [label] if label else [])
    return d.withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("_h", "rn")


def hash_fold(df: DataFrame, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` by hash alone: sizes equal in expectation, no shuffle."""
    return df.withColumn("fold", F.floor(hash_fraction(hash_key(id_col, seed)) * k).cast("int"))


def time_splits(df: DataFrame, order: list[str], k: int = 5, gap: int = 0, test_size: int | None = None,
                max_train: int | None = None) -> DataFrame:
    """Forward chaining: rows with ``split`` 0..k-1 and ``role`` train or test (a row may occur in several)."""
    ranked = ordered_row_number(df, order)
    n = ranked.count()
    size = test_size or n // (k + 1)
    parts = []
    for i in range(k):
        start = n - (k - i) * size
        end = start - gap
        first = max(0, end - max_train) if max_train else 0
        r = F.col("rn")
        role = F.when((r > start) & (r <= start + size), "test").when((r > first) & (r <= end), "train")
        parts.append(F.when(role.isNotNull(), F.struct(F.lit(i).alias("split"), role.alias("role"))))
    keep = F.filter(F.array(*parts), lambda e: e.isNotNull())
    return ranked.withColumn("_e", F.explode(keep)).select(*df.columns, "rn", "_e.split", "_e.role")


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Table ``(group, size, fold)``: groups by falling size dealt forth and back over the folds.

    Whole groups stay together; a group larger than n / k makes its fold that large.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    r = ordered_row_number(sizes, [F.desc("size"), F.asc(group)])
    pos = F.col("rn") - 1
    inner = pos % k
    return r.select(group, "size", F.when(F.floor(pos / k) % 2 == 0, inner).otherwise(k - 1 - inner).cast("int").alias("fold"))


#: Groups that are placed one by one on the lightest fold; the others go by a running total.
HEAVY_GROUPS = 10_000


def lightest_folds(df: DataFrame, group: str, k: int = 5, heavy: int = HEAVY_GROUPS) -> DataFrame:
    """Table ``(group, size, fold)``: by falling size (ties by group), each group goes to the lightest fold (ties to the first).

    The ``heavy`` largest groups are placed so, on the driver, which holds no more than these. The rest fill what every
    fold lacks to a common level, in order of size by a running total: loads then differ by less than twice the
    largest of the rest, unless a heavy group alone is above that level. Null is a group like any other.
    """
    sizes = ordered_row_number(df.groupBy(group).agg(F.count(F.lit(1)).alias("size")), [F.desc("size"), F.asc(group)])
    loads = [(0, f) for f in range(k)]
    placed = []
    for r in sizes.where(F.col("rn") <= heavy).orderBy("rn").select("rn", "size").collect():
        load, f = heapq.heappop(loads)
        heapq.heappush(loads, (load + r["size"], f))
        placed.append((r["rn"], f))
    spark = df.sparkSession
    first = sizes.join(F.broadcast(spark.createDataFrame(placed, "rn bigint, fold int")), "rn").select(group, "size", "fold")
    rest = sizes.where(F.col("rn") > heavy)
    total = rest.agg(F.sum("size")).first()[0]
    if not total:
        return first
    load = [x for x, _ in sorted(loads, key=lambda e: e[1])]
    # the level up to which the rest fills the folds: only folds below it take part
    low = sorted(load)
    level = next(v for j in range(1, k + 1) if (v := (sum(low[:j]) + total) / j) <= (low[j] if j < k else math.inf))
    begin, edge = F.col("cum_size") - F.col("size"), 0.0
    fold = F.lit(None).cast("int")
    for f in sorted(range(k), key=lambda f: load[f], reverse=True):  # the last interval has no end
        if level > load[f]:
            fold = F.coalesce(fold, F.when(begin < edge + level - load[f], f))
            edge, last = edge + level - load[f], f
    dealt = running_totals(rest, "rn", ["size"]).withColumn("fold", F.coalesce(fold, F.lit(last)))
    return first.unionByName(dealt.select(group, "size", "fold"))


def group_kfold(df: DataFrame, group: str, k: int = 5, lightest: bool = False) -> DataFrame:
    """Rows with the fold of their group, dealt forth and back or (``lightest``) always to the lightest fold."""
    if lightest:
        folds = lightest_folds(df, group, k).select(F.col(group).alias("_g"), "fold")
        return df.join(folds, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    return df.join(group_folds(df, group, k).select(group, "fold"), group)


def shuffle_splits(df: DataFrame, id_col: str, repeats: int = 5, test: float = 0.2, label: str | None = None,
                   seed: int = 42) -> DataFrame:
    """Repeated (stratified) random splits: rows with ``repeat`` and ``split``, one hash order per repeat."""
    d = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = d.withColumn("_h", hash_key(id_col, F.concat(F.lit(f"{seed}-"), F.col("repeat").cast("string"))))
    by = ["repeat", label] if label else ["repeat"]
    counts = df.groupBy(*([label] if label else [])).agg(F.count(F.lit(1)).alias("_cnt"))
    ranked = hash_row_number(d, "_h", by)
    if label:
        out = ranked.join(counts.withColumnRenamed(label, "_l"), F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
    else:
        out = ranked.withColumn("_cnt", F.lit(counts.first()[0]))
    return out.withColumn("split", F.when(F.col("rn") <= F.floor(F.col("_cnt") * test), "test").otherwise("train")).drop(
        "_h", "rn", "_cnt")
