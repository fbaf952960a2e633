"""Distributed ranks, running totals and quantiles against plain windows and numpy."""

import random

import numpy as np
from pyspark.sql import Window, functions as F

from lendframe.operators.ranking import hash_key, hash_row_number, ordered_row_number, running, running_totals
from lendframe.operators import stats
from lendframe.operators.stats import column_stats, distinct_counts, exact_quantiles, modes


def skewed(spark, n=4000):
    rnd = random.Random(3)
    rows = [(i, "hot" if rnd.random() < 0.5 else f"k{i % 7}", 7.0 if rnd.random() < 0.35 else round(rnd.gauss(0, 50), 3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, k string, x double")


def test_bracket_search_is_exact(spark):
    rows, df = skewed(spark)
    df = df.withColumn("y", F.when(F.col("id") % 3 > 0, F.col("x") * 2))
    probs = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
    got = exact_quantiles(df, {"x": probs, "y": probs}, limit=0)
    x = np.array([r[2] for r in rows])
    y = np.array([r[2] * 2 for r in rows if r[0] % 3 > 0])
    for p in probs:
        assert abs(got["x"][p] - np.quantile(x, p)) < 1e-9
        assert abs(got["y"][p] - np.quantile(y, p)) < 1e-9
    small = exact_quantiles(df, {"x": probs})["x"]
    assert all(abs(got["x"][p] - small[p]) < 1e-9 for p in probs)


def test_bracket_search_reads_do_not_grow_with_the_quantiles(spark, monkeypatch):
    """Many quantiles of hot, far apart and special values: few reads, and the values of ``percentile``."""
    rnd = random.Random(5)
    special = [0.0, -0.0, float("inf"), float("-inf"), float("nan"), 5e-324, -1e300]
    rows = [(rnd.gauss(0, 1) * 10.0 ** rnd.randint(-9, 9), float(i % 3), special[i % 7] if i % 4 == 0 else 1.0 + i * 1e-15, None if i else 2.5)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4)
    probs = tuple(k / 100 for k in range(101))
    reads = []
    monkeypatch.setattr(stats, "LISTED_ROWS", 20)
    monkeypatch.setattr(stats, "_bucketed", lambda *a, f=stats._bucketed: reads.append(1) or f(*a))
    got = exact_quantiles(df, {c: probs for c in "abcd"}, limit=0)
    want = exact_quantiles(df, {c: probs for c in "abcd"})
    assert len(reads) <= 7
    for c in "abcd":
        np.testing.assert_allclose([got[c][p] for p in probs], [want[c][p] for p in probs], rtol=1e-12)


def test_value_maps_are_for_small_tables_only(spark, monkeypatch):
    reads = []
    monkeypatch.setattr(stats, "_bucketed", lambda *a, f=stats._bucketed: reads.append(1) or f(*a))
    df = spark.range(0, 300_001).select(F.col("id").cast("double").alias("x"))
    assert exact_quantiles(df, {"x": (0.25, 0.5)}) == {"x": {0.25: 75000.0, 0.5: 150000.0}} and reads


def test_hash_row_number(spark):
    _, df = skewed(spark)
    d = df.withColumn("h", hash_key("id", 1))
    w = Window.partitionBy("k").orderBy("h")
    want = d.withColumn("rn", F.row_number().over(w)).select("id", "rn")
    assert hash_row_number(d, "h", ["k"]).select("id", "rn").exceptAll(want).count() == 0


def test_ordered_row_number_with_ties(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["rn"] for r in ordered_row_number(df, ["x", "id"]).collect()}
    want = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert got == want


def test_running(spark):
    rows, df = skewed(spark)
    d = df.withColumn("one", F.lit(1))
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    got = running_totals(d, "id", ["one"], ["k"]).select("id", "cum_one")
    assert got.exceptAll(d.select("id", F.sum("one").over(w).alias("cum_one"))).count() == 0
    got = running(d, "id", ["x"], ["k"], "max").select("id", "cum_x")
    assert got.exceptAll(d.select("id", F.max("x").over(w).alias("cum_x"))).count() == 0


def test_stats_edges(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (4.0, None, 5.0)], "a double, b double, c double")
    s = column_stats(df)
    assert s["a"].count == 3 and abs(s["a"].mean - 7 / 3) < 1e-12 and s["a"].q(0.5) == 2.0
    assert s["b"].count == 0 and s["b"].mean is None and s["b"].q(0.5) is None and s["b"].nulls == 3
    assert s["c"].std == 0.0 and s["c"].skew is None
    assert distinct_counts(df, ["a", "b", "c"]) == {"a": 3, "b": 0, "c": 1}


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "x string")
    assert modes(df, ["x"]).first()["value"] == "a"
