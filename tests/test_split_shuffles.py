"""Row numbers and splits by hash: the offsets of the buckets are stored, and the rows move once, for their window."""

from pyspark.sql import functions as F

from lendframe.operators import models as ml, split, stats
from lendframe.operators.ranking import hash_key, hash_row_number


def _rows(spark, n=500):
    return spark.range(n).select(F.col("id"), (F.col("id") % 3).alias("y"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))


def _exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in x for x in plan.splitlines())


def test_rows_are_shuffled_for_the_window_alone(spark):
    d = _rows(spark)
    ranked = hash_row_number(d.withColumn("h", hash_key("id")), "h", ["y"])
    assert _exchanges(ranked) == 1
    assert sorted(r["rn"] for r in ranked.where("y = 1").collect()) == list(range(1, 168))
    # and once more for the counts of the labels, a row each
    parts = split.stratified_split(d, "id", "y", 0.2)
    assert _exchanges(parts) <= 2
    assert {r["y"]: r["n"] for r in parts.where("split = 'test'").groupBy("y").agg(F.count("*").alias("n")).collect()} == {0: 33, 1: 33, 2: 33}


def test_split_of_nulls_and_repeated_rows(spark):
    d = spark.createDataFrame([(None, 1), (None, 1), (3, None), (3, None), (4, 1), (5, 1), (6, None)], "id int, y int")
    got = split.stratified_split(d, "id", "y", 0.5)
    assert got.count() == 7 and got.columns == ["id", "y", "split"]
    sizes = {(r["y"], r["split"]): r["count"] for r in got.groupBy("y", "split").count().collect()}
    assert sizes == {(1, "test"): 2, (1, "train"): 2, (None, "test"): 1, (None, "train"): 2}


def test_moments_without_shape_are_the_same(spark):
    d = _rows(spark).select(F.col("id").cast("double").alias("a"), F.sqrt("id").alias("b")).coalesce(1)
    whole, plain = (stats.column_stats(d, ["a", "b"], quantiles=(), shape=s) for s in (True, False))
    for c in ("a", "b"):
        assert (plain[c].n, plain[c].mean, plain[c].std, plain[c].std_pop, plain[c].min, plain[c].max) == (
            whole[c].n, whole[c].mean, whole[c].std, whole[c].std_pop, whole[c].min, whole[c].max)
        assert plain[c].skew_pop is None and whole[c].skew_pop is not None


def test_a_known_number_of_rows_is_not_counted(spark, monkeypatch):
    d = ml.assemble(_rows(spark).select(F.col("id").alias("row_id"), F.col("id").alias("a"), (F.col("id") % 2).alias("y")), ["a"], "y", keep=("row_id",))
    counted = ml.fit_logistic(d, "y")
    monkeypatch.setattr(type(d), "count", None)
    assert ml.fit_logistic(d, "y", rows=500).coefficients == counted.coefficients
