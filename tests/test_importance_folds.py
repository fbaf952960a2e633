"""Importances of tree models, and folds that fill the lightest fold."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lendframe.operators import metrics, models, split


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"),
                                F.lit(3.0).alias("c"), ((F.col("id") % 7 > 3) | (F.col("id") % 11 > 8)).cast("int").alias("y"))
    return models.assemble(d, ["a", "b", "c"], "y", keep=("row_id",)).cache()


@pytest.mark.parametrize("fit", [lambda d: models.fit_forest(d, "y", trees=5, depth=4), lambda d: models.fit_boosted(d, "y", rounds=4, depth=3)])
def test_split_importance_counts_the_splits(spark, rows, fit):
    model = fit(rows)
    got = {r.feature: r for r in models.split_importance(spark, model, ["a", "b", "c"]).collect()}
    said = Counter(int(x) for x in re.findall(r"If \(feature (\d+)", model.toDebugString))
    assert {f: got[f].weight for f in "abc"} == {f: said[i] for i, f in enumerate("abc")}
    assert got["c"].weight == 0 and got["c"].gain == 0 and got["c"].total_cover == 0
    for f in "ab":
        assert got[f].total_gain == pytest.approx(got[f].gain * got[f].weight)
        assert got[f].total_cover == pytest.approx(got[f].cover * got[f].weight)
        assert got[f].gain > 0 and got[f].cover > 0


def test_nodes_of_one_tree_give_the_importances_of_the_library(spark, rows):
    model = models.fit_forest(rows, "y", trees=1, depth=4, balanced=False)
    t = models.tree_nodes(spark, model).where("feature is not null").groupBy("feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("g")).collect()
    whole = sum(r.g for r in t)
    assert {r.feature: r.g / whole for r in t} == pytest.approx({i: v for i, v in enumerate(model.featureImportances.toArray().tolist()) if v})
    root = models.tree_nodes(spark, model).where("node = 0").first()
    inner = models.tree_nodes(spark, model).where("feature is null").agg(F.sum("rows")).first()[0]
    assert root.rows == inner  # every row ends in one leaf


def test_permutation_importance(spark, rows):
    model = models.fit_forest(rows.withColumn("_", F.lit(0)), "y", trees=5, depth=4)
    base = metrics.rank_metrics(models.score(model, rows, "y", "m")).first().auc
    got = {r.feature: r for r in models.permutation_importance(model, rows, "y", ["a", "b", "c"]).collect()}
    assert got["c"].drop == 0 and got["c"].auc == pytest.approx(base)  # a constant loses nothing
    assert got["a"].drop > 0.2 and got["b"].drop > 0.02
    assert got["a"].auc + got["a"].drop == pytest.approx(base)


def plain(sizes, k):
    loads, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda e: (-e[1], e[0])):
        f = loads.index(min(loads))
        loads[f] += n
        out[g] = f
    return out, loads


def table(spark, sizes):
    return spark.createDataFrame([(g, n) for g, n in sizes.items()], "g bigint, n int").select(
        "g", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))


@pytest.mark.parametrize("k", [2, 3, 5])
def test_lightest_folds(spark, k):
    sizes = {g: 1 + (g * g) % 37 for g in range(200)} | {1000: 900, 1001: 400}
    d = table(spark, sizes)
    want, _ = plain(sizes, k)
    got = split.lightest_folds(d, "g", k).collect()
    assert {r.g: r.fold for r in got} == want and {r.g: r["size"] for r in got} == sizes
    for heavy in (0, 1, 2, 20, 202):
        got = split.lightest_folds(d, "g", k, heavy=heavy).collect()
        assert {r.g: r["size"] for r in got} == sizes
        loads = [sum(r["size"] for r in got if r.fold == f) for f in range(k)]
        ranked = sorted(sizes.items(), key=lambda e: (-e[1], e[0]))
        top = plain(dict(ranked[:heavy]), k)[1]
        rest = [n for _, n in ranked[heavy:]]
        level = max(x for x in range(sum(sizes.values())) if sum(max(0, x - t) for t in top) <= sum(rest))
        for load, t in zip(loads, top, strict=True):  # a fold ends at the common level, or where its heavy groups left it
            assert abs(load - max(t, level)) <= (rest[0] + 1 if rest and t < level else 1 if t < level else 0)


def test_folds_keep_null_and_empty(spark):
    d = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (2, 4)], "g bigint, i int")
    rows = split.group_kfold(d, "g", 2, lightest=True).collect()
    assert len(rows) == 4 and len({r.fold for r in rows if r.g is None}) == 1
    assert split.lightest_folds(d.limit(0), "g", 3).count() == 0
