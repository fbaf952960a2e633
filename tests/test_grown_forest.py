"""Forests grown from binned rows against MLlib's."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from lendframe.operators import models as ml, trees as grown


def _rows(spark, n=4000, parts=5):
    u = lambda seed: F.rand(seed)
    d = spark.range(n, numPartitions=parts).select(
        F.col("id").alias("row_id"), (u(1) * 100).alias("a"), F.floor(u(2) * 7).cast("double").alias("b"), (u(3) - 0.5).alias("c"),
        F.when(u(4) < 0.7, 0.0).otherwise(u(5)).alias("d"), F.lit(3.0).alias("e"))
    p = 0.2 + 0.5 * (F.col("a") > 40).cast("int") - 0.1 * F.col("c") + 0.2 * (F.col("b") == 3).cast("int")
    return ml.checkpoint(ml.assemble(d.withColumn("y", F.when(u(6) < p, 1).otherwise(0)), list("abcde"), "y", keep=("row_id",)))


def _nodes(spark, model):
    path = ml.scratch_path(spark, "nodes")
    model.save(path)
    d = spark.read.parquet(f"{path}/data")
    d = d.select("nodeData.*") if "nodeData" in d.columns else d
    return [r.asDict(recursive=True) for r in d.orderBy("id").collect()]


@pytest.mark.parametrize("weight", [1.0, 2.5])
def test_one_tree_without_draws_is_mllibs(spark, weight, monkeypatch):
    monkeypatch.setattr(grown, "CHUNK_ROWS", 400)
    monkeypatch.setattr(grown, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(grown, "COUNT_BYTES", 40_000)  # several jobs a level
    d = _rows(spark)
    n = {r["y"]: r["count"] for r in d.groupBy("y").count().collect()}
    want = DecisionTreeClassifier(labelCol="y", weightCol="weight", maxDepth=8).fit(d.withColumn("weight", F.when(F.col("y") == 1, weight).otherwise(1.0)))
    est = RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=1, maxDepth=8, seed=42)
    got = ml._grow_forest(d, est, {0.0: (n[0.0], 1.0), 1.0: (n[1.0], weight)}, bootstrap=False, every_feature=True)
    a, b = _nodes(spark, want), _nodes(spark, got)
    assert len(a) == len(b) > 60
    for x, y in zip(a, b):
        for k in ("id", "prediction", "leftChild", "rightChild", "rawCount", "split"):
            assert x[k] == y[k], (k, x, y)
        assert np.allclose([x["impurity"], x["gain"], *x["impurityStats"]], [y["impurity"], y["gain"], *y["impurityStats"]], rtol=1e-9, atol=1e-12)
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())
    pa, pb = (m.transform(d).select("row_id", "prediction").orderBy("row_id").collect() for m in (want, got))
    assert pa == pb


def test_large_tables_are_grown_by_binned_rows(spark, monkeypatch):
    d = _rows(spark, 6000)
    small = ml.fit_forest(d, "y", trees=20, depth=6)
    fits = []
    real = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, x, *a: (fits.append(x.count()), real(self, x, *a))[1])
    monkeypatch.setattr(ml, "GROW_ROWS", 5000)
    big = ml.fit_forest(d, "y", trees=20, depth=6)
    assert fits == [2]  # MLlib gave the model's form only
    assert big.getNumTrees == 20 and big.numFeatures == 5 and big.numClasses == 2
    assert len({t.toDebugString for t in big.trees}) > 1
    # every tree draws about as many rows as there are
    drawn = [t._call_java("rootNode").impurityStats().rawCount() for t in big.trees]
    assert all(abs(n - 6000) < 500 for n in drawn) and len(set(drawn)) > 10
    ev = ml.BinaryClassificationEvaluator(labelCol="y")
    assert abs(ev.evaluate(big.transform(d)) - ev.evaluate(small.transform(d))) < 0.02
    assert np.abs(big.featureImportances.toArray() - small.featureImportances.toArray()).max() < 0.1
    again = ml.fit_forest(d.repartition(3), "y", trees=20, depth=6)
    assert abs(ev.evaluate(again.transform(d)) - ev.evaluate(big.transform(d))) < 0.02
    leaves = ml.leaf_indices(big, d)
    assert leaves.count() == 6000 and leaves.first()["leaves"] is not None
    assert ml.fit_forest(d, "y", trees=3, depth=2, balanced=False).getNumTrees == 3


def test_what_only_mllib_fits_stays_with_it(spark, monkeypatch):
    monkeypatch.setattr(ml, "GROW_ROWS", 0)
    monkeypatch.setattr(ml, "_grow_forest", None)
    d = _rows(spark, 300)
    three = d.withColumn("y", (F.col("row_id") % 3).cast("double"))
    assert ml.fit_forest(three, "y", trees=2, depth=2).numClasses == 3
    assert ml.fit_forest(d.withColumn("weight", F.lit(1.0)), "y", trees=2, depth=2).getNumTrees == 2
    assert ml.fit_forest(d, "y", trees=2, depth=2, minInstancesPerNode=5).getNumTrees == 2


def test_counts_survive_packing():
    h = np.array([0, 1, 255, 256, 70_000, 2 ** 31], dtype=np.uint32)
    assert (grown._unpacked(grown._packed(h), len(h)) == h).all()
