"""Perceptrons whose gradient is summed by matrix products, against MLlib's."""

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from lendframe.operators import models as ml, network


def _rows(spark, n, parts):
    d = spark.range(n, numPartitions=parts).select(F.col("id").alias("row_id"), F.randn(1).alias("a"), F.randn(2).alias("b"), F.randn(3).alias("c"))
    return ml.checkpoint(ml.assemble(d.withColumn("y", F.when(F.col("a") * F.col("b") + 0.3 * F.randn(4) > F.col("c") / 2, 1).otherwise(0)),
                                     list("abc"), "y", keep=("row_id",)))


def _loss(model, df):
    p = ml.score(model, df, "y", "m")
    return p.agg(F.avg(-F.log(F.when(F.col("label") == 1, F.col("proba")).otherwise(1 - F.col("proba"))))).first()[0]


def test_network_steps_as_mllibs(spark, monkeypatch):
    monkeypatch.setattr(network, "BLOCK_ROWS", 100)
    d = _rows(spark, 1024, 2)  # whole blocks of MLlib
    for iterations in (0, 1, 4, 12):
        est = MultilayerPerceptronClassifier(labelCol="y", layers=[3, 6, 4, 2], maxIter=iterations, seed=42)
        want, got = est.fit(d), ml._summed_network(d, est)
        assert np.allclose(want.weights.toArray(), got.weights.toArray(), rtol=1e-6, atol=1e-8), iterations


def test_gradient_is_the_slope_of_the_loss():
    rng, layers = np.random.default_rng(0), [3, 5, 2]
    x, y, w = rng.normal(size=(40, 3)), rng.integers(0, 2, 40).astype(float), rng.normal(size=3 * 5 + 5 + 5 * 2 + 2)
    _, grad = network.loss_sums(w, layers, x, y)
    for i in range(len(w)):
        h = np.zeros(len(w))
        h[i] = 1e-6
        slope = (network.loss_sums(w + h, layers, x, y)[0] - network.loss_sums(w - h, layers, x, y)[0]) / 2e-6
        assert abs(slope - grad[i]) < 1e-4


def test_large_tables_sum_the_gradient(spark, monkeypatch):
    d = _rows(spark, 1500, 4)
    small = ml.fit_network(d, "y", 3, hidden=(8, 4), iterations=60)
    fits = []
    real = MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", lambda self, x, *a: (fits.append(x.count()), real(self, x, *a))[1])
    monkeypatch.setattr(ml, "GROW_ROWS", 1000)
    big = ml.fit_network(d, "y", 3, hidden=(8, 4), iterations=60)
    assert set(fits) == {2}  # no fit of MLlib reads the rows
    assert abs(_loss(big, d) - _loss(small, d)) < 0.05
    again = ml.fit_network(d.limit(900), "y", 3, hidden=(3,), iterations=2)
    assert fits[-1] == 900 and again.weights.size == 3 * 3 + 3 + 3 * 2 + 2


def test_search_ends_where_nothing_falls():
    got = network.minimized(lambda x: (float(((x - 3) ** 2).sum()), 2 * (x - 3)), np.zeros(4), 100)
    assert np.allclose(got, 3, atol=1e-4)
    flat = network.minimized(lambda x: (1.0, np.zeros(2)), np.ones(2), 100)
    assert (flat == 1).all()
