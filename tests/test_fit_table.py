"""Fits over folds: few tasks an iteration, and predictions that are stored once."""

from pyspark.sql import functions as F

from lendframe.operators import models as ml


def _rows(spark, n=400):
    d = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"),
                              F.when(F.col("id") % 7 + F.col("id") % 5 > 4, 1).otherwise(0).alias("y"))
    return ml.assemble(d, ["a", "b"], "y", keep=("row_id",))


def test_fit_table_bounds_the_tasks_and_keeps_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    df = _rows(spark).repartition(20 * cores)
    with ml.fit_table(df) as d:
        assert d.rdd.getNumPartitions() <= 2 * cores
        assert sorted(r["row_id"] for r in d.collect()) == list(range(400))
        assert df.is_cached
    assert not df.is_cached


def test_fit_table_keeps_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(ml, "FIT_ROWS", 10)
    with ml.fit_table(_rows(spark).repartition(100)) as d:
        assert d.rdd.getNumPartitions() == 40


def test_predictions_of_folds_and_blends_are_stored(spark):
    df, fits = _rows(spark), {"l": lambda d: ml.fit_logistic(d, "y"), "m": lambda d: ml.fit_logistic(d, "y", c=0.1)}
    cv = ml.cross_validate(df, "y", fits["l"], 3)
    assert cv.inputFiles()
    assert cv.count() == 3 * 400 and cv.where("part = 'test'").count() == 400
    whole = {r["model"]: r["mean"] for r in ml.compare_models(df, "y", fits, 3).collect()}
    alone = ml.cv_report(ml.fold_scores(cv)).where("metric = 'auc' and part = 'test'").first()["mean"]
    assert abs(whole["l"] - alone) < 1e-9
    p, w = ml.blend(df, df, "y", fits)
    assert p.inputFiles() and p.count() == 400 and abs(sum(w.values()) - 1) < 1e-9


def test_applications_of_a_task_are_bounded(spark, sf, monkeypatch):
    from lendframe.plans import catalog_models, registry
    t = registry.Tables(spark, sf)
    monkeypatch.setattr(registry, "TASK_ROWS", 50)
    for d, n in ((catalog_models._prepared(t), t.lab.count()), (t.dealt(t.loans), t.loans.count())):
        sizes = [r["count"] for r in d.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == n and max(sizes) < 2 * 50


def test_training_keeps_the_inputs_once(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"),
                                 F.when(F.col("id") % 7 + F.col("id") % 5 > 4, 1).otherwise(0).alias("y"))
    seen = []
    got = ml.train(df, ["a", "b"], "y", "id", lambda x: (seen.append((x.columns, x.is_cached)), ml.fit_logistic(x, "y"))[1])
    assert [sorted(c) for c, _ in seen] == [["features", "row_id", "y"]] and seen[0][1]
    assert got.features == ["a", "b"] and got.metrics["accuracy"] > 0.5
