"""Model training and scoring on ``pyspark.ml``: rows stay on the executors, the driver keeps parameters only."""

from __future__ import annotations

import ast
import functools
import itertools
import math
import random
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassificationModel,
    RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from lendframe.operators import metrics, network, trees as grown
from lendframe.operators.isotonic import apply_blocks, isotonic_blocks
from lendframe.operators.ranking import hash_key, hash_row_number
from lendframe.operators.split import kfold, stratified_split
from lendframe.operators.stats import params_frame
from lendframe.session import checkpoint, saved, scratch_path

FEATURES = "features"
#: Rows that one task of a fit reads at least, where the table has more tasks than two a core.
FIT_ROWS = 100_000
#: Rows above which a forest of two classes is grown by :mod:`lendframe.operators.trees` and a perceptron fitted by
#: :mod:`lendframe.operators.network`, below by MLlib.
GROW_ROWS = 200_000


@contextmanager
def fit_table(df: DataFrame) -> Iterator[DataFrame]:
    """The rows kept for several fits, in at most two tasks a core or one task for ``FIT_ROWS`` rows, whichever is more.

    A fit runs a job an iteration, so the many small tasks of a shuffle would be paid for in each of them.
    """
    kept = df.persist()
    try:
        yield kept.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(kept.count() / FIT_ROWS)))
    finally:
        kept.unpersist()


def _side_by_side(fn: Callable, tasks: list, parallel: int) -> list:
    """Results in the order of the tasks; a bounded number of them share the cluster."""
    with ThreadPool(max(1, min(parallel, len(tasks)))) as pool:
        return pool.map(fn, tasks, chunksize=1)


def assemble(df: DataFrame, columns: list[str], label: str, out: str | None = FEATURES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Numeric columns as one vector (nulls 0) with a double label; ``out=None`` only casts."""
    extra = [c for c in dict.fromkeys([*keep, *(c for c in ("row_id", "weight", "fold", "split", "is_val") if c in df.columns)])]
    d = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns if c not in extra],
                  F.col(label).cast("double").alias(label), *[c for c in extra if c not in columns and c != label])
    return d if out is None else VectorAssembler(inputCols=columns, outputCol=out).transform(d)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``n / (classes * class count)`` per class."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))
    t = g.agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return g.select(label, "cnt", (F.lit(float(t["n"])) / (F.lit(t["k"]) * F.col("cnt"))).alias("weight"))


def with_weights(df: DataFrame, label: str) -> DataFrame:
    """Add the balanced ``weight`` as a literal per class (few classes)."""
    return _weighted(df, label, class_weights(df, label).collect())


def _weighted(df: DataFrame, label: str, rows: list) -> DataFrame:
    w = F.lit(1.0)
    for r in rows:
        w = F.when(F.col(label) == r[label], F.lit(r["weight"])).otherwise(w)
    return df.withColumn("weight", w)


def scale_pos_weight(df: DataFrame, label: str) -> float:
    r = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    return r["neg"] / max(r["pos"], 1)


def fit_forest(df: DataFrame, label: str, trees: int = 100, depth: int = 10, balanced: bool = True, seed: int = 42, **kw):
    """Random forest with balanced class weights. Above ``GROW_ROWS`` rows of two classes the trees are grown from binned rows."""
    est = RandomForestClassifier(labelCol=label, featuresCol=FEATURES, numTrees=trees, maxDepth=depth, seed=seed,
                                 **({"maxMemoryInMB": 1024, "cacheNodeIds": True} | kw))
    if balanced:
        est = est.setWeightCol("weight")
    if "weight" in df.columns:
        return est.fit(df)
    rows = class_weights(df, label).collect()
    if not kw and sorted(str(r[label]) for r in rows) == ["0.0", "1.0"] and sum(r["cnt"] for r in rows) > GROW_ROWS:
        return _grow_forest(df, est, {r[label]: (r["cnt"], r["weight"] if balanced else 1.0) for r in rows})
    return est.fit(_weighted(df, label, rows) if balanced else df)


def _grow_forest(df: DataFrame, est: RandomForestClassifier, classes: dict[float, tuple[int, float]], bootstrap: bool = True,
                 every_feature: bool = False) -> RandomForestClassificationModel:
    """The estimator's forest grown by :mod:`lendframe.operators.trees`; ``classes`` gives count and weight of the labels 0 and 1."""
    spark, label = df.sparkSession, est.getLabelCol()
    weights, n = (classes[0.0][1], classes[1.0][1]), sum(k for k, _ in classes.values())
    share = min(1.0, max(grown.BINS ** 2, 10_000) / n)
    some = df if share == 1.0 else df.sample(False, share, est.getSeed())
    got = some.select(F.col(label).cast("double"), vector_to_array(FEATURES)).toArrow()
    y = got.column(0).to_numpy()
    x = got.column(1).combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    splits = grown.thresholds(x, np.where(y == 1, weights[1], weights[0]), share * sum(k * w for k, w in classes.values()))
    width = len(splits)
    per_node = width if every_feature or est.getNumTrees() == 1 else math.ceil(math.sqrt(width))
    chunks = grown.binned(df, label, FEATURES, splits)
    forest = grown.grow(chunks, splits, est.getNumTrees(), est.getMaxDepth(), per_node, weights, bootstrap, est.getSeed())
    # the model comes from MLlib's own format: two rows give its parameters, the grown nodes replace theirs
    path = scratch_path(spark, "forest")
    two = spark.createDataFrame([(y, 1.0, Vectors.dense([y] * width)) for y in (0.0, 1.0)], [label, "weight", FEATURES]).coalesce(1)
    est.fit(two).save(path)
    grown.stored_nodes(spark, forest, splits, weights).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def fit_boosted(df: DataFrame, label: str, rounds: int = 100, depth: int = 6, step: float = 0.1, val: str | None = None, seed: int = 42, **kw):
    """Boosted trees with ``neg / pos`` weight on the positive class; ``val`` (boolean column) stops early."""
    d = df.withColumn("weight", F.when(F.col(label) == 1, F.lit(scale_pos_weight(df, label))).otherwise(1.0))
    if val:
        kw.update(validationIndicatorCol=val, validationTol=0.001)
    return GBTClassifier(labelCol=label, featuresCol=FEATURES, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed,
                         weightCol="weight", **kw).fit(d)


def fit_network(df: DataFrame, label: str, n_features: int, hidden: tuple[int, ...] = (100, 50), iterations: int = 1000, seed: int = 42):
    """Multilayer perceptron on standardized inputs (scale them first). Above ``GROW_ROWS`` rows the gradient is summed by matrix products."""
    est = MultilayerPerceptronClassifier(labelCol=label, featuresCol=FEATURES, layers=[n_features, *hidden, 2], maxIter=iterations, seed=seed)
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label).isin(0.0, 1.0)).alias("known")).first()
    return _summed_network(df, est) if seen["n"] == seen["known"] > GROW_ROWS else est.fit(df)


def _summed_network(df: DataFrame, est: MultilayerPerceptronClassifier):
    """The estimator's network fitted by :mod:`lendframe.operators.network`: MLlib gives the first weights and takes the last ones."""
    layers, label = est.getLayers(), est.getLabelCol()
    two = df.sparkSession.createDataFrame([(y, Vectors.dense([y] * layers[0])) for y in (0.0, 1.0)], [label, FEATURES]).coalesce(1)
    start = est.copy({est.maxIter: 0}).fit(two).weights
    w = network.minimized(network.mean_loss(network.blocks(df, label, FEATURES), layers), start.toArray(), est.getMaxIter(), est.getTol())
    return est.copy({est.maxIter: 0, est.initialWeights: Vectors.dense(w)}).fit(two)


def fit_logistic(df: DataFrame, label: str, c: float = 1.0, penalty: str = "l2", iterations: int = 50, balanced: bool = False,
                 rows: int | None = None):
    """Logistic regression; inverse strength ``c`` becomes ``1 / (c * n)``. ``rows`` is ``n`` where it is known."""
    d = with_weights(df, label) if balanced else df
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": 0.5}[penalty]
    est = LogisticRegression(labelCol=label, featuresCol=FEATURES, elasticNetParam=mix, maxIter=iterations,
                             regParam=1.0 / (c * max(df.count() if rows is None else rows, 1)))
    return (est.setWeightCol("weight") if balanced else est).fit(d)


def fit_margin(df: DataFrame, label: str, iterations: int = 20):
    """Linear support-vector classifier."""
    return LinearSVC(labelCol=label, featuresCol=FEATURES, maxIter=iterations, regParam=0.01).fit(df)


def score(model, df: DataFrame, label: str, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Prediction rows ``(row_id, model, label, proba, pred)``; a margin becomes a probability by the logistic curve."""
    p = model.transform(df)
    if "probability" in p.columns:
        proba = vector_to_array("probability")[1]
    else:
        proba = 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))
    return p.select("row_id", *keep, F.lit(name).alias("model"), F.col(label).cast("int").alias("label"), proba.alias("proba"),
                    F.col("prediction").cast("int").alias("pred"))


def importances(model, columns: list[str]) -> dict[str, float]:
    """Importance per feature: tree importances, or normalized absolute coefficients."""
    if hasattr(model, "featureImportances"):
        v = model.featureImportances.toArray()
    else:
        v = abs(model.coefficients.toArray())
        v = v / (v.sum() or 1.0)
    return dict(zip(columns, map(float, v)))


def importance_table(spark, model, columns: list[str], top: int | None = None) -> DataFrame:
    imp = importances(model, columns)
    t = params_frame(spark, list(imp.items()), "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return t.limit(top) if top else t


def tree_nodes(spark, model) -> DataFrame:
    """Stored nodes of a forest or boosted trees: ``tree, node, feature`` (its number, null at a leaf), ``gain`` and weighted ``rows``."""
    path = scratch_path(spark, "trees")
    model.save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    # the trees of boosting are fitted on residuals: count, sum, sum of squares instead of one count a class
    stats = F.col("impurityStats")
    rows = stats[0] if isinstance(model, GBTClassificationModel) else F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    inner = F.col("leftChild") >= 0
    return n.select(F.col("treeID").alias("tree"), F.col("id").alias("node"), F.when(inner, F.col("split.featureIndex")).alias("feature"),
                    F.when(inner, F.col("gain")).alias("gain"), rows.alias("rows"))


def split_importance(spark, model, columns: list[str]) -> DataFrame:
    """``feature, weight`` (splits on it), mean ``gain`` and ``cover`` (weighted rows) of a split, and their totals; unused features give 0."""
    used = tree_nodes(spark, model).where("feature is not null").groupBy("feature").agg(
        F.count(F.lit(1)).alias("weight"), F.avg("gain").alias("gain"), F.avg("rows").alias("cover"), F.sum("gain").alias("total_gain"),
        F.sum("rows").alias("total_cover")).withColumnRenamed("feature", "_i")
    names = params_frame(spark, list(enumerate(columns)), "_i int, feature string")
    return names.join(used, "_i", "left").drop("_i").na.fill(0)


def permutation_importance(model, df: DataFrame, label: str, columns: list[str], seed: int = 42) -> DataFrame:
    """``feature, auc`` with the feature's values dealt to other rows, and the ``drop`` against the rows as they are.

    ``df`` is an assembled table with ``row_id``. One permutation of all rows serves every feature: rows meet
    their donors in two hash orders, and a row is scored once a feature with that one value taken from its donor.
    """
    rows = saved(df.select("row_id", label, vector_to_array(FEATURES).alias("_x")), "rows")
    own = hash_row_number(rows.withColumn("_h", hash_key("row_id", seed)), "_h").drop("_h")
    donors = hash_row_number(rows.select("row_id", F.col("_x").alias("_y")).withColumn("_h", hash_key("row_id", seed + 1)), "_h").select("rn", "_y")
    k = F.explode(F.array(F.lit(-1), *[F.lit(i) for i in range(len(columns))]))
    taken = F.concat(F.slice("_x", F.lit(1), F.col("_k")), F.array(F.get("_y", F.col("_k"))), F.slice("_x", F.col("_k") + 2, F.lit(len(columns))))
    mixed = own.join(donors, "rn").withColumn("_k", k).withColumn(FEATURES, array_to_vector(F.when(F.col("_k") < 0, F.col("_x")).otherwise(taken)))
    # the metrics read the scores several times: once a feature and row is scored, not once a reading
    scored = saved(score(model, mixed.select("row_id", label, "_k", FEATURES), label, "model", keep=("_k",)).select("_k", "label", "proba"), "scores")
    auc = checkpoint(metrics.rank_metrics(scored, ("_k",)).select("_k", "auc"))
    base = auc.where("_k = -1").select(F.col("auc").alias("_base"))
    names = params_frame(df.sparkSession, list(enumerate(columns)), "_k int, feature string")
    return names.join(auc, "_k").join(F.broadcast(base)).select("feature", "auc", (F.col("_base") - F.col("auc")).alias("drop"))


def boosting_history(model, df: DataFrame) -> DataFrame:
    """Loss after each boosting round."""
    losses = model.evaluateEachIteration(df if "weight" in df.columns else df.withColumn("weight", F.lit(1.0)))
    return params_frame(df.sparkSession, [(i + 1, float(v)) for i, v in enumerate(losses)], "round int, loss double")


def leaf_indices(model, df: DataFrame) -> DataFrame:
    """Leaf number per tree for each row."""
    return model.setLeafCol("leaves").transform(df).select("row_id", vector_to_array("leaves").alias("leaves"))


def explain_rows(df: DataFrame, columns: list[str], imp: dict[str, float], id_col: str, top: int = 10) -> DataFrame:
    """The ``top`` features per row by |value x importance|. The entries of one row are a small array sorted in place."""
    e = F.array(*[F.struct((-F.abs(F.col(c).cast("double") * imp[c])).alias("k"), F.lit(c).alias("feature"),
                           (F.col(c).cast("double") * imp[c]).alias("contribution")) for c in columns])
    best = F.slice(F.sort_array(F.filter(e, lambda s: s["contribution"].isNotNull())), 1, top)
    return df.select(id_col, F.posexplode(best).alias("rank", "e")).select(id_col, (F.col("rank") + 1).alias("rank"), "e.feature", "e.contribution")


def save_model(model, path: str) -> None:
    """Write a fitted model or chain of stages."""
    (model if isinstance(model, PipelineModel) else PipelineModel([model])).write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def decisions(model, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Batch or streaming scoring: Y / N, probability of Y, and the larger class probability."""
    p = vector_to_array("probability")[1]
    return model.transform(df).select(*keep, F.when(F.col("prediction") == 1, "Y").otherwise("N").alias("decision"), p.alias("probability"),
                                      F.greatest(p, 1 - p).alias("confidence"))


@dataclass
class Trained:
    model: object
    metrics: dict[str, float]
    seconds: float
    features: list[str] = field(default_factory=list)


def train(df: DataFrame, columns: list[str], label: str, id_col: str, fit: Callable, test: float = 0.2,
          prepare: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> Trained:
    """Stratified split, optional preparation fitted on the training part, fit, validation metrics, time."""
    t0 = time.time()
    s = checkpoint(stratified_split(df.withColumn("row_id", F.col(id_col)), "row_id", label, test))
    tr, te = s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")
    if prepare:
        tr, te = prepare(tr, te)
    # the vector has the inputs already: their columns would be kept a second time
    x = assemble(tr, columns, label, keep=("row_id",)).drop(*(c for c in columns if c not in ("row_id", "weight", "fold", "split", "is_val"))).persist()
    m = fit(x)
    p = score(m, assemble(te, columns, label, keep=("row_id",)), label, "m").persist()
    row = metrics.classification_metrics(p).join(metrics.rank_metrics(p), "model").first().asDict()
    row.pop("model")
    x.unpersist()
    p.unpersist()
    return Trained(m, row, time.time() - t0, columns)


# --- cross-validation and search ----------------------------------------------------------------

def cross_validate(df: DataFrame, label: str, fit: Callable, k: int = 5, name: str = "m", id_col: str = "row_id", parallel: int = 4) -> DataFrame:
    """Out-of-fold and training predictions of every fold in one stored table: ``fold, part, row_id, model, ...``."""
    with fit_table(df if "fold" in df.columns else kfold(df, id_col, k, label)) as d:
        return _fold_predictions(d, label, {name: fit}, k, parallel)


def _fold_predictions(d: DataFrame, label: str, fits: dict[str, Callable], k: int, parallel: int, parts: tuple[str, ...] = ("test", "train")) -> DataFrame:
    """Stored predictions of every model and fold on the wanted ``parts`` of the table."""
    def one(task: tuple[str, int]) -> DataFrame:
        name, f = task
        part = F.when(F.col("fold") == f, "test").otherwise("train")
        s = score(fits[name](d.where(F.col("fold") != f)), d.where(part.isin(*parts)), label, name, ("fold",))
        return saved(s.withColumn("part", part).withColumn("fold", F.lit(f)), "folds")
    return functools.reduce(DataFrame.unionByName, _side_by_side(one, list(itertools.product(fits, range(k))), parallel))


def fold_scores(cv: DataFrame) -> DataFrame:
    """Accuracy, F1 and AUC per model, fold and part."""
    by = ["model", "fold", "part"]
    c = metrics.classification_metrics(cv, by).select(*by, "accuracy", "f1")
    return c.join(metrics.rank_metrics(cv, by).select(*by, "auc"), by)


def cv_report(scores: DataFrame, names: tuple[str, ...] = ("accuracy", "f1", "auc")) -> DataFrame:
    """Long report: mean, population deviation, min, max, range over folds per model, metric and part."""
    long = scores.select("model", "fold", "part", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])).alias("e")).select("model", "fold", "part", "e.*")
    return long.groupBy("model", "metric", "part").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        (F.max("value") - F.min("value")).alias("range"))


def compare_models(df: DataFrame, label: str, fits: dict[str, Callable], k: int = 5, metric: str = "auc", parallel: int = 4) -> DataFrame:
    """Models by mean test metric over the same folds."""
    with fit_table(kfold(df, "row_id", k, label)) as d:
        out = _fold_predictions(d, label, fits, k, parallel, ("test",))
    rep = cv_report(fold_scores(out)).where((F.col("metric") == metric) & (F.col("part") == "test"))
    return rep.select("model", "mean", "std").orderBy(F.desc("mean"), "model")


def search(df: DataFrame, label: str, build: Callable[..., Callable], space: dict[str, list], k: int = 5, n_iter: int | None = None,
           metric: str = "auc", seed: int = 42, parallel: int = 4) -> DataFrame:
    """Grid (or ``n_iter`` random) parameter search by cross-validation; one row per combination, best first."""
    names = sorted(space)
    combos = list(itertools.product(*[space[n] for n in names]))
    if n_iter and n_iter < len(combos):
        combos = random.Random(seed).sample(combos, n_iter)
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction")
    with fit_table(kfold(df, "row_id", k, label)) as d:
        def one(task: tuple[int, int]) -> float:
            i, f = task
            m = build(**dict(zip(names, combos[i])))(d.where(F.col("fold") != f))
            return float(ev.evaluate(m.transform(d.where(F.col("fold") == f))))
        vals = _side_by_side(one, list(itertools.product(range(len(combos)), range(k))), parallel)
    rows = [(i, str(dict(zip(names, combo))), sum(vals[i * k:(i + 1) * k]) / k) for i, combo in enumerate(combos)]
    return params_frame(df.sparkSession, rows, f"trial int, params string, {metric} double").orderBy(F.desc(metric), "trial")


def refit_best(df: DataFrame, label: str, build: Callable[..., Callable], space: dict[str, list], **kw) -> tuple[DataFrame, object]:
    """The search's table, and a model of the best setting fitted on all rows."""
    trials = search(df, label, build, space, **kw)
    return trials, build(**ast.literal_eval(trials.first()["params"]))(df)


# --- calibration, stacking, blending ------------------------------------------------------------

def fit_platt(preds: DataFrame):
    """Logistic curve on the probability, lightly regularized."""
    d = preds.select(array_to_vector(F.array("proba")).alias("x"), F.col("label").cast("double").alias("y"))
    n = max(d.count(), 1)
    return LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / n, standardization=False).fit(d)


def apply_platt(preds: DataFrame, model) -> DataFrame:
    a, b = float(model.coefficients[0]), float(model.intercept)
    return preds.withColumn("proba", 1.0 / (1.0 + F.exp(-(F.col("proba") * a + b))))


def fit_isotonic(preds: DataFrame) -> DataFrame:
    """Isotonic regression on the exact probabilities, as a stored table of blocks."""
    return isotonic_blocks(preds)


def apply_isotonic(preds: DataFrame, blocks: DataFrame) -> DataFrame:
    return apply_blocks(preds, blocks)


def stack(df: DataFrame, test: DataFrame, label: str, fits: dict[str, Callable], k: int = 5, parallel: int = 4) -> DataFrame:
    """Out-of-fold probabilities of the base models train a logistic model; returns test predictions.

    All fits, of the folds and of the whole, share a bounded pool; each stores its predictions, so the meta model reads plain tables.
    """
    names = list(fits)
    tasks = [(name, f) for name in names for f in (*range(k), None)]
    with fit_table(kfold(df, "row_id", k, label)) as d:
        def one(task: tuple[str, int | None]) -> DataFrame:
            name, f = task
            m = fits[name](d if f is None else d.where(F.col("fold") != f))
            return saved(score(m, test if f is None else d.where(F.col("fold") == f), label, name), "stack")
        parts = _side_by_side(one, tasks, parallel)
    wide = lambda whole: VectorAssembler(inputCols=names, outputCol=FEATURES).transform(
        functools.reduce(DataFrame.unionByName, [p for p, (_, f) in zip(parts, tasks) if (f is None) == whole]).groupBy("row_id", "label").pivot(
            "model", names).agg(F.first("proba")).withColumn("label", F.col("label").cast("double")))
    meta = LogisticRegression(labelCol="label", featuresCol=FEATURES, regParam=1e-4).fit(wide(False))
    return score(meta, wide(True), "label", "stack")


def blend(df: DataFrame, test: DataFrame, label: str, fits: dict[str, Callable], refit: bool = True, holdout: float = 0.2,
          parallel: int = 4) -> tuple[DataFrame, dict[str, float]]:
    """Weights from a hold-out (best of the weight grid), then (refitted) models vote by weighted mean probability.

    The fits share a bounded pool, and each stores its predictions.
    """
    from lendframe.operators.ensemble import search_weights, soft_vote
    names = list(fits)
    with fit_table(stratified_split(df, "row_id", label, holdout)) as s:
        tr, ho = s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")

        def one(task: tuple[str, bool]) -> list[DataFrame]:
            name, whole = task
            m = fits[name](df if whole else tr)
            to = [test] if whole else [ho] if refit else [ho, test]
            return [saved(score(m, x, label, name), "blend") for x in to]
        tasks = [(name, whole) for whole in ((False, True) if refit else (False,)) for name in names]
        parts = _side_by_side(one, tasks, parallel)
    val = functools.reduce(DataFrame.unionByName, [p[0] for p in parts[:len(names)]])
    out = functools.reduce(DataFrame.unionByName, [p[-1] for p in parts[-len(names):]])
    best = search_weights(val, names).first()
    w = {n: best[f"w_{n}"] for n in names}
    return soft_vote(out, w), w


def chain(stages: list) -> Pipeline:
    return Pipeline(stages=stages)

