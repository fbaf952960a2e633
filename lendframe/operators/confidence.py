"""Confidence, uncertainty, thresholds, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lendframe.operators.metrics import probability_scores
from lendframe.operators.stats import exact_quantiles, params_frame

# Lower limits of the review bands.
BANDS = ((0.9, "very_high"), (0.7, "high"), (0.5, "medium"), (0.3, "low"), (0.0, "very_low"))
THRESHOLDS = tuple(k / 10 for k in range(1, 10))


def confidence(p: Column, method: str = "entropy") -> Column:
    """entropy (1 minus bits), max_prob or margin of a binary probability."""
    if method == "entropy":
        return 1.0 + (1 - p) * F.log2(1 - p + 1e-8) + p * F.log2(p + 1e-8)
    if method == "max_prob":
        return F.greatest(p, 1 - p)
    if method == "margin":
        return F.abs(2 * p - 1)
    raise ValueError(f"unknown method {method}")


def variance_confidence(preds: DataFrame) -> DataFrame:
    """``1 / (1 + variance)`` of the probabilities over the models of each row."""
    return preds.groupBy("row_id").agg((1.0 / (1.0 + F.var_pop("proba"))).alias("confidence"))


def band(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for lo, name in BANDS:
        out = out.when(c >= lo, name)
    return out


def uncertainty(preds: DataFrame) -> DataFrame:
    """Per row over the models: mean, epistemic (population deviation), aleatoric p(1-p), total, variance."""
    g = preds.groupBy("row_id", "label").agg(F.avg("proba").alias("mean_prediction"), F.stddev_pop("proba").alias("epistemic"))
    m = F.col("mean_prediction")
    return g.select("row_id", "label", "mean_prediction", "epistemic", (m * (1 - m)).alias("aleatoric"),
                    (F.col("epistemic") + m * (1 - m)).alias("total"), (F.col("epistemic") * F.col("epistemic")).alias("variance"))


def uncertainty_error_correlation(u: DataFrame) -> DataFrame:
    return u.agg(F.corr("total", F.abs(F.col("label") - F.col("mean_prediction"))).alias("r"))


def threshold_sweep(preds: DataFrame, conf: Column, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Coverage, accuracy, precision, recall, F1 of the rows with confidence at least t.

    Rows are counted once by the number of thresholds they reach; the totals per threshold
    are then suffix sums over at most len(thresholds) + 1 rows per model.
    """
    reach = sum((F.when(conf >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    y, p = F.col("label"), F.when(F.col("proba") > 0.5, 1).otherwise(0)
    c = preds.groupBy("model", reach.alias("_k")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if(y == p).alias("ok"))
    cells = c.select("model", "n", "tp", "fp", "fn", "ok", F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("_k"))
    s = cells.groupBy("model", "_k").agg(*[F.sum(x).alias(x) for x in ("n", "tp", "fp", "fn", "ok")])
    total = s.where("_k = 0").select("model", F.col("n").alias("total"))
    grid = F.array(*[F.struct(F.lit(i + 1).alias("_k"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(thresholds)])
    out = total.select("model", "total", F.explode(grid).alias("_g")).select("model", "total", "_g.*").join(s, ["model", "_k"], "left")
    pr, rc = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    z = lambda x: F.when(F.col("n") > 0, F.coalesce(x, F.lit(0.0)))
    return out.select("model", "threshold", F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("coverage"),
                      (F.col("ok") / F.col("n")).alias("accuracy"), z(pr).alias("precision"), z(rc).alias("recall"),
                      z(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def best_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """Threshold with the best metric per model; the first best wins."""
    best = F.max(F.struct(F.col(metric).alias("m"), (-F.col("threshold")).alias("t")))
    return sweep.where(F.col(metric).isNotNull()).groupBy("model").agg(best.alias("b")).select(
        "model", (-F.col("b.t")).alias("threshold"), F.col("b.m").alias(metric))


def ensemble_confidence(preds: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Agreement, consensus and diversity confidence per row and their mean; arrays hold one entry per model."""
    g = preds.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("model", "proba"))).alias("a"))
    p = F.transform("a", lambda e: e["proba"])
    n = F.size("a")
    if weights:
        m = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        w = F.transform("a", lambda e: F.coalesce(F.try_element_at(m, e["model"]), F.lit(0.0)))
    else:
        w = F.transform("a", lambda e: F.lit(1.0))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)
    g = g.select("row_id", p.alias("p"), w.alias("w"), n.alias("n"))
    mean = total(F.col("p")) / F.col("n")
    g = g.withColumn("mean", mean).withColumn(
        "weighted_prediction", total(F.zip_with("p", "w", lambda a, b: a * b)) / total(F.col("w")))
    var = total(F.transform("p", lambda v: (v - F.col("mean")) * (v - F.col("mean")))) / F.col("n")
    # sum over pairs |pi - pj| of a sorted array is sum of (2i - n + 1) p_i
    srt = F.sort_array("p")
    pairs = total(F.transform(srt, lambda v, i: v * (2 * i - F.col("n") + 1)))
    g = g.withColumn("prediction_variance", var).withColumn("pair_diff", F.coalesce(
        F.try_divide(pairs, F.col("n") * (F.col("n") - 1) / 2.0), F.lit(0.0)))
    agree = 1 - F.sqrt("prediction_variance") / 0.5
    cons = F.abs(2 * F.col("weighted_prediction") - 1)
    div = 1 / (1 + F.col("pair_diff"))
    return g.select("row_id", "weighted_prediction", agree.alias("agreement"), cons.alias("consensus"), div.alias("diversity"),
                    ((agree + cons + div) / 3).alias("combined"), "prediction_variance")


def calibration_curve(preds: DataFrame, bins: int = 10) -> DataFrame:
    """Mean probability and observed rate per right-closed uniform bin; empty bins are left out."""
    b = F.greatest(F.ceil(F.col("proba") * bins) - 1, F.lit(0)).alias("bin")
    return preds.groupBy("model", b).agg(F.count(F.lit(1)).alias("n"), F.avg("proba").alias("mean_proba"),
                                         F.avg(F.col("label").cast("double")).alias("observed"))


def calibration_error(preds: DataFrame, bins: int = 10) -> DataFrame:
    e = F.abs(F.col("observed") - F.col("mean_proba"))
    return calibration_curve(preds, bins).groupBy("model").agg(F.avg(e).alias("mean_error"), F.max(e).alias("max_error"))


def confidence_histogram(preds: DataFrame, conf: Column, bins: int = 30) -> DataFrame:
    """Counts per equal-width bin of [0, 1]."""
    b = F.least(F.greatest(F.floor(conf * bins), F.lit(0)), F.lit(bins - 1).cast("bigint")).alias("bin")
    return preds.groupBy("model", b).agg(F.count(F.lit(1)).alias("n"))


def confidence_center(preds: DataFrame, conf: Column, models: list[str]) -> DataFrame:
    """Mean and exact median confidence per model."""
    wide = preds.select(*[F.when(F.col("model") == m, conf).alias(m) for m in models])
    r = wide.agg(*[F.avg(m) for m in models]).first()
    q = exact_quantiles(wide, {m: (0.5,) for m in models})
    return params_frame(preds.sparkSession, [(m, r[i], q[m][0.5]) for i, m in enumerate(models)], "model string, mean double, median double")


def confident_summary(preds: DataFrame, level: float = 0.7) -> DataFrame:
    """Rows whose larger class probability reaches the level: count, ratio and statistics."""
    c = F.greatest(F.col("proba"), 1 - F.col("proba"))
    x = F.when(c >= level, c)
    return preds.groupBy("model").agg(F.count(x).alias("confident"), (F.count(x) / F.count(F.lit(1))).alias("ratio"), F.avg(x).alias("mean"),
                                      F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_pop(x).alias("std"))


def reliability(before: DataFrame, after: DataFrame) -> DataFrame:
    """|corr(confidence, |y - p|)| after calibration and the relative Brier gain, per model."""
    c = confidence(F.col("proba"))
    r = after.groupBy("model").agg(F.abs(F.corr(c, F.abs(F.col("label") - F.col("proba")))).alias("confidence_reliability"))
    b = probability_scores(before).select("model", F.col("brier").alias("b0"))
    a = probability_scores(after).select("model", F.col("brier").alias("b1"))
    return r.join(b, "model").join(a, "model").select(
        "model", "confidence_reliability", ((F.col("b0") - F.col("b1")) / F.col("b0")).alias("calibration_improvement"))


def compare_calibrators(scored: dict[str, DataFrame]) -> DataFrame:
    """Brier and log loss of each calibrated table; the lower Brier is chosen, ties to the first."""
    parts = None
    for k, (name, df) in enumerate(scored.items()):
        one = probability_scores(df).select("model", F.lit(name).alias("method"), F.lit(k).alias("_k"), "brier", "log_loss")
        parts = one if parts is None else parts.unionByName(one)
    w = Window.partitionBy("model").orderBy("brier", "_k")  # one row per method
    return parts.withColumn("chosen", F.row_number().over(w) == 1).drop("_k")


def monitor(log: DataFrame, order: list[str], window: int = 1000, limit: float = 0.05, min_outcomes: int = 100) -> DataFrame:
    """Drift of the mean confidence between the last two blocks of ``window`` rows, and the Brier score of the last.

    Only the newest 2 x window rows leave the tasks (a top-k per task, then a merge).
    """
    desc = [F.desc(c) for c in order]
    last = log.orderBy(*desc).limit(2 * window)
    b = last.withColumn("_r", F.row_number().over(Window.orderBy(*desc)))  # 2 x window rows
    recent = F.col("_r") <= window
    has = recent & F.col("outcome").isNotNull()
    err = (F.col("prediction") - F.col("outcome")) * (F.col("prediction") - F.col("outcome"))
    g = b.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(recent, F.col("confidence"))).alias("recent_mean"),
              F.avg(F.when(~recent, F.col("confidence"))).alias("previous_mean"), F.count_if(has).alias("outcomes"),
              F.avg(F.when(has, err)).alias("brier"), F.avg((F.when(recent, F.col("confidence")) < 0.5).cast("double")).alias("low_rate"))
    drift = F.abs(F.col("recent_mean") - F.col("previous_mean"))
    full = F.col("n") >= 2 * window
    return g.select("recent_mean", "previous_mean", F.when(full, drift).alias("drift"), F.coalesce(full & (drift > limit), F.lit(False)).alias("drifted"),
                    "outcomes", F.when(F.col("outcomes") >= min_outcomes, F.col("brier")).alias("brier"), (F.col("low_rate") > 0.15).alias("low_confidence_alert"))
