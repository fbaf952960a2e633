"""Queries: metrics, confidence, ensembles, run tables on the deterministic prediction table."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from lendframe.operators import confidence as conf
from lendframe.operators import ensemble, metrics, runs
from lendframe.plans.catalog_eda import rnd
from lendframe.plans.predictions import MODELS
from lendframe.plans.registry import query

_C = ("sum(case when label = 1 and pred = 1 then 1e0 else 0e0 end) AS tp, sum(case when label = 0 and pred = 1 then 1e0 else 0e0 end) AS fp, "
      "sum(case when label = 0 and pred = 0 then 1e0 else 0e0 end) AS tn, sum(case when label = 1 and pred = 0 then 1e0 else 0e0 end) AS fn")


def dv(a, b):
    return f"coalesce(({a}) / nullif({b}, 0), 0e0)"


_X1 = {"accuracy": "(tp + tn) / n", "balanced_accuracy": f"({dv('tp', 'tp + fn')} + {dv('tn', 'tn + fp')}) / 2", "precision": dv("tp", "tp + fp"), "recall": dv("tp", "tp + fn"),
       "f1": dv("2 * tp", "2 * tp + fp + fn"), "mcc": dv("tp * tn - fp * fn", "sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))"),
       "kappa": dv("(tp + tn) / n - e", "1 - e"), "specificity": dv("tn", "tn + fp"), "fpr": dv("fp", "fp + tn"), "fnr": dv("fn", "fn + tp"), "ppv": dv("tp", "tp + fp"), "npv": dv("tn", "tn + fn"),
       "lr_positive": f"{dv('tp', 'tp + fn')} / nullif({dv('fp', 'fp + tn')}, 0)", "lr_negative": f"(1 - {dv('tp', 'tp + fn')}) / nullif({dv('tn', 'tn + fp')}, 0)"}


def _x1(counts: str) -> str:
    return (f"SELECT model, round(tp, 4) AS tp, round(fp, 4) AS fp, round(tn, 4) AS tn, round(fn, 4) AS fn, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in _X1.items())
            + f" FROM (SELECT *, tp + fp + tn + fn AS n, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + fp + tn + fn) * (tp + fp + tn + fn)) AS e FROM ({counts}))")


def _metrics(df):
    return rnd(rnd(df, 4, "tp", "fp", "tn", "fn"), 6, *_X1)


@query("x1_classification", _x1(f"SELECT model, {_C} FROM preds GROUP BY model"), preds=True)
def _(t):
    return _metrics(metrics.classification_metrics(t.preds))


@query("x1_weighted", _x1(f"SELECT model, {_C.replace('then 1e0', 'then cast(loan_term_months as double)')} FROM preds JOIN (SELECT application_id, loan_term_months FROM lab) ON application_id = row_id GROUP BY model"), preds=True)
def _(t):
    terms = t.lab.select(F.col("application_id").alias("row_id"), "loan_term_months")
    return _metrics(metrics.classification_metrics(t.preds.join(terms, "row_id"), weight="loan_term_months"))


_REP = ("(SELECT model, c AS label, count(case when label = c then 1 end) AS support, coalesce(count(case when label = c and pred = c then 1 end) * 1e0 / nullif(count(case when pred = c then 1 end), 0), 0e0) AS precision, "
        "coalesce(count(case when label = c and pred = c then 1 end) * 1e0 / nullif(count(case when label = c then 1 end), 0), 0e0) AS recall, "
        "coalesce(2e0 * count(case when label = c and pred = c then 1 end) / nullif(count(case when label = c then 1 end) + count(case when pred = c then 1 end), 0), 0e0) AS f1 FROM preds, (SELECT 0 AS c UNION ALL SELECT 1) GROUP BY model, c)")


@query("x2_weighted_averages", f"SELECT model, round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall, "
       f"round(sum(f1 * support) / sum(support), 6) AS weighted_f1, sum(support) AS support FROM {_REP} GROUP BY model", preds=True)
def _(t):
    return rnd(metrics.weighted_averages(t.preds), 6)


_AUC = ("SELECT {by}, coalesce(sum(pos * (cn - neg / 2e0)) / nullif(max(pt) * 1e0 * max(nt), 0), 0e0) AS auc, coalesce(sum(case when pos > 0 then pos * ((pt - cp + pos) * 1e0 / (pt - cp + pos + nt - cn + neg)) else 0e0 end) / nullif(max(pt), 0), 0e0) AS average_precision FROM "
        "(SELECT *, sum(pos) OVER (PARTITION BY {by} ORDER BY proba) AS cp, sum(neg) OVER (PARTITION BY {by} ORDER BY proba) AS cn, sum(pos) OVER (PARTITION BY {by}) AS pt, sum(neg) OVER (PARTITION BY {by}) AS nt FROM "
        "(SELECT {by}, proba, sum(label) AS pos, sum(1 - label) AS neg FROM {src} GROUP BY {by}, proba)) GROUP BY {by}")


@query("x3_roc_auc", "SELECT model, round(auc, 6) AS auc FROM (" + _AUC.format(by="model", src="preds") + ")", preds=True)
def _(t):
    return rnd(metrics.rank_metrics(t.preds).select("model", "auc"), 6)


@query("x4_average_precision", "SELECT model, round(average_precision, 6) AS average_precision FROM (" + _AUC.format(by="model", src="preds") + ")", preds=True)
def _(t):
    return rnd(metrics.rank_metrics(t.preds).select("model", "average_precision"), 6)


_CLIP = "least(greatest(proba, 1e-15), 1e0 - 1e-15)"
_PS = f"avg((proba - label) * (proba - label)) AS brier, avg(case when label = 1 then -ln({_CLIP}) else -ln(1e0 - {_CLIP}) end) AS log_loss"


@query("x5_probability_scores", f"SELECT model, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss FROM (SELECT model, {_PS} FROM preds GROUP BY model)", preds=True)
def _(t):
    return rnd(metrics.probability_scores(t.preds), 6)


_M = ("sum(case when pred = 1 and label = 1 then loan_amount else 0e0 end) AS tp, sum(case when pred = 1 and label = 0 then loan_amount else 0e0 end) AS fp, "
      "sum(case when pred = 0 and label = 1 then loan_amount else 0e0 end) AS fn, sum(case when label = 1 then loan_amount else 0e0 end) AS total, count(*) AS n, avg(loan_amount) AS amt, sum(pred) AS appr")
_X6 = {"net_business_value": ("tp * 0.045e0 - fp * 0.7e0 - n * 100e0", 2), "revenue_from_approved": ("tp * 0.045e0", 2), "losses_from_defaults": ("fp * 0.7e0", 2), "opportunity_cost": ("fn * 0.045e0", 2),
       "processing_costs": ("n * 100e0", 2), "approved_portfolio_value": ("tp + fp", 2), "expected_portfolio_value": ("tp + fn", 2), "portfolio_efficiency": (dv("tp + fp", "tp + fn"), 6),
       "average_loan_amount": ("amt", 4), "approval_rate": ("appr * 1e0 / n", 6), "precision_weighted_value": (dv("tp * 0.045e0", "tp * 0.045e0 + fp * 0.7e0"), 6)}


@query("x6_business_impact", "SELECT model, appr AS approved_applications, " + ", ".join(f"round({e}, {d}) AS {k}" for k, (e, d) in _X6.items()) + f" FROM (SELECT model, {_M} FROM preds GROUP BY model)", preds=True)
def _(t):
    df = metrics.business_impact(t.preds)
    for k, (_e, d) in _X6.items():
        df = rnd(df, d, k)
    return df


@query("x7_fold_business", "SELECT model, round(tp * 0.05e0, 2) AS potential_revenue, round(fp * 0.3e0, 2) AS potential_losses, round(fn * 0.05e0, 2) AS opportunity_cost, round(tp * 0.05e0 - fp * 0.3e0, 2) AS net_business_impact, "
       f"round({dv('tp * 0.05e0', 'total * 0.05e0')}, 6) AS revenue_efficiency, round({dv('tp * 0.05e0 - fp * 0.3e0', 'tp * 0.05e0 + fp * 0.3e0')}, 6) AS risk_adjusted_return FROM (SELECT model, {_M} FROM preds GROUP BY model)", preds=True)
def _(t):
    df = rnd(metrics.fold_business(t.preds), 2, "potential_revenue", "potential_losses", "opportunity_cost", "net_business_impact")
    return rnd(df, 6, "revenue_efficiency", "risk_adjusted_return")


_ATTR = "(SELECT model, label, pred, proba, 'gender' AS attribute, gender AS grp FROM preds UNION ALL SELECT model, label, pred, proba, 'area_type', area_type FROM preds)"
_GRP = f"(SELECT model, attribute, grp, count(*) AS n, {_C} FROM {_ATTR} GROUP BY model, attribute, grp)"


@query("x8_group_metrics", f"SELECT g.model, g.attribute, g.grp, n AS sample_size, round((tp + tn) / n, 6) AS accuracy, round({dv('tp', 'tp + fp')}, 6) AS precision, round({dv('tp', 'tp + fn')}, 6) AS recall, round((tp + fp) / n, 6) AS approval_rate, "
       f"round((tp + fn) / n, 6) AS base_rate, round(auc, 6) AS auc FROM {_GRP} g JOIN ({_AUC.format(by='model, attribute, grp', src=_ATTR)}) a ON g.model = a.model AND g.attribute = a.attribute AND g.grp = a.grp", preds=True)
def _(t):
    return rnd(metrics.group_metrics(t.preds, ["gender", "area_type"]), 6)


@query("x8_fairness", f"WITH f AS (SELECT model, attribute, count(*) AS groups, max((tp + fp) / n) - min((tp + fp) / n) AS dp, min((tp + fp) / n) / max((tp + fp) / n) AS dr, max({dv('tp', 'tp + fn')}) - min({dv('tp', 'tp + fn')}) AS eo, "
       f"max((tp + tn) / n) - min((tp + tn) / n) AS ap FROM {_GRP} GROUP BY model, attribute) SELECT model, attribute, groups, round(dp, 6) AS demographic_parity_diff, round(dr, 6) AS demographic_parity_ratio, "
       "round(eo, 6) AS equal_opportunity_diff, round(ap, 6) AS accuracy_parity_diff, round(max(greatest(dp, eo, ap)) OVER (PARTITION BY model), 6) AS overall_fairness_score FROM f", preds=True)
def _(t):
    return rnd(metrics.fairness(t.preds, ["gender", "area_type"]), 6)


@query("x9_class_report", f"SELECT model, label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {_REP}", preds=True)
def _(t):
    return rnd(metrics.class_report(t.preds), 6)


# --- K ------------------------------------------------------------------------------------------

_ENT = "1e0 + (1e0 - proba) * log2(1e0 - proba + 1e-8) + proba * log2(proba + 1e-8)"


@query("k3_calibrator_choice", f"WITH s AS (SELECT model, 'raw' AS method, 0 AS k, {_PS} FROM preds GROUP BY model UNION ALL SELECT model, 'shrunk', 1, {_PS} FROM (SELECT model, label, 0.25e0 + proba * 0.7e0 AS proba FROM preds) GROUP BY model) "
       "SELECT model, method, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, row_number() OVER (PARTITION BY model ORDER BY brier, k) = 1 AS chosen FROM s", preds=True)
def _(t):
    p = t.preds
    return rnd(conf.compare_calibrators({"raw": p, "shrunk": p.withColumn("proba", 0.25 + F.col("proba") * 0.7)}), 6)


@query("k4_confidence", f"SELECT row_id, model, round({_ENT}, 6) AS entropy, greatest(proba, 1e0 - proba) AS max_prob, round(abs(2e0 * proba - 1e0), 6) AS margin FROM preds", preds=True)
def _(t):
    p = F.col("proba")
    return t.preds.select("row_id", "model", F.round(conf.confidence(p), 6).alias("entropy"), conf.confidence(p, "max_prob").alias("max_prob"),
                          F.round(conf.confidence(p, "margin"), 6).alias("margin"))


@query("k4_variance_confidence", "SELECT row_id, round(1e0 / (1e0 + var_pop(proba)), 6) AS confidence FROM preds GROUP BY row_id", preds=True)
def _(t):
    return rnd(conf.variance_confidence(t.preds), 6)


_U = "(SELECT row_id, label, avg(proba) AS m, stddev_pop(proba) AS s FROM preds GROUP BY row_id, label)"


@query("k5_uncertainty", f"SELECT row_id, label, round(m, 6) AS mean_prediction, round(s, 6) AS epistemic, round(m * (1 - m), 6) AS aleatoric, round(s + m * (1 - m), 6) AS total, round(s * s, 6) AS variance FROM {_U}", preds=True)
def _(t):
    return rnd(conf.uncertainty(t.preds), 6)


@query("k5_uncertainty_error", f"SELECT round(corr(s + m * (1 - m), abs(label - m)), 6) AS r FROM {_U}", preds=True)
def _(t):
    return rnd(conf.uncertainty_error_correlation(conf.uncertainty(t.preds)), 6)


def _sweep(ts: tuple) -> str:
    return ("SELECT model, t AS threshold, n * 1e0 / total AS coverage, case when n > 0 then ok * 1e0 / n end AS accuracy, case when n > 0 then coalesce(tp * 1e0 / nullif(tp + fp, 0), 0e0) end AS precision, "
            "case when n > 0 then coalesce(tp * 1e0 / nullif(tp + fn, 0), 0e0) end AS recall, case when n > 0 then coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0) end AS f1 FROM "
            "(SELECT model, t, count(*) AS total, count(case when c >= t then 1 end) AS n, count(case when c >= t and label = p then 1 end) AS ok, count(case when c >= t and label = 1 and p = 1 then 1 end) AS tp, "
            "count(case when c >= t and label = 0 and p = 1 then 1 end) AS fp, count(case when c >= t and label = 1 and p = 0 then 1 end) AS fn FROM "
            f"(SELECT model, label, {_ENT} AS c, case when proba > 0.5e0 then 1 else 0 end AS p FROM preds), (SELECT cast(unnest([{', '.join(map(str, ts))}]) as double) AS t) GROUP BY model, t)")


@query("k6_threshold_sweep", "SELECT model, threshold, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (" + _sweep(conf.THRESHOLDS) + ")", preds=True)
def _(t):
    return rnd(conf.threshold_sweep(t.preds, conf.confidence(F.col("proba"))), 6)


_ORDERED = "list(proba ORDER BY model)"


@query("k7_ensemble_confidence", "SELECT row_id, round(w, 6) AS weighted_prediction, round(1 - sqrt(v) / 0.5e0, 6) AS agreement, round(abs(2 * w - 1), 6) AS consensus, round(1 / (1 + d), 6) AS diversity, "
       "round(((1 - sqrt(v) / 0.5e0) + abs(2 * w - 1) + 1 / (1 + d)) / 3, 6) AS combined, round(v, 6) AS prediction_variance FROM "
       "(SELECT row_id, 0.5e0 * p_credit + 0.3e0 * p_debt + 0.2e0 * p_income AS w, (abs(p_credit - p_debt) + abs(p_credit - p_income) + abs(p_debt - p_income)) / 3 AS d, "
       "list_aggregate([p_credit, p_debt, p_income], 'var_pop') AS v FROM wide)", preds=True)
def _(t):
    return rnd(conf.ensemble_confidence(t.preds, {"credit": 0.5, "debt": 0.3, "income": 0.2}), 6)


_BIN = "cast(greatest(ceil(proba * 10) - 1, 0) as bigint)"
_CAL = f"(SELECT model, {_BIN} AS bin, count(*) AS n, avg(proba) AS mp, avg(label) AS ob FROM preds GROUP BY ALL)"


@query("k8_calibration_curve", f"SELECT model, bin, n, round(mp, 6) AS mean_proba, round(ob, 6) AS observed FROM {_CAL}", preds=True)
def _(t):
    return rnd(conf.calibration_curve(t.preds), 6)


@query("k8_calibration_error", f"SELECT model, round(avg(abs(mp - ob)), 6) AS mean_error, round(max(abs(mp - ob)), 6) AS max_error FROM {_CAL} GROUP BY model", preds=True)
def _(t):
    return rnd(conf.calibration_error(t.preds), 6)


@query("k9_confidence_histogram", "SELECT model, cast(least(greatest(floor(greatest(proba, 1e0 - proba) * 30), 0), 29) as bigint) AS bin, count(*) AS n FROM preds GROUP BY ALL", preds=True)
def _(t):
    return conf.confidence_histogram(t.preds, conf.confidence(F.col("proba"), "max_prob"))


@query("k9_confidence_center", "SELECT model, round(avg(greatest(proba, 1e0 - proba)), 6) AS mean, round(median(greatest(proba, 1e0 - proba)), 6) AS median FROM preds GROUP BY model", preds=True)
def _(t):
    return rnd(conf.confidence_center(t.preds, conf.confidence(F.col("proba"), "max_prob"), MODELS), 6)


@query("k10_confidence_bands", "SELECT model, case when c >= 0.9e0 then 'very_high' when c >= 0.7e0 then 'high' when c >= 0.5e0 then 'medium' when c >= 0.3e0 then 'low' when c >= 0 then 'very_low' end AS band, count(*) AS n FROM "
       "(SELECT model, abs(2e0 * proba - 1e0) AS c FROM preds) GROUP BY ALL", preds=True)
def _(t):
    return t.preds.groupBy("model", conf.band(conf.confidence(F.col("proba"), "margin")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


_LOG = "SELECT ts, event_id, least(value / 50e0, 1e0) AS prediction, abs(2e0 * least(value / 50e0, 1e0) - 1e0) AS confidence, case event_type when 'purchase' then 1 when 'error' then 0 when 'view' then 0 end AS outcome FROM events"


@query("k11_monitor", f"WITH b AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM ({_LOG})), a AS (SELECT avg(case when r <= 1000 then confidence end) AS rm, avg(case when r > 1000 and r <= 2000 then confidence end) AS pm, "
       "count(case when r <= 1000 then outcome end) AS k, avg(case when r <= 1000 then (prediction - outcome) * (prediction - outcome) end) AS br, avg(case when r <= 1000 then case when confidence < 0.5e0 then 1e0 else 0e0 end end) AS lo FROM b) "
       "SELECT round(rm, 6) AS recent_mean, round(pm, 6) AS previous_mean, round(abs(rm - pm), 6) AS drift, abs(rm - pm) > 0.05e0 AS drifted, k AS outcomes, round(case when k >= 100 then br end, 6) AS brier, lo > 0.15e0 AS low_confidence_alert FROM a", loans=False)
def _(t):
    t.events.createOrReplaceTempView("events")
    return rnd(conf.monitor(t.spark.sql(_LOG), ["ts", "event_id"]), 6)


_GRID = tuple(round(0.1 + 0.05 * k, 2) for k in range(18))


@query("k12_best_threshold", f"SELECT model, threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS r FROM ({_sweep(_GRID)}) WHERE f1 IS NOT NULL) WHERE r = 1", preds=True)
def _(t):
    return rnd(conf.best_threshold(conf.threshold_sweep(t.preds, conf.confidence(F.col("proba")), _GRID)), 6, "f1")


@query("k13_reliability", "WITH a AS (SELECT model, label, 0.25e0 + proba * 0.7e0 AS proba FROM preds), b0 AS (SELECT model, avg((proba - label) * (proba - label)) AS b FROM preds GROUP BY model) "
       f"SELECT a.model, round(abs(corr({_ENT}, abs(label - proba))), 6) AS confidence_reliability, round((min(b) - avg((proba - label) * (proba - label))) / min(b), 6) AS calibration_improvement FROM a JOIN b0 ON a.model = b0.model GROUP BY a.model", preds=True)
def _(t):
    p = t.preds
    return rnd(conf.reliability(p, p.withColumn("proba", 0.25 + F.col("proba") * 0.7)), 6)


@query("l12_confident_summary", "SELECT model, count(x) AS confident, round(count(x) * 1e0 / count(*), 6) AS ratio, round(avg(x), 6) AS mean, round(min(x), 6) AS min, round(max(x), 6) AS max, round(stddev_pop(x), 6) AS std FROM "
       "(SELECT model, case when greatest(proba, 1e0 - proba) >= 0.7e0 then greatest(proba, 1e0 - proba) end AS x FROM preds) GROUP BY model", preds=True)
def _(t):
    return rnd(conf.confident_summary(t.preds), 6)


# --- G ------------------------------------------------------------------------------------------

@query("g1_soft_vote", "SELECT row_id, label, round((p_credit + p_debt + p_income) / 3, 6) AS proba, cast(case when (p_credit + p_debt + p_income) / 3 >= 0.5e0 then 1 else 0 end as int) AS pred FROM wide", preds=True)
def _(t):
    return rnd(ensemble.soft_vote(t.preds), 6)


_HARD = "(SELECT row_id, label, case when sum(pred) >= 2 then 1 else 0 end AS pred, greatest(sum(pred), 3 - sum(pred)) * 1e0 AS votes FROM preds GROUP BY row_id, label)"


@query("g2_hard_vote", f"SELECT row_id, label, pred, votes FROM {_HARD}", preds=True)
def _(t):
    return ensemble.hard_vote(t.preds)


@query("g2_hard_vote_ties", "SELECT row_id, label, case when sum(pred) = 2 then 1 else 0 end AS pred, greatest(sum(pred), 2 - sum(pred)) * 1e0 AS votes FROM preds WHERE model <> 'income' GROUP BY row_id, label", preds=True)
def _(t):
    return ensemble.hard_vote(t.preds.where("model <> 'income'"))


_W = {"credit": 0.5, "debt": 0.2, "income": 0.3}


@query("g3_weighted_vote", "SELECT row_id, label, case when s > 0.5e0 + 1e-9 then 1 else 0 end AS pred, round(greatest(s, 1 - s), 6) AS votes FROM (SELECT row_id, label, sum(pred * case model when 'credit' then 0.5e0 when 'debt' then 0.2e0 else 0.3e0 end) AS s FROM preds GROUP BY row_id, label)", preds=True)
def _(t):
    v = ensemble.hard_vote(t.preds, _W)
    return rnd(v, 6)


@query("g3_weighted_mean", "SELECT row_id, label, round(0.5e0 * p_credit + 0.2e0 * p_debt + 0.3e0 * p_income, 6) AS proba FROM wide", preds=True)
def _(t):
    return rnd(ensemble.soft_vote(t.preds, _W), 6).drop("pred")


_LV = [0.1 + 0.9 * k / 4 for k in range(5)]
_GW = [(i, a / (a + b + c), b / (a + b + c), c / (a + b + c)) for i, (a, b, c) in enumerate(itertools.product(_LV, repeat=3))]


@query("g6_weight_search", "WITH w AS (SELECT row_id, label, max(case when model = 'credit' then pred end) AS a, max(case when model = 'debt' then pred end) AS b, max(case when model = 'income' then pred end) AS c FROM preds GROUP BY row_id, label), "
       "g(grid_id, w_credit, w_debt, w_income) AS (VALUES " + ", ".join(f"({i}, {a!r}::double, {b!r}::double, {c!r}::double)" for i, a, b, c in _GW) + ") "
       "SELECT grid_id, round(w_credit, 6) AS w_credit, round(w_debt, 6) AS w_debt, round(w_income, 6) AS w_income, round(avg(case when case when abs(2 * (a * w_credit + b * w_debt + c * w_income) - 1) < 1e-12 then a when a * w_credit + b * w_debt + c * w_income > 0.5e0 then 1 else 0 end = label then 1e0 else 0e0 end), 6) AS accuracy "
       "FROM w, g GROUP BY ALL", preds=True)
def _(t):
    return rnd(ensemble.search_weights(t.preds, MODELS), 6)


@query("g7_choose_models", "SELECT model, round(accuracy, 6) AS accuracy FROM (SELECT model, avg(case when label = pred then 1e0 else 0e0 end) AS accuracy FROM preds GROUP BY model) ORDER BY accuracy DESC LIMIT 2", preds=True)
def _(t):
    board = metrics.classification_metrics(t.preds).select("model", "accuracy")
    return rnd(ensemble.choose_models(board, 0.99, top=2), 6)


@query("g8_contributions", f"SELECT model, round(avg(case when p.pred = p.label then 1e0 else 0e0 end), 6) AS individual_accuracy, round(avg(case when e.pred = p.label then 1e0 else 0e0 end) - avg(case when p.pred = p.label then 1e0 else 0e0 end), 6) AS improvement_from_ensemble, "
       f"round(avg(case when p.pred = e.pred then 1e0 else 0e0 end), 6) AS agreement_with_ensemble, count(case when p.pred = p.label and e.pred <> p.label then 1 end) AS unique_correct FROM preds p JOIN {_HARD} e ON p.row_id = e.row_id GROUP BY model", preds=True)
def _(t):
    return rnd(ensemble.contributions(t.preds, ensemble.hard_vote(t.preds)), 6)


_PW = [("a", "b"), ("a", "c"), ("b", "c")]


def _q(x, y):
    n = lambda p, q: f"(sum(case when {x} {p} label and {y} {q} label then 1e0 else 0e0 end))"
    return f"({n('=', '=')} * {n('<>', '<>')} - {n('=', '<>')} * {n('<>', '=')}) / nullif({n('=', '=')} * {n('<>', '<>')} + {n('=', '<>')} * {n('<>', '=')}, 0)"


@query("g9_diversity", "WITH w AS (SELECT row_id, label, max(case when model = 'credit' then pred end) AS a, max(case when model = 'debt' then pred end) AS b, max(case when model = 'income' then pred end) AS c FROM preds GROUP BY row_id, label), "
       "x AS (SELECT *, (a + b + c) / 3e0 AS p FROM w) SELECT round((" + " + ".join(f"avg(case when {x} <> {y} then 1e0 else 0e0 end)" for x, y in _PW) + ") / 3, 6) AS pairwise_disagreement, "
       "round(list_avg([" + ", ".join(_q(x, y) for x, y in _PW) + "]), 6) AS q_statistic, round(avg(case when p > 0 then -p * log2(p) else 0e0 end + case when p < 1 then -(1 - p) * log2(1 - p) else 0e0 end), 6) AS vote_entropy FROM x", preds=True)
def _(t):
    return rnd(ensemble.diversity(t.preds, MODELS), 6)


# --- U: run tables derived from the event log ---------------------------------------------------

_RUNS = ("SELECT event_id AS run_id, event_type AS model_name, ts AS created_at, 1e0 - value / 500e0 AS accuracy, value * 2e0 AS duration, "
         "case user_id % 5 when 0 then 'production' when 1 then 'champion' when 2 then 'staging' else 'development' end AS stage, case event_id % 3 when 0 then 'archived' else 'active' end AS status, "
         "case user_id % 3 when 0 then 'forest' when 1 then 'boosted' else 'network' end AS model_type, value AS size_mb FROM events")


def _runs(t):
    t.events.createOrReplaceTempView("events")
    return t.spark.sql(_RUNS)


@query("u1_leaderboard", f"SELECT run_id, model_name, round(accuracy, 9) AS accuracy, row_number() OVER (ORDER BY accuracy DESC, run_id) AS rank, row_number() OVER (ORDER BY accuracy DESC, run_id) = 1 AS is_best, duration = min(duration) OVER () AS is_fastest, accuracy >= 0.9e0 AS meets_target FROM ({_RUNS})", loans=False)
def _(t):
    return rnd(runs.leaderboard(_runs(t)).select("run_id", "model_name", "accuracy", "rank", "is_best", "is_fastest", "meets_target"), 9)


@query("u2_list_runs", f"SELECT run_id, model_name, created_at FROM ({_RUNS}) WHERE stage = 'production' AND status = 'active'", loans=False)
def _(t):
    return runs.list_runs(_runs(t), stage="production", status="active").select("run_id", "model_name", "created_at")


_MAPPED = f"SELECT run_id, model_name, accuracy, duration, run_id % 4 AS has FROM ({_RUNS})"


def _mapped(t):
    return _runs(t).selectExpr("run_id", "model_name", "if(run_id % 4 = 0, map('accuracy', accuracy), map('accuracy', accuracy, 'duration', duration)) AS metrics")


@query("u3_compare_runs", f"SELECT run_id, model_name, accuracy, case when has = 0 then 0e0 else duration end AS duration FROM ({_MAPPED}) WHERE run_id IN (1, 4, 7, 100)", loans=False)
def _(t):
    return runs.compare_runs(_mapped(t), [1, 4, 7, 100], ["accuracy", "duration"])


@query("u4_retention", f"SELECT run_id, model_name, stage FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY created_at DESC, run_id DESC) AS r FROM ({_RUNS})) WHERE r > 10 AND stage NOT IN ('production', 'champion')", loans=False)
def _(t):
    return runs.retention(_runs(t)).select("run_id", "model_name", "stage")


@query("u6_registry_stats", f"SELECT kind, value, runs, round(size_mb, 4) AS size_mb FROM (SELECT 'status' AS kind, status AS value, count(*) AS runs, sum(size_mb) AS size_mb FROM ({_RUNS}) GROUP BY status UNION ALL "
       f"SELECT 'stage', stage, count(*), sum(size_mb) FROM ({_RUNS}) GROUP BY stage UNION ALL SELECT 'model_type', model_type, count(*), sum(size_mb) FROM ({_RUNS}) GROUP BY model_type UNION ALL SELECT 'total', 'all', count(*), sum(size_mb) FROM ({_RUNS}))", loans=False)
def _(t):
    return rnd(runs.registry_stats(_runs(t)), 4)


@query("u7_flatten_history", f"SELECT run_id, model_name, accuracy, case when has <> 0 then duration end AS duration FROM ({_MAPPED})", loans=False)
def _(t):
    return runs.flatten_history(_mapped(t), ["accuracy", "duration"])


_STEPS = "SELECT user_id AS session_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events"


def _log(t):
    return runs.number_steps(t.events.select(F.col("user_id").alias("session_id"), "event_id", "ts", "value"), "event_id")


@query("u8_recent_mean", f"SELECT session_id, round(avg(value), 6) AS recent_mean, count(*) AS steps FROM (SELECT *, max(step) OVER (PARTITION BY session_id) AS n FROM ({_STEPS})) WHERE step > n - 10 GROUP BY session_id", loans=False)
def _(t):
    return rnd(runs.last_steps_mean(_log(t)), 6)


@query("u8_session_summary", f"SELECT session_id, count(*) AS steps, min(ts) AS started, max(ts) AS ended, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us, arg_max(value, step) AS latest_value, round(avg(value), 6) AS mean_value FROM ({_STEPS}) GROUP BY session_id", loans=False)
def _(t):
    return rnd(runs.session_summary(_log(t)), 6, "mean_value")


@query("u9_early_stopping", f"WITH RECURSIVE s AS ({_STEPS}), r(session_id, step, best, at_step, wait, stop) AS (SELECT session_id, step, value, step, 0, cast(null as bigint) FROM s WHERE step = 1 UNION ALL "
       "SELECT r.session_id, s.step, case when r.stop is null and s.value + 0.001e0 < r.best then s.value else r.best end, case when r.stop is null and s.value + 0.001e0 < r.best then s.step else r.at_step end, "
       "case when r.stop is null and s.value + 0.001e0 < r.best then 0 else r.wait + 1 end, case when r.stop is not null then r.stop when not s.value + 0.001e0 < r.best and r.wait + 1 >= 10 then s.step end "
       "FROM r JOIN s ON s.session_id = r.session_id AND s.step = r.step + 1) SELECT session_id, max(step) AS steps, max(stop) AS stop_step, arg_max(at_step, step) AS best_step, arg_max(best, step) AS best_value FROM r GROUP BY session_id", loans=False)
def _(t):
    return runs.early_stopping(_log(t), patience=10)


@query("u10_thin_steps", f"SELECT session_id, step, value FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM ({_STEPS})) WHERE n <= 50 OR (step - 1) % 10 = 0", loans=False)
def _(t):
    return runs.thin_steps(_log(t), above=50).select("session_id", "step", "value")


@query("u12_fingerprint", "SELECT count(*) AS rows, 5 AS columns, cast(sum(cast('0x' || substr(md5(concat_ws('|', cast(c_acctbal as varchar), cast(c_custkey as varchar), c_mktsegment, c_name, cast(c_nationkey as varchar))), 1, 8) as bigint)) as bigint) AS fingerprint FROM customer", loans=False)
def _(t):
    return runs.fingerprint(t.customer)


_TRIALS = "SELECT concat(event_type, '-', cast(user_id as varchar(10))) AS study, event_id AS trial, value, case event_id % 7 when 0 then 'pruned' when 1 then 'failed' else 'complete' end AS state FROM events"


@query("p11_trial_history", f"SELECT study, trial, value, state, max(value) OVER (PARTITION BY study ORDER BY trial) AS best_so_far FROM ({_TRIALS})", loans=False)
def _(t):
    t.events.createOrReplaceTempView("events")
    return runs.trial_history(t.spark.sql(_TRIALS))


@query("p11_trial_states", f"SELECT study, state, count(*) AS trials, max(value) AS best_value FROM ({_TRIALS}) GROUP BY study, state", loans=False)
def _(t):
    t.events.createOrReplaceTempView("events")
    return runs.trial_states(t.spark.sql(_TRIALS))


