"""Queries: model training, scoring, calibration, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendframe.operators import confidence as conf
from lendframe.functions import recipes
from lendframe.operators import forest, metrics, models as ml, scale, select
from lendframe.operators.split import stratified_split
from lendframe.operators.stats import params_frame
from lendframe.plans.catalog_eda import rnd
from lendframe.operators.store import Scorer
from lendframe.plans.predictions import MODELS, prediction_table
from lendframe.plans.preparation import Preparation, X
from lendframe.plans.registry import query
from lendframe.session import checkpoint, saved, scratch_path

Y = "loan_approved"


def _prepare(train, test):
    p = Preparation(train)
    return p(train), p(test)


def _data(t, split: bool = True):
    """Training and test rows, prepared by what the training rows show; with ``split=False`` the training rows only.

    The split rows are stored once, because the preparation alone reads the training rows several times.
    """
    s = checkpoint(stratified_split(t.lab.select(F.col("application_id").alias("row_id"), *X, Y), "row_id", Y, 0.2))
    tr, te = (ml.assemble(d, X, Y, keep=("row_id",)).select("row_id", Y, ml.FEATURES) for d in _prepare(
        s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")))
    return (checkpoint(tr), te) if split else tr


def _scored(t, fit, name):
    tr, te = _data(t)
    p = saved(ml.score(fit(tr), te, Y, name), "scores")
    return rnd(metrics.classification_metrics(p).join(metrics.rank_metrics(p), "model"), 6)


def _rf(d):
    return ml.fit_forest(d, Y)


def _gbt(d):
    return ml.fit_boosted(d, Y)


def _lr(d):
    return ml.fit_logistic(d, Y)


@query("l1_class_weights", "SELECT loan_approved, count(*) AS cnt, round((SELECT count(*) FROM lab) * 1e0 / (2 * count(*)), 6) AS weight FROM lab GROUP BY loan_approved")
def _(t):
    return rnd(ml.class_weights(t.lab, Y), 6)


@query("l1_forest")
def _(t):
    return _scored(t, _rf, "forest")


@query("l2_boosted")
def _(t):
    return _scored(t, lambda d: ml.fit_boosted(d.withColumn("is_val", F.pmod(F.xxhash64("row_id"), F.lit(10)) == 0), Y, val="is_val"), "boosted")


@query("l2_boosting_history")
def _(t):
    tr, te = _data(t)
    return rnd(ml.boosting_history(_gbt(tr), te), 6)


@query("l3_network")
def _(t):
    return _scored(t, lambda d: ml.fit_network(d, Y, len(X)), "network")


@query("l4_logistic")
def _(t):
    tr, te = _data(t)
    te, n, out = checkpoint(te), tr.count(), None  # three models read them
    for pen in ("l1", "l2", "elasticnet"):
        p = ml.score(ml.fit_logistic(tr, Y, penalty=pen, rows=n), te, Y, pen)
        out = p if out is None else out.unionByName(p)
    return rnd(metrics.rank_metrics(saved(out, "scores")), 6)


@query("l5_margin")
def _(t):
    return _scored(t, lambda d: ml.fit_margin(d, Y), "margin")


@query("l7_train")
def _(t):
    r = ml.train(t.lab.select("application_id", *X, Y), X, Y, "application_id", _rf, prepare=_prepare)
    return params_frame(t.spark, [(k, round(float(v), 6)) for k, v in r.metrics.items() if v is not None], "metric string, value double")


@query("l8_importance")
def _(t):
    tr, _te = _data(t)
    return rnd(ml.importance_table(t.spark, _rf(tr), X, 5), 6)


@query("l8_split_importance")
def _(t):
    tr, _te = _data(t)
    return rnd(ml.split_importance(t.spark, _gbt(tr), X), 6)


@query("l8_permutation_importance")
def _(t):
    tr, te = _data(t)
    return rnd(ml.permutation_importance(_rf(tr), te, Y, X), 6)


@query("l10_leaves")
def _(t):
    tr, te = _data(t)
    return ml.leaf_indices(_rf(tr), te)


_IMP = {"credit_score": 0.4, "debt_to_income_ratio": 0.25, "annual_income": 0.15, "loan_amount": 0.1, "age": 0.1}


@query("l11_explain", "SELECT application_id, cast(r as int) AS rank, feature, round(v, 6) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY abs(v) DESC, feature) AS r FROM ("
       + " UNION ALL ".join(f"SELECT application_id, '{c}' AS feature, cast({c} as double) * {w} AS v FROM lab WHERE {c} IS NOT NULL" for c, w in _IMP.items()) + ")) WHERE r <= 3")
def _(t):
    return rnd(ml.explain_rows(t.lab, list(_IMP), _IMP, "application_id", 3), 6)


@query("l13_decisions")
def _(t):
    tr, te = _data(t)
    return rnd(ml.decisions(_lr(tr), te, ("row_id",)), 6)


#: The scoring service's application fields, from a loan row.
_API_FIELDS = {"ApplicantIncome": "annual_income", "CoapplicantIncome": "coapplicant_income", "LoanAmount": "loan_amount",
               "Loan_Amount_Term": "cast(loan_term_months as double)", "Credit_History": "if(previous_loan_defaults = 0, 1D, 0D)",
               "Education": "if(education in ('Advanced', 'Bachelor\\'s'), 'Graduate', 'Not Graduate')",
               "Dependents": "if(previous_loans > 2, '3+', cast(previous_loans as string))", "Self_Employed": "if(employment_status like 'Self-%', 'Yes', 'No')",
               "Married": "if(marital_status = 'Married', 'Yes', 'No')", "Property_Area": "if(area_type = 'Suburban', 'Semiurban', area_type)"}


@query("l13_api_decisions")
def _(t):
    """A model on the scoring service's fifteen features decides every application of the table."""
    fields = t.lab.select(F.col("application_id").alias("row_id"), Y, *[F.expr(e).alias(k) for k, e in _API_FIELDS.items()])
    x = recipes.api_features(fields, ("row_id", Y))
    names = list(recipes.API_FEATURES)
    train = stratified_split(x, "row_id", Y, 0.2).where("split = 'train'").drop("split")
    sc = scale.fit_scaler(train, names)
    model = _lr(checkpoint(ml.assemble(scale.apply_scaler(train, sc), names, Y, keep=("row_id",))))
    return rnd(ml.decisions(model, ml.assemble(scale.apply_scaler(x, sc), names, Y, keep=("row_id",)), ("row_id",)), 6)


@query("l14_saved_scorer")
def _(t):
    """Fit, save, load, and score the raw test rows with what was loaded."""
    s = stratified_split(t.lab.select(F.col("application_id").alias("row_id"), *X, Y), "row_id", Y, 0.2)
    train, test = (s.where(F.col("split") == part).drop("split") for part in ("train", "test"))
    p = Preparation(train)
    path = scratch_path(t.spark, "scorer")
    Scorer(p, _lr(checkpoint(ml.assemble(p(train), X, Y, keep=("row_id",)))), X, Y).save(t.spark, path)
    return rnd(Scorer.load(t.spark, path).decisions(test), 6)


@query("p8_cross_validation")
def _(t):
    return rnd(ml.cv_report(ml.fold_scores(ml.cross_validate(_data(t, False), Y, _lr, name="logistic"))), 6)


@query("p8_fold_report", "SELECT model, metric, 'test' AS part, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(max(v) - min(v), 6) AS range FROM "
       "(SELECT model, row_id % 5 AS fold, 'accuracy' AS metric, avg(case when label = pred then 1e0 else 0e0 end) AS v FROM preds GROUP BY ALL UNION ALL "
       "SELECT model, row_id % 5, 'f1', 2e0 * sum(label * pred) / (sum(label) + sum(pred)) FROM preds GROUP BY ALL) GROUP BY model, metric", preds=True)
def _(t):
    cv = t.preds.withColumn("fold", (F.col("row_id") % 5).cast("int")).withColumn("part", F.lit("test"))
    s = metrics.classification_metrics(cv, ["model", "fold", "part"])
    return rnd(ml.cv_report(s, ("accuracy", "f1")), 6)


@query("p9_compare_models")
def _(t):
    return rnd(ml.compare_models(_data(t, False), Y, {"logistic": _lr, "forest": _rf}), 6)


@query("p10_search")
def _(t):
    return rnd(ml.search(_data(t, False), Y, lambda depth, trees: (lambda d: ml.fit_forest(d, Y, trees=trees, depth=depth)),
                         {"depth": [5, 10], "trees": [50, 100]}), 6)


@query("p10_random_refit")
def _(t):
    """Random search over twelve settings, the best one refitted and scored on the test rows."""
    tr, te = _data(t)
    _, model = ml.refit_best(tr, Y, lambda c, penalty: (lambda d: ml.fit_logistic(d, Y, c=c, penalty=penalty)),
                             {"c": [0.01, 0.1, 1.0, 10.0], "penalty": ["l1", "l2", "elasticnet"]}, n_iter=5)
    p = saved(ml.score(model, te, Y, "best"), "scores")
    return rnd(metrics.classification_metrics(p).join(metrics.rank_metrics(p), "model"), 6)


@query("g4_stacking")
def _(t):
    tr, te = _data(t)
    p = saved(ml.stack(tr, te, Y, {"logistic": _lr, "forest": _rf}), "scores")
    return rnd(metrics.classification_metrics(p).join(metrics.rank_metrics(p), "model"), 6)


@query("g5_blending")
def _(t):
    tr, te = _data(t)
    p, _w = ml.blend(tr, te, Y, {"logistic": _lr, "forest": _rf})
    p = saved(p.withColumn("model", F.lit("blend")), "scores")
    return rnd(metrics.classification_metrics(p).join(metrics.rank_metrics(p), "model"), 6)


def _by_model(t, fn):
    """One result per model of the prediction table."""
    out = None
    for m in MODELS:
        r = fn(prediction_table(t.lab).where(F.col("model") == m))
        out = r if out is None else out.unionByName(r)
    return out


@query("k1_platt")
def _(t):
    return rnd(metrics.probability_scores(_by_model(t, lambda p: ml.apply_platt(p, ml.fit_platt(p)))), 6)


@query("k2_isotonic")
def _(t):
    def calibrated(p):
        iso = ml.apply_isotonic(p, ml.fit_isotonic(p))
        return conf.compare_calibrators({"raw": p, "platt": ml.apply_platt(p, ml.fit_platt(p)), "isotonic": iso})
    return rnd(_by_model(t, calibrated), 6)


def _prepared(t):
    """All 28 prepared inputs of all rows."""
    lab = t.lab
    return checkpoint(Preparation(lab)(t.dealt(lab)).select(*X, Y))


@query("r7_recursive_elimination")
def _(t):
    return params_frame(t.spark, select.recursive_elimination(_prepared(t), X, Y, keep=14, step=5), "feature string, rank int")


@query("r8_from_importance")
def _(t):
    return params_frame(t.spark, [(c,) for c in select.from_importance(_prepared(t), X, Y)], "feature string")


_PC = ["credit_score", "debt_to_income_ratio", "loan_amount", "age"]


@query("r9_pca_variance", "SELECT round(sum(v), 4) AS total_variance FROM (" + " UNION ALL ".join(
    f"SELECT var_samp({c}) AS v FROM lab WHERE credit_score IS NOT NULL" for c in _PC) + ")")
def _(t):
    p = select.fit_pca(t.lab, _PC, len(_PC))
    return rnd(params_frame(t.spark, [(float(p["variance"].sum()),)], "total_variance double"), 4)


@query("r9_pca")
def _(t):
    df = t.lab.select("application_id", *_PC).dropna()
    s = scale.apply_scaler(df, scale.fit_scaler(df, _PC))
    return rnd(select.apply_pca(s, select.fit_pca(s, _PC, 0.8), whiten=True).drop(*_PC), 6)


@query("o3_isolation_forest")
def _(t):
    out = forest.isolation_outliers(t.loans.select("application_id", "annual_income", "existing_debt", "loan_amount"),
                                    ["annual_income", "existing_debt", "loan_amount"], "application_id")
    return out.groupBy("is_outlier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("anomaly"), 6).alias("anomaly"))
