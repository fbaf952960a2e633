"""Evaluation metrics over a long prediction table ``(row_id, model, label, proba, pred, ...)``.

All metrics of all models (or groups) come from one hash aggregate; rank
metrics aggregate by distinct score first and run bucketed running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lendframe.operators.ranking import running_totals


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _counts(w: Column) -> list[Column]:
    y, p = F.col("label"), F.col("pred")
    hit = lambda a, b: F.sum(F.when((y == a) & (p == b), w).otherwise(F.lit(0.0)))
    return [hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn")]


def confusion(preds: DataFrame, by: list[str] = ("model",), weight: str | None = None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return preds.groupBy(*by).agg(*_counts(w))


def classification_metrics(preds: DataFrame, by: list[str] = ("model",), weight: str | None = None) -> DataFrame:
    """Confusion counts and derived rates; an empty denominator gives 0 (LR+ with no false positives: null)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    tpr, tnr, ppv = _div(tp, tp + fn), _div(tn, tn + fp), _div(tp, tp + fp)
    expected = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    acc = (tp + tn) / n
    return confusion(preds, by, weight).select(
        *by, "tp", "fp", "tn", "fn", acc.alias("accuracy"), ((tpr + tnr) / 2).alias("balanced_accuracy"),
        ppv.alias("precision"), tpr.alias("recall"), _div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
        _div(acc - expected, 1 - expected).alias("kappa"), tnr.alias("specificity"),
        _div(fp, fp + tn).alias("fpr"), _div(fn, fn + tp).alias("fnr"), ppv.alias("ppv"), _div(tn, tn + fn).alias("npv"),
        F.try_divide(tpr, _div(fp, fp + tn)).alias("lr_positive"), F.try_divide(1 - tpr, tnr).alias("lr_negative"))


def class_report(preds: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Precision, recall, F1 and support per class (any number of classes)."""
    by = list(by)
    pairs = preds.groupBy(*by, "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    # both roles of each (label, pred) cell, without a second pass over the rows
    cells = pairs.select(*by, F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.lit(0).cast("bigint").alias("hit"), F.col("n").alias("predicted")))).alias("e")).select(*by, "e.*")
    s = cells.groupBy(*by, "cls").agg(F.sum("support").alias("support"), F.sum("hit").alias("hit"), F.sum("predicted").alias("predicted"))
    return s.select(*by, F.col("cls").alias("label"), "support", _div(F.col("hit"), F.col("predicted")).alias("precision"),
                    _div(F.col("hit"), F.col("support")).alias("recall"),
                    _div(2.0 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"))


def weighted_averages(preds: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Support-weighted precision, recall and F1."""
    r = class_report(preds, by)
    avg = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}")
    return r.groupBy(*by).agg(avg("precision"), avg("recall"), avg("f1"), F.sum("support").alias("support"))


def rank_metrics(preds: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """ROC AUC (ties count half, one class only gives 0) and average precision (step sum)."""
    by = list(by)
    per = preds.groupBy(*by, "proba").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"),
                                          F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("neg"))
    tot = per.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    run = running_totals(per, "proba", ["pos", "neg"], by)
    j = run.join(tot, by)
    tp, fp = F.col("P") - F.col("cum_pos") + F.col("pos"), F.col("N") - F.col("cum_neg") + F.col("neg")
    area = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
    ap = F.sum(F.when(F.col("pos") > 0, F.col("pos") * tp / (tp + fp)).otherwise(0.0))
    return j.groupBy(*by).agg(
        _div(area, F.max("P").cast("double") * F.max("N")).alias("auc"), _div(ap, F.max("P")).alias("average_precision"))


def probability_scores(preds: DataFrame, by: list[str] = ("model",), eps: float = 1e-15) -> DataFrame:
    """Brier score and log loss with clipped probabilities."""
    p = F.least(F.greatest(F.col("proba"), F.lit(eps)), F.lit(1 - eps))
    ll = -F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))
    return preds.groupBy(*by).agg(F.avg((F.col("proba") - F.col("label")) * (F.col("proba") - F.col("label"))).alias("brier"),
                                  F.avg(ll).alias("log_loss"))


def business_impact(preds: DataFrame, by: list[str] = ("model",), amount: str | None = "loan_amount", *,
                    default_rate: float = 0.1, margin: float = 0.05, recovery: float = 0.3, cost: float = 100.0,
                    default_amount: float = 25_000.0) -> DataFrame:
    """Money view of the confusion cells; without amounts every loan counts ``default_amount``."""
    a = F.col(amount).cast("double") if amount else F.lit(default_amount)
    y, p = F.col("label"), F.col("pred")
    money = lambda c: F.sum(F.when(c, a).otherwise(0.0))
    g = preds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), money((p == 1) & (y == 1)).alias("tp"), money((p == 1) & (y == 0)).alias("fp"),
        money((p == 0) & (y == 1)).alias("fn"), F.avg(a).alias("average_loan_amount"), F.sum("pred").alias("approved_applications"))
    revenue, losses = F.col("tp") * margin * (1 - default_rate), F.col("fp") * (1 - recovery)
    costs = F.col("n") * cost
    return g.select(
        *by, (revenue - losses - costs).alias("net_business_value"), revenue.alias("revenue_from_approved"),
        losses.alias("losses_from_defaults"), (F.col("fn") * margin * (1 - default_rate)).alias("opportunity_cost"),
        costs.alias("processing_costs"), (F.col("tp") + F.col("fp")).alias("approved_portfolio_value"),
        (F.col("tp") + F.col("fn")).alias("expected_portfolio_value"),
        _div(F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")).alias("portfolio_efficiency"), "average_loan_amount",
        "approved_applications", (F.col("approved_applications") / F.col("n")).alias("approval_rate"),
        _div(revenue, revenue + losses).alias("precision_weighted_value"))


def fold_business(preds: DataFrame, by: list[str] = ("model",), margin: float = 0.05, loss: float = 0.3) -> DataFrame:
    """Business metrics of a validation fold."""
    y, p, a = F.col("label"), F.col("pred"), F.col("loan_amount")
    money = lambda c: F.sum(F.when(c, a).otherwise(0.0))
    g = preds.groupBy(*by).agg(money((p == 1) & (y == 1)).alias("tp"), money((p == 1) & (y == 0)).alias("fp"),
                               money((p == 0) & (y == 1)).alias("fn"), money(y == 1).alias("total"))
    r, lo = F.col("tp") * margin, F.col("fp") * loss
    return g.select(*by, r.alias("potential_revenue"), lo.alias("potential_losses"), (F.col("fn") * margin).alias("opportunity_cost"),
                    (r - lo).alias("net_business_impact"), _div(r, F.col("total") * margin).alias("revenue_efficiency"),
                    _div(r - lo, r + lo).alias("risk_adjusted_return"))


def _by_attribute(preds: DataFrame, attributes: list[str]) -> DataFrame:
    return preds.select("model", "label", "pred", "proba", F.explode(F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("grp")) for a in attributes])).alias("e")
    ).select("model", "label", "pred", "proba", "e.*")


def group_metrics(preds: DataFrame, attributes: list[str]) -> DataFrame:
    """Metrics per model, protected attribute and group; all attributes in one pass."""
    long = _by_attribute(preds, attributes)
    by = ["model", "attribute", "grp"]
    c = long.groupBy(*by).agg(*_counts(F.lit(1.0)))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    base = c.select(*by, n.cast("bigint").alias("sample_size"), ((F.col("tp") + F.col("tn")) / n).alias("accuracy"),
                    _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    _div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                    ((F.col("tp") + F.col("fp")) / n).alias("approval_rate"), ((F.col("tp") + F.col("fn")) / n).alias("base_rate"))
    return base.join(rank_metrics(long, by).select(*by, "auc"), by)


def fairness(preds: DataFrame, attributes: list[str]) -> DataFrame:
    """Parity gaps per attribute with at least two groups, and the largest gap of the model."""
    long = _by_attribute(preds, attributes)
    c = long.groupBy("model", "attribute", "grp").agg(*_counts(F.lit(1.0)))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    g = c.select("model", "attribute", ((F.col("tp") + F.col("fp")) / n).alias("ar"),
                 _div(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"), ((F.col("tp") + F.col("tn")) / n).alias("acc"))
    gap = lambda x: F.max(x) - F.min(x)
    out = g.groupBy("model", "attribute").agg(
        F.count(F.lit(1)).alias("groups"), gap("ar").alias("demographic_parity_diff"), _div(F.min("ar"), F.max("ar")).alias("demographic_parity_ratio"),
        gap("tpr").alias("equal_opportunity_diff"), gap("acc").alias("accuracy_parity_diff")).where("groups >= 2")
    worst = out.groupBy("model").agg(F.max(F.greatest("demographic_parity_diff", "equal_opportunity_diff", "accuracy_parity_diff")).alias("overall_fairness_score"))
    return out.join(worst, "model")
