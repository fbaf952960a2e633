"""A deterministic prediction table for the metric operators.

Three scores in [0, 1] from credit score, debt ratio and household income
stand in for model outputs, so that every metric can be checked in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lendframe.sources.loans import LOANS_CTE

SCORES = {
    "credit": "(coalesce(credit_score, 650e0) - 300e0) / 550e0",
    "debt": "1e0 - least(debt_to_income_ratio, 1e0)",
    "income": "total_household_income / (total_household_income + 60000e0)",
}
MODELS = sorted(SCORES)

PREDS_CTE = (
    LOANS_CTE + ",\nwide AS (SELECT application_id AS row_id, loan_approved AS label, loan_amount, gender, "
    "area_type, application_date, " + ", ".join(f"{e} AS p_{m}" for m, e in SCORES.items()) + " FROM lab),\n"
    "preds AS (" + " UNION ALL ".join(
        f"SELECT row_id, '{m}' AS model, label, p_{m} AS proba, "
        f"cast(case when p_{m} >= 0.5e0 then 1 else 0 end as int) AS pred, loan_amount, gender, area_type, "
        "application_date FROM wide" for m in MODELS) + ")"
)


def prediction_table(lab: DataFrame) -> DataFrame:
    """Long form ``(row_id, model, label, proba, pred, loan_amount, gender, area_type, ...)`` in one scan."""
    entries = ", ".join(f"named_struct('model', '{m}', 'proba', {SCORES[m]})" for m in MODELS)
    return lab.selectExpr(
        "application_id AS row_id", "loan_approved AS label", "loan_amount", "gender", "area_type",
        "application_date", f"inline(array({entries}))",
    ).selectExpr(
        "row_id", "model", "label", "proba", "cast(if(proba >= 0.5e0, 1, 0) as int) AS pred",
        "loan_amount", "gender", "area_type", "application_date")
