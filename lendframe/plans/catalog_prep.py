"""Queries: missing values, outliers, scaling, quality."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lendframe.operators import impute, outliers, quality, scale
from lendframe.operators.stats import params_frame
from lendframe.plans.catalog_eda import ALL, SPARK_TYPES, rnd, union
from lendframe.plans.registry import SQL, query
from lendframe.sources.files import drop_incomplete, with_target
from lendframe.sources.loans import CATEGORICAL, FIELDS, NUMERIC

L = "loan_applications"
DOUBLES = [c for c in NUMERIC if SPARK_TYPES[c] == "double"]
OUT_COLS = ["annual_income", "existing_debt", "loan_amount", "property_value", "coapplicant_income"]


def d(c):
    return f"cast({c} as double)"


# --- S: plain table steps -----------------------------------------------------------------------

@query("s6_drop_incomplete", "SELECT application_id, age, credit_score, years_employed, property_value FROM loan_applications WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in ALL))
def _(t):
    return drop_incomplete(t.loans).select("application_id", "age", "credit_score", "years_employed", "property_value")


@query("s7_synthetic_target", "SELECT application_id, cast(case when credit_score >= 650 and annual_income >= 30000 then 1 else 0 end as int) AS target FROM lab")
def _(t):
    return with_target(t.lab.drop("loan_approved")).select("application_id", "target")


# --- M: missing values --------------------------------------------------------------------------

_M = ["years_employed", "credit_score", "property_value"]


@query("m1_impute_median", "SELECT application_id, " + ", ".join(
    f"round(coalesce({c}, (SELECT median({c}) FROM {L})), 6) AS {c}" for c in _M) + f" FROM {L}")
def _(t):
    df = t.loans
    p = impute.fit_imputer(df.select(*NUMERIC))
    return rnd(impute.impute(df, p).select("application_id", *_M), 6)


@query("m1_impute_by_strategy", f"SELECT application_id, round(coalesce(years_employed, (SELECT avg(years_employed) FROM {L})), 6) AS years_employed, "
       f"coalesce(credit_score, (SELECT credit_score FROM {L} WHERE credit_score IS NOT NULL GROUP BY credit_score ORDER BY count(*) DESC, cast(credit_score as varchar) LIMIT 1)) AS credit_score, "
       f"coalesce(property_value, 0e0) AS property_value FROM {L}")
def _(t):
    df = t.loans
    p = impute.fit_imputer(df.select(*_M), {"years_employed": "mean", "credit_score": "mode", "property_value": "constant"})
    return rnd(impute.impute(df, p).select("application_id", *_M), 6)


@query("m2_drop_columns", f"SELECT application_id, credit_score FROM {L}")
def _(t):
    df = t.loans.select("application_id", "credit_score", "years_employed", "property_value")
    p = impute.fit_imputer(df, {"credit_score": "constant", "years_employed": "drop", "property_value": "drop"})
    p.fill.pop("credit_score")
    return impute.impute(df, p)


@query("m4_missing_summary", "SELECT * FROM (" + union(
    f"SELECT '{c}' AS \"column\", '{SPARK_TYPES[c]}' AS dtype, count(*) - count({c}) AS nulls, "
    f"round((count(*) - count({c})) * 100e0 / count(*), 4) AS pct, '{'median' if c in _M else 'none'}' AS strategy FROM {L}"
    for c in ALL) + ") WHERE nulls > 0")
def _(t):
    df = t.loans
    return impute.missing_summary(df, impute.fit_imputer(df.select(*NUMERIC)))


_M5 = {"years_employed": ("mean", f"(SELECT avg(years_employed) FROM {L})"), "credit_score": ("median", f"(SELECT median(credit_score) FROM {L})"),
       "property_value": ("constant", "0e0")}


@query("m5_numeric_preparation", "WITH f AS (SELECT application_id, " + ", ".join(f"coalesce({c}, {v}) AS {c}" for c, (_, v) in _M5.items()) + f" FROM {L}), q AS (SELECT "
       + ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in _M5) + " FROM f), c AS (SELECT application_id, "
       + ", ".join(f"least(greatest({c}, a_{c} - 1.5e0 * (b_{c} - a_{c})), b_{c} + 1.5e0 * (b_{c} - a_{c})) AS {c}" for c in _M5)
       + " FROM f, q), m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _M5) + " FROM c) SELECT application_id, "
       + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _M5) + " FROM c, m")
def _(t):
    """Imputer, fences and scaler as one numeric preparation, each fitted on what the one before gives."""
    df = t.loans.select("application_id", *_M5)
    filled = impute.impute(df, impute.fit_imputer(df.select(*_M5), {c: s for c, (s, _) in _M5.items()}))
    clipped = outliers.treat(filled, outliers.fit_iqr(filled, list(_M5)), "clip")
    return rnd(scale.apply_scaler(clipped, scale.fit_scaler(clipped, list(_M5))), 6)


@query("m6_skew_imputer", union(
    f"SELECT '{c}' AS \"column\", case when abs(skewness({c})) > 1 then 'median' else 'mean' end AS strategy, "
    f"round(case when abs(skewness({c})) > 1 then median({c}) else avg({c}) end, 4) AS value FROM {L}" for c in DOUBLES))
def _(t):
    p = impute.fit_skew_imputer(t.loans, DOUBLES)
    return rnd(params_frame(t.spark, [(c, p.strategy[c], p.fill[c]) for c in DOUBLES],
                            "column string, strategy string, value double"), 4)


@query("m7_cascade_imputer", f"SELECT application_id, round(coalesce(years_employed, (SELECT coalesce(median(years_employed), avg(years_employed), 0e0) FROM {L})), 6) AS years_employed, "
       f"coalesce(education, 'Unknown') AS education FROM {L}")
def _(t):
    df = t.loans
    p = impute.fit_cascade_imputer(df, ["years_employed"], ["education"])
    return rnd(impute.impute(df, p).select("application_id", "years_employed", "education"), 6)


# --- O: outliers --------------------------------------------------------------------------------

def _fence(k: float) -> str:
    cols = ", ".join(f"quantile_cont({c}, 0.25) - {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
                     f"quantile_cont({c}, 0.75) + {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}" for c in OUT_COLS)
    return f"WITH q AS (SELECT {cols} FROM {L}) "


def _zfence() -> str:
    cols = ", ".join(f"avg({c}) - 3e0 * stddev_samp({c}) AS lo_{c}, avg({c}) + 3e0 * stddev_samp({c}) AS hi_{c}" for c in OUT_COLS)
    return f"WITH q AS (SELECT {cols} FROM {L}) "


def _bounds(method: str, digits: int = 4) -> str:
    return union(f"SELECT '{c}' AS \"column\", '{method}' AS method, round(lo_{c}, {digits}) AS lo, round(hi_{c}, {digits}) AS hi FROM q" for c in OUT_COLS)


@query("o1_iqr_bounds", _fence(1.5) + _bounds("iqr", 8))
def _(t):
    return rnd(outliers.bounds_table(t.spark, outliers.fit_iqr(t.loans, OUT_COLS)), 8)


@query("o2_zscore_bounds", _zfence() + _bounds("zscore"))
def _(t):
    return rnd(outliers.bounds_table(t.spark, outliers.fit_zscore(t.loans, OUT_COLS)), 4)


_HIT = {c: f"coalesce({c} < lo_{c} or {c} > hi_{c}, false)" for c in OUT_COLS}


@query("o5_clip", _fence(1.5) + "SELECT application_id, " + ", ".join(
    f"round(case when {c} < lo_{c} then lo_{c} when {c} > hi_{c} then hi_{c} else {c} end, 8) AS {c}" for c in OUT_COLS) + f" FROM {L}, q")
def _(t):
    df = t.loans
    return rnd(outliers.treat(df, outliers.fit_iqr(df, OUT_COLS), "clip").select("application_id", *OUT_COLS), 8)


@query("o5_remove", _fence(1.5) + f"SELECT application_id, annual_income FROM {L}, q WHERE NOT (" + " OR ".join(_HIT.values()) + ")")
def _(t):
    df = t.loans
    return outliers.treat(df, outliers.fit_iqr(df, OUT_COLS), "remove").select("application_id", "annual_income")


@query("o5_flag", _fence(1.5) + "SELECT application_id, " + ", ".join(f"{h} AS {c}_outlier" for c, h in _HIT.items()) + f" FROM {L}, q")
def _(t):
    df = t.loans.select("application_id", *OUT_COLS)
    return outliers.treat(df, outliers.fit_iqr(df, OUT_COLS), "flag").drop(*OUT_COLS)


@query("o5_null", _zfence() + "SELECT application_id, " + ", ".join(f"case when not {h} then {c} end AS {c}" for c, h in _HIT.items()) + f" FROM {L}, q")
def _(t):
    df = t.loans.select("application_id", *OUT_COLS)
    return outliers.treat(df, outliers.fit_zscore(df, OUT_COLS), "null")


@query("o5_signed_log", "SELECT application_id, " + ", ".join(f"round(sign({c}) * ln(1 + abs({c})), 6) AS {c}" for c in OUT_COLS) + f" FROM {L}")
def _(t):
    df = t.loans.select("application_id", *OUT_COLS)
    return rnd(outliers.treat(df, outliers.OutlierBounds("none", {c: (-math.inf, math.inf) for c in OUT_COLS}), "log"), 6)


@query("o6_outlier_summary", _fence(1.5) + union(
    f"SELECT '{c}' AS \"column\", 'iqr' AS method, count(case when {_HIT[c]} then 1 end) AS outliers, "
    f"round(count(case when {_HIT[c]} then 1 end) * 100e0 / count(*), 4) AS pct, round(min(case when {_HIT[c]} then {c} end), 4) AS min, "
    f"round(max(case when {_HIT[c]} then {c} end), 4) AS max, round(avg(case when {_HIT[c]} then {c} end), 4) AS mean, "
    f"round(stddev_samp(case when {_HIT[c]} then {c} end), 4) AS std FROM {L}, q" for c in OUT_COLS))
def _(t):
    df = t.loans
    return rnd(outliers.summary(df, outliers.fit_iqr(df, OUT_COLS)), 4)


@query("o7_outlier_values", _fence(1.5) + union(
    f"SELECT application_id, '{c}' AS \"column\", round({c}, 4) AS value, round(lo_{c}, 4) AS lo, round(hi_{c}, 4) AS hi FROM {L}, q WHERE {_HIT[c]}" for c in OUT_COLS))
def _(t):
    df = t.loans
    return rnd(outliers.outlier_values(df, outliers.fit_iqr(df, OUT_COLS), "application_id"), 4)


# --- N: scaling ---------------------------------------------------------------------------------

_N = ["annual_income", "credit_score", "years_employed", "loan_amount", "age"]


def _scaled(center, width) -> str:
    return ("WITH q AS (SELECT " + ", ".join(f"{center(d(c))} AS m_{c}, {width(d(c))} AS s_{c}" for c in _N) + f" FROM {L}) "
            "SELECT application_id, " + ", ".join(f"round(({d(c)} - m_{c}) / s_{c}, 6) AS {c}" for c in _N) + f" FROM {L}, q")


def _scale(t, method, **kw):
    df = t.loans.select("application_id", *_N)
    return rnd(scale.apply_scaler(df, scale.fit_scaler(df, _N, method, **kw)), 6)


@query("n1_standard", _scaled(lambda c: f"avg({c})", lambda c: f"stddev_pop({c})"))
def _(t):
    return _scale(t, "standard")


@query("n2_minmax", _scaled(lambda c: f"min({c})", lambda c: f"(max({c}) - min({c}))"))
def _(t):
    return _scale(t, "minmax")


@query("n3_robust", _scaled(lambda c: f"median({c})", lambda c: f"(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def _(t):
    return _scale(t, "robust")


@query("n3_robust_range", _scaled(lambda c: f"median({c})", lambda c: f"(quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1))"))
def _(t):
    return _scale(t, "robust", quantile_range=(0.1, 0.9))


_LAMS = [-1.0, -0.5, 0.0, 0.5, 1.0, 2.0]


def _yj(x: str, lam: float) -> str:
    pos = f"ln(1 + {x})" if lam == 0 else f"(pow({x} + 1, {lam}) - 1) / {lam}"
    neg = f"-ln(1 - {x})" if lam == 2 else f"-(pow(1 - {x}, {2 - lam}) - 1) / {2 - lam}"
    return f"case when {x} >= 0 then {pos} when {x} < 0 then {neg} end"


_Z = "(loan_amount - 20000e0) / 10000e0"


@query("n4_yeo_johnson", f"SELECT application_id, " + ", ".join(
    f"round({_yj(_Z, lam)}, 9) AS y{k}" for k, lam in enumerate(_LAMS)) + f" FROM {L}")
def _(t):
    z = F.expr("(loan_amount - 20000D) / 10000D")
    return t.loans.select("application_id", *[F.round(scale.yeo_johnson(z, lam), 9).alias(f"y{k}") for k, lam in enumerate(_LAMS)])


def _ll(y: str, jac: str, lam: float) -> str:
    return f"-0.5e0 * count({jac}) * ln(var_pop({y})) + ({lam} - 1e0) * sum({jac})"


@query("n4_yeo_johnson_likelihood", union(
    f"SELECT '{c}' AS \"column\", cast({lam} as double) AS lambda, round({_ll(_yj(c, lam), f'sign({c}) * ln(1 + abs({c}))', lam)}, 2) AS log_likelihood FROM {L}"
    for c in ("annual_income", "years_employed", "loan_amount") for lam in _LAMS))
def _(t):
    cols = ["annual_income", "years_employed", "loan_amount"]
    ll = scale.log_likelihoods(t.loans, cols, {c: _LAMS for c in cols})
    return rnd(params_frame(t.spark, [(c, lam, ll[c][k]) for c in cols for k, lam in enumerate(_LAMS)],
                            "column string, lambda double, log_likelihood double"), 2)


@query("n4_power_scaled")
def _(t):
    return _scale(t, "power")


@query("n5_box_cox_likelihood", union(
    f"SELECT '{c}' AS \"column\", cast({lam} as double) AS lambda, round("
    + _ll(f"ln({c})" if lam == 0 else f"(pow({c}, {lam}) - 1) / {lam}", f"ln({c})", lam) + f", 2) AS log_likelihood FROM {L}"
    for c in ("annual_income", "loan_amount") for lam in _LAMS))
def _(t):
    cols = ["annual_income", "loan_amount"]
    ll = scale.log_likelihoods(t.loans, cols, {c: _LAMS for c in cols}, "box-cox")
    return rnd(params_frame(t.spark, [(c, lam, ll[c][k]) for c in cols for k, lam in enumerate(_LAMS)],
                            "column string, lambda double, log_likelihood double"), 2)


@query("n5_box_cox_scaled")
def _(t):
    df = t.loans.select("application_id", "annual_income", "years_with_bank")
    return rnd(scale.apply_scaler(df, scale.fit_scaler(df, ["annual_income", "years_with_bank"], "box-cox")), 6)


def _sql_uniform(c: str, n: int = 1000) -> str:
    """Value of the quantile transform of one column, by application."""
    return (f"(WITH q AS (SELECT quantile_cont({d(c)}, list_transform(range(0, {n}), lambda z: z / {n - 1}e0)) AS v FROM {L}), "
            f"raw AS (SELECT unnest(v) AS v, unnest(range(0, {n})) / {n - 1}e0 AS p FROM q), knots AS (SELECT v, min(p) AS lo, max(p) AS hi FROM raw GROUP BY v), "
            "seg AS (SELECT v AS v0, lo AS lo0, hi AS hi0, lead(v) OVER (ORDER BY v) AS v1, lead(lo) OVER (ORDER BY v) AS lo1 FROM knots) "
            f"SELECT rid, round(case when x is null then null when x = v0 and lo0 = 0 then 0e0 when v1 is null then 1e0 when x = v0 then (lo0 + hi0) / 2 "
            f"else hi0 + (lo1 - hi0) * (x - v0) / (v1 - v0) end, 6) AS {c} FROM (SELECT rid, {d(c)} AS x FROM numbered) LEFT JOIN seg ON x >= v0 AND (v1 IS NULL OR x < v1))")


_Q = ["loan_amount", "credit_score"]


@query("n6_quantile_uniform", f"WITH numbered AS (SELECT *, row_number() OVER () AS rid FROM {L}) SELECT application_id, a.loan_amount, b.credit_score FROM (SELECT rid, application_id FROM numbered) "
       f"JOIN {_sql_uniform('loan_amount')} a USING (rid) JOIN {_sql_uniform('credit_score')} b USING (rid)")
def _(t):
    df = t.loans.select("application_id", *_Q)
    return rnd(scale.apply_quantile_map(df, scale.fit_quantile_map(df, _Q)), 6)


@query("n6_quantile_normal")
def _(t):
    df = t.loans.select("application_id", "loan_amount", "credit_score")
    return rnd(scale.apply_quantile_map(df, scale.fit_quantile_map(df, ["loan_amount", "credit_score"]), "normal"), 6)


@query("n7_method_choice", union(
    f"SELECT '{c}' AS \"column\", case when n < 10 then 'standard' when abs(sk) > 2 then 'power' when o * 1e0 / n > 0.1e0 then 'robust' "
    f"when mn >= 0 and mx <= 100 then 'minmax' else 'standard' end AS method, round(sk, 4) AS skew, round(o * 1e0 / n, 6) AS outlier_ratio FROM "
    f"(SELECT count({c}) AS n, min({c}) AS mn, max({c}) AS mx, skewness({c}) AS sk, "
    f"count(case when {c} < a - 1.5e0 * (b - a) or {c} > b + 1.5e0 * (b - a) then 1 end) AS o FROM {L}, "
    f"(SELECT quantile_cont({d(c)}, 0.25) AS a, quantile_cont({d(c)}, 0.75) AS b FROM {L}) q)" for c in NUMERIC))
def _(t):
    got = scale.choose_methods(t.loans, NUMERIC)
    return params_frame(t.spark, [(c, r["method"], r["skew"], r["outlier_ratio"]) for c, r in got.items()],
                        "column string, method string, skew double, outlier_ratio double").select(
        "column", "method", F.round("skew", 4).alias("skew"), F.round("outlier_ratio", 6).alias("outlier_ratio"))


@query("n8_inverse", f"SELECT application_id, " + ", ".join(f"round({d(c)}, 5) AS {c}" for c in _N) + f" FROM {L}")
def _(t):
    df = t.loans.select("application_id", *_N)
    s = scale.fit_scaler(df, _N, {"annual_income": "power", "credit_score": "robust", "years_employed": "minmax",
                                  "loan_amount": "box-cox", "age": "standard"})
    return rnd(scale.invert_scaler(scale.apply_scaler(df, s), s), 5)


@query("n9_feature_stats", union(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(cast(min({c}) as double), 4) AS min, "
    f"round(cast(max({c}) as double), 4) AS max, round(quantile_cont({d(c)}, 0.25), 4) AS q25, round(quantile_cont({d(c)}, 0.5), 4) AS q50, "
    f"round(quantile_cont({d(c)}, 0.75), 4) AS q75, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis, "
    f"round((count(*) - count({c})) * 100e0 / count(*), 4) AS missing_pct, count(distinct {c}) AS unique_values, "
    f"count(case when {c} < a - 1.5e0 * (b - a) or {c} > b + 1.5e0 * (b - a) then 1 end) AS outliers_iqr FROM {L}, "
    f"(SELECT quantile_cont({d(c)}, 0.25) AS a, quantile_cont({d(c)}, 0.75) AS b FROM {L}) q" for c in NUMERIC))
def _(t):
    return rnd(scale.feature_stats(t.loans, NUMERIC), 4)


@query("n10_auto_assign", union(
    f"SELECT '{c}' AS \"column\", stddev_samp({c}) > 0 AS scale, o > n * 0.05e0 AS treat_outliers, abs(sk) > 2 and not o > n * 0.05e0 AS normalize FROM "
    f"(SELECT count(*) AS n, skewness({c}) AS sk, count(case when {c} < a - 1.5e0 * (b - a) or {c} > b + 1.5e0 * (b - a) then 1 end) AS o FROM {L}, "
    f"(SELECT quantile_cont({d(c)}, 0.25) AS a, quantile_cont({d(c)}, 0.75) AS b FROM {L}) q), (SELECT {c} FROM {L}) GROUP BY n, sk, o" for c in NUMERIC))
def _(t):
    return scale.auto_assign(t.loans, NUMERIC)


def _code(c: str, edges: list[str]) -> str:
    return "case when " + c + " is null then null else " + " + ".join(f"case when {c} >= {e} then 1 else 0 end" for e in edges) + " end"


@query("n11_quantile_bins", "WITH q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, {p / 5}) AS {c}_{p}" for c in ("annual_income", "years_employed") for p in range(1, 5)) + f" FROM {L}) "
    "SELECT application_id, " + ", ".join(f"cast({_code(c, [f'{c}_{p}' for p in range(1, 5)])} as int) AS {c}" for c in ("annual_income", "years_employed")) + f" FROM {L}, q")
def _(t):
    df = t.loans.select("application_id", "annual_income", "years_employed")
    return scale.bin_ordinal(df, scale.fit_bins(df, ["annual_income", "years_employed"], 5))


@query("n11_uniform_bins", f"WITH q AS (SELECT min(loan_amount) AS lo, max(loan_amount) AS hi FROM {L}) SELECT application_id, cast("
       + _code("loan_amount", [f"(lo + (hi - lo) * {k} / 5)" for k in range(1, 5)]) + f" as int) AS loan_amount FROM {L}, q")
def _(t):
    df = t.loans.select("application_id", "loan_amount")
    return scale.bin_ordinal(df, scale.fit_bins(df, ["loan_amount"], 5, "uniform"))


@query("n11_kmeans_bins")
def _(t):
    df = t.loans.select("application_id", "loan_amount")
    return scale.bin_ordinal(df, scale.fit_bins(df, ["loan_amount"], 5, "kmeans")).groupBy("loan_amount").count()


@query("n12_fixed_bins", "SELECT application_id, cast(case when credit_score > 0 and credit_score <= 580 then 0 when credit_score <= 670 then 1 when credit_score <= 740 then 2 "
       "when credit_score <= 800 then 3 when credit_score <= 850 then 4 end as int) AS credit_tier, "
       "cast(case when debt_to_income_ratio > 0 and debt_to_income_ratio <= 0.2e0 then 0 when debt_to_income_ratio > 0.2e0 and debt_to_income_ratio <= 0.4e0 then 1 "
       f"when debt_to_income_ratio > 0.4e0 and debt_to_income_ratio <= 0.6e0 then 2 when debt_to_income_ratio > 0.6e0 and debt_to_income_ratio <= 1e0 then 3 end as int) AS debt_category FROM {L}")
def _(t):
    return t.loans.select("application_id", scale.cut(F.col("credit_score"), [0, 580, 670, 740, 800, 850]).alias("credit_tier"),
                          scale.cut(F.col("debt_to_income_ratio"), [0, 0.2, 0.4, 0.6, 1.0]).alias("debt_category"))


@query("n13_scaling_summary", "SELECT \"column\", method, round(m, 4) AS mean_before, round(s, 4) AS std_before, round(lo, 4) AS min_before, round(hi, 4) AS max_before, "
       "abs(round((m - m) / s, 4)) AS mean_after, round(s / s, 4) AS std_after, round((lo - m) / s, 4) AS min_after, round((hi - m) / s, 4) AS max_after FROM ("
       + union(f"SELECT '{c}' AS \"column\", 'standard' AS method, avg({c}) AS m, stddev_pop({c}) AS s, cast(min({c}) as double) AS lo, cast(max({c}) as double) AS hi FROM {L}" for c in _N) + ")")
def _(t):
    df = t.loans.select("application_id", *_N)
    return rnd(scale.scaling_summary(df, scale.fit_scaler(df, _N, "standard")), 4).withColumn("mean_after", F.abs("mean_after"))


def _issue(c: str) -> str:
    base = (f"(SELECT count({c}) AS n, count(distinct {c}) AS u, abs(skewness({c})) AS sk, count(case when {c} < a - 1.5e0 * (b - a) or {c} > b + 1.5e0 * (b - a) then 1 end) AS o "
            f"FROM {L}, (SELECT quantile_cont({d(c)}, 0.25) AS a, quantile_cont({d(c)}, 0.75) AS b FROM {L}) q)")
    return (f"SELECT '{c}' AS \"column\", 'high_skewness' AS issue, round(sk, 4) AS measure FROM {base} WHERE u > 1 AND sk > 3 UNION ALL "
            f"SELECT '{c}', 'many_outliers', round(o * 1e0 / n, 4) FROM {base} WHERE u > 1 AND n > 10 AND o * 1e0 / n > 0.2e0")


@query("n13_data_issues", union(_issue(c) for c in NUMERIC) + " UNION ALL " + union(
    f"SELECT '{c}', 'imbalanced', round(max(k) * 1e0 / sum(k), 4) FROM (SELECT count(*) AS k FROM {L} WHERE {c} IS NOT NULL GROUP BY {c}) HAVING count(*) > 1 AND max(k) * 1e0 / sum(k) > 0.9e0" for c in CATEGORICAL))
def _(t):
    return rnd(scale.data_issues(t.loans.select(*NUMERIC, *CATEGORICAL)), 4)


# --- Q: quality ---------------------------------------------------------------------------------

AS_OF = "2002-01-01"
LIMITS = {"credit_score": (300, 850), "debt_to_income_ratio": (0, 1), "annual_income": (0, 200000)}


@query("q1_completeness", union(
    f"SELECT '{c}' AS \"column\", round(count({c}) * 1e0 / count(*), 6) AS ratio, count(*) - count({c}) AS missing, count({c}) * 1e0 / count(*) < 0.7e0 AS critical_gap FROM {L}" for c in ALL))
def _(t):
    return rnd(quality.completeness(t.loans), 6)


def _inv(c: str) -> str:
    parts = []
    if c == "age":
        parts.append("count(case when age < 0 or age > 150 then 1 end)")
    if c in LIMITS:
        parts += [f"count(case when {c} < {LIMITS[c][0]} then 1 end)", f"count(case when {c} > {LIMITS[c][1]} then 1 end)"]
    return " + ".join(parts) or "0"


@query("q2_validity", union(
    f"SELECT '{c}' AS \"column\", count({c}) AS total, count({c}) - ({_inv(c)}) AS valid, round((count({c}) - ({_inv(c)})) * 1e0 / count({c}), 6) AS ratio FROM {L}" for c in ALL))
def _(t):
    return rnd(quality.validity(t.loans, LIMITS), 6)


def _cons(c: str) -> str:
    ty = SPARK_TYPES[c]
    if ty == "string":
        return (f"SELECT '{c}' AS \"column\", count(distinct {c}) - count(distinct lower({c})) AS case_variants, "
                f"count(case when {c} <> trim({c}) then 1 end) AS untrimmed, 0 AS precisions FROM {L}")
    if ty == "double":
        return f"SELECT '{c}' AS \"column\", 0, 0, count(distinct length(split_part(cast({c} as varchar), '.', 2))) FROM {L}"
    return f"SELECT '{c}' AS \"column\", 0, 0, 0"


@query("q3_consistency", "SELECT *, round(1e0 - case when case_variants > 0 then 0.1e0 else 0e0 end - case when untrimmed > 0 then 0.1e0 else 0e0 end "
       "- case when precisions > 3 then 0.1e0 else 0e0 end, 6) AS score FROM (" + union(
           _cons(c) for c in sorted(ALL, key=lambda c: SPARK_TYPES[c] != "string")) + ")")
def _(t):
    return rnd(quality.consistency(t.loans), 6)


@query("q4_uniqueness", union(
    f"SELECT '{c}' AS \"column\", count({c}) AS total, count(distinct {c}) AS unique_count, round(count(distinct {c}) * 1e0 / count({c}), 6) AS ratio, "
    f"count({c}) - count(distinct {c}) AS duplicates, count(distinct {c}) * 1e0 / count({c}) > 0.95e0 and count({c}) > 10 AS key_candidate FROM {L}" for c in ALL))
def _(t):
    return rnd(quality.uniqueness(t.dealt(t.loans)), 6)


@query("q4_row_uniqueness", f"SELECT (SELECT count(*) FROM {L}) AS total, count(*) AS distinct_rows, (SELECT count(*) FROM {L}) - count(*) AS duplicates, "
       f"round(count(*) * 1e0 / (SELECT count(*) FROM {L}), 6) AS ratio FROM (SELECT DISTINCT * FROM {L})")
def _(t):
    return rnd(quality.row_uniqueness(t.loans), 6)


_QN = ["application_id", *NUMERIC, "loan_approved"]


@query("q5_accuracy", union(
    f"SELECT '{c}' AS \"column\", count({c}) AS total, count(case when {c} < a - 3e0 * (b - a) or {c} > b + 3e0 * (b - a) then 1 end) AS extreme, "
    f"round(count(case when {c} < a - 3e0 * (b - a) or {c} > b + 3e0 * (b - a) then 1 end) * 1e0 / count({c}), 6) AS ratio, "
    f"count(case when {c} < a - 3e0 * (b - a) or {c} > b + 3e0 * (b - a) then 1 end) * 1e0 / count({c}) > 0.1e0 AS flagged FROM {L}, "
    f"(SELECT quantile_cont({d(c)}, 0.25) AS a, quantile_cont({d(c)}, 0.75) AS b FROM {L}) q" for c in _QN))
def _(t):
    return rnd(quality.accuracy(t.loans), 6)


@query("q6_timeliness", f"SELECT 'application_date' AS \"column\", cast(min(application_date) as date) AS oldest, cast(max(application_date) as date) AS newest, "
       f"date_diff('day', cast(max(application_date) as date), date '{AS_OF}') AS days_old, date_diff('day', cast(max(application_date) as date), date '{AS_OF}') > 365 AS stale FROM {L}")
def _(t):
    return quality.timeliness(t.loans, AS_OF)


_LEVEL = "case when score >= 0.95e0 then 'Excellent' when score >= 0.85e0 then 'Good' when score >= 0.7e0 then 'Fair' else 'Poor' end"
_DB = [c for c in ALL if SPARK_TYPES[c] == "double"]
_ST = [c for c in ALL if SPARK_TYPES[c] == "string"]
_PEN = ("(" + " + ".join(
    [f"(case when (SELECT count(distinct length(split_part(cast({c} as varchar), '.', 2))) FROM {L}) > 3 then 1 else 0 end)" for c in _DB]
    + [f"(case when (SELECT count(distinct {c}) - count(distinct lower({c})) FROM {L}) > 0 then 1 else 0 end)" for c in _ST]
    + [f"(case when (SELECT count(case when {c} <> trim({c}) then 1 end) FROM {L}) > 0 then 1 else 0 end)" for c in _ST]) + ")")
_EXT = "(" + " + ".join(
    f"(SELECT case when count(case when {c} < a - 3e0 * (b - a) or {c} > b + 3e0 * (b - a) then 1 end) * 1e0 / count({c}) > 0.1e0 then 1 else 0 end FROM {L}, "
    f"(SELECT quantile_cont({d(c)}, 0.25) AS a, quantile_cont({d(c)}, 0.75) AS b FROM {L}) q)" for c in _QN) + ")"


@query("q7_overall_quality",
       f"WITH s AS (SELECT 'completeness' AS dimension, ({' + '.join(f'count({c})' for c in ALL)}) * 1e0 / (count(*) * {len(ALL)}) AS score, 0.25e0 AS w FROM {L} UNION ALL "
       f"SELECT 'validity', ({' + '.join(f'count({c}) - ({_inv(c)})' for c in ALL)}) * 1e0 / ({' + '.join(f'count({c})' for c in ALL)}), 0.2e0 FROM {L} UNION ALL "
       f"SELECT 'consistency', ({len(ALL)} - 0.1e0 * {_PEN}) / {len(ALL)}, 0.2e0 UNION ALL "
       f"SELECT 'uniqueness', (SELECT count(*) FROM (SELECT DISTINCT * FROM {L})) * 1e0 / (SELECT count(*) FROM {L}), 0.15e0 UNION ALL "
       f"SELECT 'accuracy', greatest(0e0, 0.8e0 - 0.1e0 * {_EXT}), 0.1e0 UNION ALL "
       f"SELECT 'timeliness', 0.8e0 - case when date_diff('day', cast((SELECT max(application_date) FROM {L}) as date), date '{AS_OF}') > 365 then 0.2e0 else 0e0 end, 0.1e0), "
       "o AS (SELECT dimension, score FROM s UNION ALL SELECT 'overall', sum(score * w) FROM s) "
       f"SELECT dimension, round(score, 6) AS score, {_LEVEL} AS level FROM o")
def _(t):
    return rnd(quality.report_table(t.spark, quality.assess(t.loans, AS_OF, LIMITS)), 6).drop("issues")


@query("q8_quality_gate")
def _(t):
    r = quality.assess(t.loans, AS_OF, LIMITS)
    return rnd(params_frame(t.spark, [(r.overall, 0.7, quality.gate(r, 0.7))], "score double, minimum double, passed boolean"), 6)


SQL["q8_quality_gate"] = f"SELECT score, 0.7e0 AS minimum, score >= 0.7e0 AS passed FROM ({SQL['q7_overall_quality']}) WHERE dimension = 'overall'"
