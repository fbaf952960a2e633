"""Queries: encoders, row-wise features, selection, splits."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from lendframe.functions import recipes
from lendframe.operators import encode, interact, select, split
from lendframe.operators.stats import params_frame
from lendframe.plans.catalog_eda import ALL, SPARK_TYPES, rnd, union
from lendframe.plans.registry import query
from lendframe.sources.loans import CATEGORICAL, NUMERIC

L = "loan_applications"
_H = "md5(concat(cast({id} as varchar), '-', '{seed}'))"


def h(id_: str = "application_id", seed: object = 42) -> str:
    return _H.format(id=id_, seed=seed)


def frac(x: str) -> str:
    return f"cast(cast('0x' || substr({x}, 1, 8) as bigint) as double) / 4294967296e0"


# --- E ------------------------------------------------------------------------------------------

_CATS = {"gender": ["Female", "Male"], "area_type": ["Rural", "Suburban", "Urban"],
         "marital_status": ["Divorced", "Married", "Single", "Widowed"]}


@query("e1_one_hot", "SELECT application_id, " + ", ".join(
    f"cast(case when {c} = '{v}' then 1 else 0 end as int) AS \"{c}_{v}\"" for c, vs in _CATS.items() for v in vs) + f" FROM {L}")
def _(t):
    df = t.loans.select("application_id", *_CATS)
    return encode.one_hot(df, encode.fit_categories(df, list(_CATS)))


@query("e1_one_hot_drop_first", f"SELECT application_id, cast(case when gender = 'Male' then 1 else 0 end as int) AS \"gender_Male\" FROM {L}")
def _(t):
    df = t.loans.select("application_id", "gender")
    return encode.one_hot(df, encode.fit_categories(df, ["gender"]), drop_first=True)


@query("e2_label", f"SELECT application_id, cast(dense_rank() OVER (ORDER BY loan_purpose) - 1 as int) AS loan_purpose_code FROM {L}")
def _(t):
    df = t.loans.select("application_id", "loan_purpose")
    return encode.label_encode(df, "loan_purpose", encode.label_table(df, "loan_purpose")).drop("loan_purpose")


@query("e2_label_unknown", f"WITH k AS (SELECT state, row_number() OVER (ORDER BY state) - 1 AS code FROM (SELECT DISTINCT state FROM {L} WHERE loan_approved = 0 AND state <> 'PA')) "
       f"SELECT application_id, cast(coalesce(code, 0) as int) AS state FROM {L} l LEFT JOIN k ON l.state = k.state")
def _(t):
    df = t.loans
    cats = encode.fit_categories(df.where("loan_approved = 0 and state <> 'PA'"), ["state"])
    return encode.label_codes(df.select("application_id", "state"), cats)


@query("e3_ordinal", f"SELECT application_id, cast(case education when 'High School' then 0 when 'Some College' then 1 when 'Bachelor''s' then 2 else -1 end as int) AS education FROM {L}")
def _(t):
    return encode.ordinal(t.loans.select("application_id", "education"), {"education": ["High School", "Some College", "Bachelor's"]})


def _target(s: float) -> str:
    return (f"WITH g AS (SELECT avg(loan_approved) AS m FROM {L}), e AS (SELECT loan_purpose AS v, (sum(loan_approved) + {s} * min(m)) / (count(*) + {s}) AS enc FROM {L}, g GROUP BY loan_purpose) "
            f"SELECT application_id, round(coalesce(enc, m), 6) AS loan_purpose_encoded FROM {L} LEFT JOIN e ON v = loan_purpose, g")


@query("e4_target_smoothed", _target(10.0))
def _(t):
    df = t.loans.select("application_id", "loan_purpose", "loan_approved")
    return rnd(encode.apply_target(df, encode.fit_target(df, "loan_purpose", "loan_approved", 10.0)), 6).drop("loan_purpose", "loan_approved")


@query("e5_target_out_of_fold",
       f"WITH f AS (SELECT *, cast(floor({frac(h())} * 5) as int) AS fold FROM lab), k AS (SELECT DISTINCT fold FROM f), "
       "g AS (SELECT k.fold, avg(loan_approved) AS m FROM k JOIN f ON f.fold <> k.fold GROUP BY k.fold), "
       "e AS (SELECT k.fold, loan_purpose, sum(loan_approved) AS s, count(*) AS n FROM k JOIN f ON f.fold <> k.fold GROUP BY k.fold, loan_purpose) "
       "SELECT application_id, f.fold, round((s + 1e0 * m) / (n + 1e0), 6) AS loan_purpose_encoded FROM f JOIN g USING (fold) JOIN e ON e.fold = f.fold AND e.loan_purpose = f.loan_purpose")
def _(t):
    df = split.hash_fold(t.lab.select("application_id", "loan_purpose", "loan_approved"), "application_id")
    return rnd(encode.out_of_fold_target(df, "loan_purpose", "loan_approved"), 6).select("application_id", "fold", "loan_purpose_encoded")


@query("e6_target_plain", _target(0.0))
def _(t):
    df = t.loans.select("application_id", "loan_purpose", "loan_approved")
    return rnd(encode.apply_target(df, encode.fit_target(df, "loan_purpose", "loan_approved", 0.0)), 6).drop("loan_purpose", "loan_approved")


@query("e7_assign_encoders", union(f"SELECT '{c}' AS \"column\", count(distinct {c}) AS categories, case when count(distinct {c}) <= 5 then 'onehot' else 'label' end AS encoder FROM {L}" for c in CATEGORICAL))
def _(t):
    return encode.assign_encoders(t.loans, CATEGORICAL, max_one_hot=5)


@query("e8_category_codes", f"SELECT application_id, cast(case when s is null then -1 else dense_rank() OVER (ORDER BY s NULLS LAST) - 1 end as int) AS s FROM (SELECT application_id, case when credit_score is null then null else employment_status end AS s FROM {L})")
def _(t):
    df = t.loans.selectExpr("application_id", "if(credit_score is null, null, employment_status) AS s")
    return encode.category_codes(df, encode.fit_categories(df, ["s"]))


@query("e9_feature_types", union(
    f"SELECT '{c}' AS \"column\", case when '{SPARK_TYPES[c]}' = 'string' or ('{SPARK_TYPES[c]}' in ('int', 'bigint', 'double') and count(distinct {c}) <= 20) then 'categorical' else 'numerical' end AS kind, "
    f"count(distinct {c}) AS \"distinct\" FROM {L}" for c in ALL if c not in ("application_date", "loan_approved")))
def _(t):
    return encode.feature_types(t.loans, ("application_date", "loan_approved"))


# --- F ------------------------------------------------------------------------------------------

_Z = "(annual_income - 40000e0)"


def _shifted(t):
    return t.loans.selectExpr("application_id", "annual_income - 40000D AS z", "years_employed AS y")


@query("f1_log", f"WITH m AS (SELECT abs(min({_Z})) + 1 AS s FROM {L}) SELECT application_id, round(ln(1 + {_Z} + s), 6) AS z_log, "
       f"round(ln(1 + case when years_employed = 0 then 1e-6 else years_employed end), 6) AS y_log FROM {L}, m")
def _(t):
    df = _shifted(t)
    return rnd(interact.add_math(df, ["z", "y"], ["log"], interact.fit_math(df, ["z", "y"])), 6).drop("z", "y")


@query("f2_powers", f"WITH m AS (SELECT abs(min({_Z})) + 1 AS s FROM {L}) SELECT application_id, round(sqrt({_Z} + s), 6) AS z_sqrt, round({_Z} * {_Z}, 2) AS z_square, "
       f"round(exp(greatest(least({_Z} / 1e5, 50e0), -50e0)), 6) AS w_exp, round(1e0 / case when years_employed = 0 then 1e-6 else years_employed end, 6) AS y_reciprocal FROM {L}, m")
def _(t):
    df = _shifted(t).withColumn("w", F.col("z") / 1e5)
    p = interact.fit_math(df, ["z"])
    out = df.select("application_id", interact.math_feature("z", "sqrt", p).alias("z_sqrt"), interact.math_feature("z", "square", p).alias("z_square"),
                    interact.math_feature("w", "exp", p).alias("w_exp"), interact.math_feature("y", "reciprocal", p).alias("y_reciprocal"))
    return rnd(rnd(out, 2, "z_square"), 6, "z_sqrt", "w_exp", "y_reciprocal")


@query("f2_abs_policy", f"SELECT application_id, round(sqrt(abs({_Z})), 6) AS z_sqrt FROM {L}")
def _(t):
    df = _shifted(t)
    return df.select("application_id", F.round(interact.math_feature("z", "sqrt", interact.fit_math(df, ["z"]), "abs"), 6).alias("z_sqrt"))


@query("f3_custom_math", f"SELECT application_id, round(pow(loan_amount, 1e0 / 3e0), 6) AS loan_amount_cbrt FROM {L}")
def _(t):
    df = t.loans.select("application_id", "loan_amount")
    return rnd(interact.add_math(df, ["loan_amount"], [], interact.MathParams(), custom={"cbrt": F.cbrt}), 6).drop("loan_amount")


_P = ["credit_score", "age", "num_credit_accounts"]


@query("f4_polynomial_interactions", "SELECT application_id, " + ", ".join(f"round(cast({a} * {b} as double), 4) AS {a}__{b}" for a, b in itertools.combinations(_P, 2))
       + f", round(cast({_P[0]} * {_P[1]} * {_P[2]} as double), 4) AS {'__'.join(_P)} FROM {L}")
def _(t):
    return rnd(interact.polynomial(t.loans.select("application_id", *_P), _P, 3), 4).drop(*_P)


@query("f4_polynomial_full", "SELECT application_id, 1e0 AS bias, " + ", ".join(f"round(cast({a} * {b} as double), 4) AS {a}__{b}" for a, b in itertools.combinations_with_replacement(_P, 2)) + f" FROM {L}")
def _(t):
    return rnd(interact.polynomial(t.loans.select("application_id", *_P), _P, 2, False, True), 4).drop(*_P)


_RP = [("loan_amount", "annual_income"), ("monthly_debt_payments", "monthly_income"), ("existing_debt", "annual_income"), ("loan_amount", "property_value")]


@query("f5_ratios", "SELECT application_id, " + ", ".join(
    f"round(coalesce({a} / nullif({b}, 0), (SELECT median({a} / nullif({b}, 0)) FROM {L})), 6) AS {a}_to_{b}_ratio" for a, b in _RP) + f" FROM {L}")
def _(t):
    df = t.loans.select("application_id", *sorted({c for p in _RP for c in p}))
    out = interact.add_ratios(df, _RP, interact.fit_ratios(df, _RP))
    return rnd(out.select("application_id", *[f"{a}_to_{b}_ratio" for a, b in _RP]), 6)


@query("f6_arithmetic", "SELECT application_id, round(annual_income + coapplicant_income, 4) AS annual_income_plus_coapplicant_income, round(annual_income - coapplicant_income, 4) AS annual_income_minus_coapplicant_income, "
       "round(annual_income * coapplicant_income, 4) AS annual_income_times_coapplicant_income, "
       f"round(coalesce(annual_income / nullif(coapplicant_income, 0), (SELECT median(annual_income / nullif(coapplicant_income, 0)) FROM {L})), 6) AS annual_income_div_coapplicant_income FROM {L}")
def _(t):
    pair = [("annual_income", "coapplicant_income")]
    df = t.loans.select("application_id", "annual_income", "coapplicant_income")
    out = interact.add_arithmetic(df, pair, medians=interact.fit_ratios(df, pair)).drop("annual_income", "coapplicant_income")
    n = "annual_income_{}_coapplicant_income"
    return rnd(rnd(out, 4, n.format("plus"), n.format("minus"), n.format("times")), 6, n.format("div"))


@query("f7_domain", f"WITH m AS (SELECT median(nullif(annual_income, 0)) AS mi, median(nullif(total_household_income, 0)) AS mh, median(nullif(loan_amount, 0)) AS ml FROM {L}) "
       "SELECT application_id, round(debt_to_income_ratio * loan_amount / case when annual_income = 0 then mi else annual_income end, 6) AS debt_burden_score, "
       "round(credit_score * credit_history_length / 100e0, 6) AS creditworthiness_score, round(loan_amount / case when total_household_income = 0 then mh else total_household_income end, 6) AS loan_to_income_ratio, "
       f"round(existing_debt + loan_amount, 6) AS total_debt_after_loan, round(property_value / case when loan_amount = 0 then ml else loan_amount end, 6) AS collateral_ratio FROM {L}, m")
def _(t):
    df = t.loans
    return rnd(interact.add_domain(df, interact.fit_domain(df)).select("application_id", *interact.DOMAIN_FORMULAS), 6)


def _sql_cut(c: str, edges: list) -> str:
    parts = [f"when {c} > {a}e0 and {c} <= {b}e0 then {k}" if b != float("inf") else f"when {c} > {a}e0 then {k}" for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    return f"cast(case {' '.join(parts)} end as int)"


_F = "cast(coalesce({}, false) as int)"
_RESP = "(cast(has_bank_account as int) + cast(owns_property as int) + 1 - previous_loan_defaults) / 3e0"
SQL_A = {
    "income_per_year_employed": "annual_income / (years_employed + 1)", "income_consistency": "abs(annual_income - 12 * monthly_income) / nullif(annual_income, 0)",
    "age_credit_ratio": "age / (credit_score / 100e0)", "property_income_ratio": "property_value / (annual_income + 1)",
    "employment_stability": "years_employed / age", "financial_responsibility_score": _RESP,
    "debt_risk_category": _sql_cut("debt_to_income_ratio", [0, 0.2, 0.4, 0.6, 1.0]), "credit_score_tier": _sql_cut("credit_score", [0, 600, 650, 700, 750, 850]),
}
SQL_B = {
    "income_monthly_annual_ratio": "monthly_income * 12 / (annual_income + 1)", "income_consistency_score": "1 / (1 + abs(monthly_income * 12 / (annual_income + 1) - 1))",
    "income_per_work_year": "annual_income / (years_employed + 1)", "income_growth_potential": "annual_income * (years_employed + 1)",
    "income_per_age": "annual_income / age", "income_age_efficiency": "annual_income / (age - 18 + 1)", "debt_safety_margin": "greatest(0, 0.3e0 - debt_to_income_ratio)",
    "debt_income_multiple": "existing_debt / (annual_income + 1)", "debt_payoff_years": "existing_debt / (annual_income * 0.1e0 + 1)",
    "credit_excellence": _F.format("credit_score > 750"), "credit_risk": _F.format("credit_score < 600"), "credit_per_account": "credit_score / (num_credit_accounts + 1)",
    "credit_maturity": "credit_score * credit_history_length", "credit_per_history_year": "credit_score / (credit_history_length + 1)", "age_squared": "age * age", "age_cubed": "age * age * age",
    "employment_stability": "years_employed / age", "career_progress": "years_employed * years_employed / age", "job_hopping_risk": "1 / (years_employed + 1)",
    "has_valuable_property": _F.format("property_value > 100000"), "property_income_leverage": "property_value / (annual_income + 1)", "loan_income_ratio": "loan_amount / (annual_income + 1)",
    "loan_affordability": "annual_income / (loan_amount + 1)", "monthly_payment_estimate": "loan_amount / (loan_term_months + 1)",
    "payment_income_ratio": "loan_amount / (loan_term_months + 1) / (annual_income / 12 + 1)", "bank_loyalty": "least(years_with_bank / 10, 1)",
    "financial_responsibility_score": "(cast(has_bank_account as int) + " + _F.format("years_with_bank > 2") + " + cast(owns_property as int) + 1 - previous_loan_defaults + " + _F.format("credit_score > 650") + ") / 5e0",
    "coapplicant_benefit": "case when has_coapplicant then coapplicant_income else 0 end", "coapplicant_income_contribution": "(total_household_income - annual_income) / (total_household_income + 1)",
    "credit_score_annual_income_interaction": "credit_score * annual_income", "credit_score_age_interaction": "credit_score * age", "annual_income_age_interaction": "annual_income * age",
    "debt_risk_level": _sql_cut("debt_to_income_ratio", [0, 0.1, 0.2, 0.3, 0.4, 1.0]), "credit_tier": _sql_cut("credit_score", [0, 580, 670, 740, 800, 850]),
    "age_maturity": _sql_cut("age", [0, 25, 35, 45, 55, 100]), "property_wealth_tier": _sql_cut("property_value", [0, 50000, 150000, 300000, 500000, float("inf")]),
    "state_area_interaction": "(dense_rank() OVER (ORDER BY state) - 1) * 10 + dense_rank() OVER (ORDER BY area_type) - 1",
}
SQL_C = {
    "income_consistency": "abs(annual_income - monthly_income * 12) / (annual_income + 1)", "income_per_work_year": "annual_income / (years_employed + 1)",
    "low_debt_risk": _F.format("debt_to_income_ratio < 0.3e0"), "high_debt_risk": _F.format("debt_to_income_ratio > 0.5e0"), "excellent_credit": _F.format("credit_score > 750"),
    "good_credit": _F.format("credit_score >= 650 and credit_score <= 750"), "poor_credit": _F.format("credit_score < 600"), "credit_age_ratio": "credit_score / (age + 1)", "age_squared": "age * age",
    "mature_age": _F.format("age > 40"), "young_age": _F.format("age < 30"), "employment_stability": "years_employed / (age + 1)", "has_valuable_property": _F.format("property_value > 100000"),
    "property_income_ratio": "property_value / (annual_income + 1)", "loan_income_ratio": "loan_amount / (annual_income + 1)", "affordable_loan": _F.format("loan_amount / (annual_income + 1) < 2"),
    "financial_responsibility_score": _RESP, "credit_income_product": "credit_score / 100e0 * (annual_income / 10000e0)",
}
SQL_D = {"income_ratio": "annual_income / (monthly_income + 1)", "debt_income_ratio": "existing_debt / (annual_income + 1)", "age_squared": "age * age",
         "credit_age_interaction": "credit_score * age", "age_group": _sql_cut("age", [0, 25, 35, 50, 100]),
         **{f"{a}__{b}": f"cast({a} * {b} as double)" for a, b in itertools.combinations(["age", "credit_score", "loan_term_months"], 2)}}


BIG = {"income_growth_potential", "credit_score_annual_income_interaction", "annual_income_age_interaction", "credit_maturity"}


def _recipe_sql(exprs: dict) -> str:
    return "SELECT application_id, " + ", ".join(f"{f'round({e}, 4)' if k in BIG else e} AS {k}" for k, e in exprs.items()) + f" FROM {L}"


def _recipe(df):
    return df.select(*[F.round(c, 4).alias(c) if c in BIG else F.col(c) for c in df.columns])


@query("f8_recipe_a", _recipe_sql(SQL_A))
def _(t):
    return _recipe(recipes.add_recipe(t.loans, "A").select("application_id", *recipes.recipe_columns("A")))


@query("f9_recipe_b", _recipe_sql(SQL_B))
def _(t):
    df = t.loans
    cats = encode.fit_categories(df, ["state", "area_type"])
    coded = encode.label_codes(df.withColumns({"state_code": F.col("state"), "area_code": F.col("area_type")}),
                               {"state_code": cats["state"], "area_code": cats["area_type"]})
    return _recipe(recipes.add_recipe(coded, "B").select("application_id", *recipes.recipe_columns("B"), "state_area_interaction"))


@query("f10_recipe_c", _recipe_sql(SQL_C))
def _(t):
    return _recipe(recipes.add_recipe(t.loans, "C").select("application_id", *recipes.recipe_columns("C")))


@query("f11_recipe_d", _recipe_sql(SQL_D))
def _(t):
    df = interact.polynomial(t.loans, ["age", "credit_score", "loan_term_months"])
    return _recipe(recipes.add_recipe(df, "D").select("application_id", *recipes.recipe_columns("D"), "age__credit_score", "age__loan_term_months", "credit_score__loan_term_months"))


_API = ("SELECT o_orderkey, case when o_orderkey % 9 < 5 then 'Male' else 'Female' end AS Gender, case when o_orderkey % 3 = 0 then 'Yes' else 'No' end AS Married, "
        "case o_orderkey % 4 when 3 then '3+' when 2 then '2' when 1 then '1' else '0' end AS Dependents, case when o_orderkey % 5 < 3 then 'Graduate' else 'Not Graduate' end AS Education, "
        "case when o_orderkey % 7 = 0 then 'Yes' else 'No' end AS Self_Employed, case when o_orderkey % 50 = 0 then 0e0 else o_totalprice / 4e0 end AS ApplicantIncome, "
        "case when o_orderkey % 10 < 3 and o_orderkey % 50 <> 0 then o_totalprice / 9e0 else 0e0 end AS CoapplicantIncome, o_totalprice / 1000e0 AS LoanAmount, "
        "cast(12 * (o_orderkey % 6) as double) AS Loan_Amount_Term, cast(case when o_orderkey % 6 = 0 then 0 else 1 end as double) AS Credit_History, "
        "case o_orderkey % 3 when 0 then 'Urban' when 1 then 'Semiurban' else 'Rural' end AS Property_Area FROM orders")


def api_records(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(_API)


_INC = "(ApplicantIncome + CoapplicantIncome)"
_API_SQL = {
    "credit_score": f"650 + least({_INC} / 100000, 2) * 100 + Credit_History * 50 + case when Education = 'Graduate' then 25 else 0 end", "annual_income": _INC, "loan_amount": "LoanAmount",
    "debt_to_income_ratio": f"case when {_INC} > 0 then LoanAmount * 12 / {_INC} else 0 end", "years_employed": f"greatest(1, 30 + ({_INC} - 40000) / 10000 - 22)", "age": f"30 + ({_INC} - 40000) / 10000",
    "monthly_debt_payments": "case when Loan_Amount_Term > 0 then LoanAmount / Loan_Amount_Term else 0 end", "number_of_dependents": "case when Dependents = '3+' then 3 else cast(Dependents as int) end",
    "property_value": "LoanAmount * 1.5e0 * case Property_Area when 'Urban' then 1.5e0 when 'Semiurban' then 1.2e0 else 1e0 end", "loan_term": "Loan_Amount_Term",
    "employment_status_score": "case when Self_Employed = 'Yes' then 1 else 0 end", "education_level_score": "case when Education = 'Graduate' then 1 else 0 end", "marital_status_score": "case when Married = 'Yes' then 1 else 0 end",
    "payment_history_score": "Credit_History", "account_balance_score": f"least({_INC} / 50000, 2)",
}


@query("f12_api_features", f"WITH a AS ({_API}) SELECT o_orderkey, " + ", ".join(f"cast({e} as double) AS {k}" for k, e in _API_SQL.items()) + " FROM a", loans=False)
def _(t):
    return recipes.api_features(api_records(t), ("o_orderkey",))


# --- R ------------------------------------------------------------------------------------------

@query("r1_low_variance", union(f"SELECT '{c}' AS \"column\", round(var_samp({c} / 1000e0), 6) AS variance, var_samp({c} / 1000e0) > 0.01e0 AS keep FROM {L}" for c in NUMERIC))
def _(t):
    df = t.loans.select(*[(F.col(c) / 1000.0).alias(c) for c in NUMERIC])
    return rnd(select.low_variance(df, NUMERIC), 6)


@query("r1_low_variance_population", union(f"SELECT '{c}' AS \"column\", round(var_pop({c} / 1000e0), 6) AS variance, var_pop({c} / 1000e0) > 0.01e0 AS keep FROM {L}" for c in NUMERIC))
def _(t):
    df = t.loans.select(*[(F.col(c) / 1000.0).alias(c) for c in NUMERIC])
    return rnd(select.low_variance(df, NUMERIC, population=True), 6)


@query("r2_correlated", "WITH p AS (" + union(
    f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) > 0.9e0 AS hit FROM {L}" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]) + ") SELECT DISTINCT b AS dropped FROM p WHERE hit")
def _(t):
    return params_frame(t.spark, [(c,) for c in select.correlated(t.loans, NUMERIC, 0.9)], "dropped string")


@query("r3_cap_features", f"SELECT \"column\" FROM (SELECT \"column\", row_number() OVER (ORDER BY v DESC, \"column\") AS r FROM (" + union(
    f"SELECT '{a}__{b}' AS \"column\", var_samp(cast({a} * {b} as double)) AS v FROM {L}" for a, b in itertools.combinations(_P, 2)) + ")) WHERE r <= 2 UNION ALL "
       + union(f"SELECT '{c}'" for c in _P))
def _(t):
    df = interact.polynomial(t.loans.select(*_P), _P)
    return params_frame(t.spark, [(c,) for c in select.cap_features(df, _P, ["__".join(p) for p in itertools.combinations(_P, 2)], 5)], "column string")


_RC = ["annual_income", "debt_to_income_ratio", "loan_amount", "credit_history_length", "existing_debt"]


def _mi(c: str) -> str:
    q = ", ".join(str(p / 10) for p in range(1, 10))
    code = " + ".join(f"case when {c} >= q[{k}] and q[{k}] > {'q0' if k == 1 else f'q[{k - 1}]'} and q[{k}] < q1 then 1 else 0 end" for k in range(1, 10))
    return (f"SELECT '{c}' AS \"column\", sum(n * 1e0 / nt * ln(n * 1e0 * nt / (nb * nl))) AS score FROM (SELECT *, sum(n) OVER () AS nt, sum(n) OVER (PARTITION BY bin) AS nb, sum(n) OVER (PARTITION BY loan_approved) AS nl FROM "
            f"(SELECT case when {c} is null then -1 else {code} end AS bin, loan_approved, count(*) AS n FROM {L}, (SELECT quantile_cont({c}, [{q}]) AS q, min({c}) AS q0, max({c}) AS q1 FROM {L}) GROUP BY ALL))")


@query("r4_mutual_information", "SELECT \"column\", round(score, 6) AS score FROM (" + union(_mi(c) for c in NUMERIC) + ")")
def _(t):
    return rnd(select.mutual_information(t.loans, NUMERIC, "loan_approved"), 6)


@query("r5_anova_f", "SELECT \"column\", round(sum(n * (m - gm) * (m - gm)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 3) AS score FROM (" + union(
    f"SELECT '{c}' AS \"column\", loan_approved, count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM {L}) AS gm FROM {L} WHERE {c} IS NOT NULL GROUP BY loan_approved" for c in NUMERIC) + ") GROUP BY \"column\"")
def _(t):
    return rnd(select.anova_f(t.loans, NUMERIC, "loan_approved"), 3)


@query("r6_chi_square", "SELECT \"column\", round(sum((o - e) * (o - e) / e), 2) AS score FROM (SELECT *, n * 1e0 / sum(n) OVER (PARTITION BY \"column\") * sum(o) OVER (PARTITION BY \"column\") AS e FROM (" + union(
    f"SELECT '{c}' AS \"column\", loan_approved, count(*) AS n, sum(coalesce(cast({c} as double), 0e0) - least(0e0, (SELECT min({c}) FROM {L}))) AS o FROM {L} GROUP BY loan_approved" for c in NUMERIC) + ")) GROUP BY \"column\"")
def _(t):
    return rnd(select.chi_square(t.loans, NUMERIC, "loan_approved"), 2)


@query("r5_select_best", "SELECT \"column\" FROM (SELECT \"column\", sum(n * (m - gm) * (m - gm)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))) AS f FROM (" + union(
    f"SELECT '{c}' AS \"column\", loan_approved, count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM {L}) AS gm FROM {L} WHERE {c} IS NOT NULL GROUP BY loan_approved" for c in NUMERIC) + ") GROUP BY \"column\") ORDER BY floor(log10(f)) DESC, round(f / pow(10, floor(log10(f))), 8) DESC, \"column\" LIMIT 5")
def _(t):
    return params_frame(t.spark, [(c,) for c in select.select_best(t.loans, NUMERIC, "loan_approved", k=5, score="f_classif")], "column string")


# --- P ------------------------------------------------------------------------------------------

@query("p1_sample", f"SELECT application_id, annual_income FROM lab ORDER BY {h()}, application_id LIMIT 500")
def _(t):
    return split.sample_rows(t.lab.select("application_id", "annual_income"), 500, "application_id")


@query("p2_stratified_split", f"SELECT application_id, loan_approved, case when rn <= floor(cnt * 0.2e0) then 'test' when rn <= floor(cnt * (0.2e0 + 0.1e0)) then 'val' else 'train' end AS split FROM "
       f"(SELECT *, row_number() OVER (PARTITION BY loan_approved ORDER BY {h()}) AS rn, count(*) OVER (PARTITION BY loan_approved) AS cnt FROM lab)")
def _(t):
    return split.stratified_split(t.lab.select("application_id", "loan_approved"), "application_id", "loan_approved", 0.2, 0.1)


@query("p3_random_split", f"SELECT application_id, case when {frac(h())} < 0.25e0 then 'test' else 'train' end AS split FROM lab")
def _(t):
    return split.random_split(t.lab.select("application_id"), "application_id", 0.25)


@query("p4_kfold", f"SELECT application_id, cast((row_number() OVER (ORDER BY {h()}) - 1) % 5 as int) AS fold FROM lab")
def _(t):
    return split.kfold(t.lab.select("application_id"), "application_id")


@query("p4_stratified_kfold", f"SELECT application_id, loan_approved, cast((row_number() OVER (PARTITION BY loan_approved ORDER BY {h()}) - 1) % 5 as int) AS fold FROM lab")
def _(t):
    return split.kfold(t.lab.select("application_id", "loan_approved"), "application_id", 5, "loan_approved")


@query("p5_time_splits", "WITH r AS (SELECT application_id, row_number() OVER (ORDER BY application_date, application_id) AS rn, count(*) OVER () AS n FROM lab), k AS (SELECT unnest(range(0, 4)) AS split), "
       "x AS (SELECT application_id, cast(split as int) AS split, case when rn > n - (4 - split) * (n // 5) and rn <= n - (4 - split) * (n // 5) + n // 5 then 'test' "
       "when rn <= n - (4 - split) * (n // 5) - 10 and rn > greatest(0, n - (4 - split) * (n // 5) - 10 - 5000) then 'train' end AS role FROM r, k) SELECT * FROM x WHERE role IS NOT NULL")
def _(t):
    return split.time_splits(t.lab.select("application_id", "application_date"), ["application_date", "application_id"], 4, gap=10, max_train=5000).select("application_id", "split", "role")


@query("p6_lightest_folds", "WITH RECURSIVE s AS (SELECT l_suppkey, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS rn FROM lineitem GROUP BY l_suppkey), "
       "g AS (SELECT 0::bigint AS rn, [0, 0, 0, 0, 0]::bigint[] AS loads, NULL::int AS fold UNION ALL "
       "SELECT s.rn, list_transform(g.loads, lambda x, i: x + CASE WHEN i = list_position(g.loads, list_min(g.loads)) THEN s.size ELSE 0 END), "
       "(list_position(g.loads, list_min(g.loads)) - 1)::int FROM g JOIN s ON s.rn = g.rn + 1) "
       "SELECT l_orderkey, l_linenumber, l_suppkey, fold FROM lineitem JOIN s USING (l_suppkey) JOIN g USING (rn)", loans=False)
def _(t):
    return split.group_kfold(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", lightest=True)


@query("p6_group_kfold", "WITH s AS (SELECT o_custkey, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1 AS pos FROM orders GROUP BY o_custkey) "
       "SELECT o_orderkey, o_custkey, cast(case when (pos // 5) % 2 = 0 then pos % 5 else 4 - pos % 5 end as int) AS fold FROM orders JOIN s USING (o_custkey)", loans=False)
def _(t):
    return split.group_kfold(t.orders.select("o_orderkey", "o_custkey"), "o_custkey")


@query("p7_shuffle_splits", f"SELECT application_id, cast(repeat as int) AS repeat, case when rn <= floor(cnt * 0.2e0) then 'test' else 'train' end AS split FROM (SELECT *, row_number() OVER (PARTITION BY repeat, loan_approved ORDER BY "
       "md5(concat(cast(application_id as varchar), '-42-', cast(repeat as varchar)))) AS rn, count(*) OVER (PARTITION BY repeat, loan_approved) AS cnt FROM lab, (SELECT unnest(range(0, 3)) AS repeat))")
def _(t):
    return split.shuffle_splits(t.lab.select("application_id", "loan_approved"), "application_id", 3, 0.2, "loan_approved").drop("loan_approved")
