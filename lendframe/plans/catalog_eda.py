"""Queries: exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendframe.operators import eda
from lendframe.plans.registry import query
from lendframe.sources.loans import BOOLEAN, CATEGORICAL, FIELDS, NUMERIC

ALL = FIELDS + ["loan_approved"]
SPARK_TYPES = {"application_id": "bigint", "loan_approved": "int", "application_date": "timestamp_ntz"}
for _c in NUMERIC:
    SPARK_TYPES[_c] = "double"
for _c in ("age", "num_credit_accounts", "loan_term_months", "previous_loans", "previous_loan_defaults"):
    SPARK_TYPES[_c] = "int"
for _c in CATEGORICAL:
    SPARK_TYPES[_c] = "string"
for _c in BOOLEAN:
    SPARK_TYPES[_c] = "boolean"


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def rnd(df, digits, *cols):
    """Round the named columns (default: all doubles)."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("a1_column_profile", union(
    f"SELECT '{c}' AS \"column\", '{SPARK_TYPES[c]}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
    f"round((count(*) - count({c})) * 100e0 / count(*), 2) AS null_pct FROM loan_applications" for c in ALL))
def _(t):
    return eda.column_profile(t.loans)


def _desc(c: str) -> str:
    q = lambda p: f"round(quantile_cont(cast({c} as double), {p}), 2)"
    return (f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg(cast({c} as double)), 2) AS mean, "
            f"round(stddev_samp(cast({c} as double)), 2) AS std, round(cast(min({c}) as double), 2) AS min, "
            f"{q(0.25)} AS q25, {q(0.5)} AS q50, {q(0.75)} AS q75, round(cast(max({c}) as double), 2) AS max "
            "FROM loan_applications")


@query("a2_describe", union(_desc(c) for c in NUMERIC))
def _(t):
    return eda.describe(t.loans, NUMERIC)


@query("a3_category_counts", union(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS cnt, "
    f"round(count(*) * 100e0 / (SELECT count({c}) FROM loan_applications), 4) AS pct FROM loan_applications "
    f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in CATEGORICAL))
def _(t):
    return eda.category_counts(t.loans, CATEGORICAL)


@query("a3_top_values",
       "SELECT loan_purpose AS value, count(*) AS cnt, round(count(*) * 100e0 / (SELECT count(*) FROM loan_applications), 4) AS pct "
       "FROM loan_applications GROUP BY loan_purpose ORDER BY cnt DESC, value LIMIT 5")
def _(t):
    return eda.value_counts(t.loans, "loan_purpose", top=5)


@query("a4_target_distribution",
       "SELECT cast(loan_approved as varchar) AS value, count(*) AS cnt, "
       "round(count(*) * 100e0 / (SELECT count(*) FROM loan_applications), 4) AS pct FROM loan_applications GROUP BY loan_approved")
def _(t):
    return eda.value_counts(t.loans, "loan_approved")


_PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]]


@query("a5_correlation_matrix", "SELECT column_a, column_b, round(r, 6) AS r FROM (" + union(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM loan_applications" for a, b in _PAIRS) + ")")
def _(t):
    return rnd(eda.correlation_matrix(t.loans, NUMERIC), 6)


@query("a5_correlation_with_target",
       "SELECT \"column\", round(r, 6) AS r, round(abs(r), 6) AS abs_r, case when r > 0 then 'positive' else 'negative' end AS direction FROM ("
       + union(f"SELECT '{c}' AS \"column\", corr({c}, loan_approved) AS r FROM loan_applications" for c in NUMERIC) + ")")
def _(t):
    return rnd(eda.correlation_with(t.loans, "loan_approved", NUMERIC), 6)


_AMOUNTS = ["annual_income", "loan_amount", "existing_debt", "credit_score"]


def _trim(lo: str, hi: str, pa: float, pb: float) -> str:
    return union(
        f"SELECT '{c}' AS \"column\", count({c}) AS kept, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median "
        f"FROM loan_applications, (SELECT quantile_cont({c}, {pa}) AS a, quantile_cont({c}, {pb}) AS b FROM loan_applications) q "
        f"WHERE {c} BETWEEN {lo} AND {hi}" for c in _AMOUNTS)


@query("a6_trimmed_iqr", _trim("a - 1.5e0 * (b - a)", "b + 1.5e0 * (b - a)", 0.25, 0.75))
def _(t):
    return rnd(eda.trimmed_stats(t.loans, _AMOUNTS), 4)


@query("a6_trimmed_percentile", _trim("a", "b", 0.05, 0.95))
def _(t):
    return rnd(eda.trimmed_stats(t.loans, _AMOUNTS, "percentile"), 4)


@query("a6_histogram",
       "WITH b AS (SELECT min(loan_amount) AS lo, max(loan_amount) AS hi FROM loan_applications), "
       "x AS (SELECT least(cast(floor((loan_amount - lo) / ((hi - lo) / 30)) as bigint), 29) AS bin, lo, (hi - lo) / 30 AS w FROM loan_applications, b) "
       "SELECT bin, count(*) AS cnt, round(min(lo) + bin * min(w), 8) AS left_edge FROM x GROUP BY bin")
def _(t):
    return rnd(eda.histogram(t.loans, "loan_amount", 30), 8)


@query("a7_t_tests",
       "WITH s AS (" + union(
           f"SELECT '{c}' AS \"column\", count(case when loan_approved = 0 then {c} end) AS n0, count(case when loan_approved = 1 then {c} end) AS n1, "
           f"avg(case when loan_approved = 0 then {c} end) AS m0, avg(case when loan_approved = 1 then {c} end) AS m1, "
           f"var_samp(case when loan_approved = 0 then {c} end) AS v0, var_samp(case when loan_approved = 1 then {c} end) AS v1 "
           "FROM loan_applications" for c in NUMERIC) + ") "
       "SELECT \"column\", n0, n1, round(m0, 4) AS mean0, round(m1, 4) AS mean1, "
       "round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1e0 / n0 + 1e0 / n1)), 6) AS t FROM s")
def _(t):
    df = eda.class_t_tests(t.loans, NUMERIC, "loan_approved").select("column", "n0", "n1", "mean0", "mean1", "t")
    return df.select("column", "n0", "n1", F.round("mean0", 4).alias("mean0"), F.round("mean1", 4).alias("mean1"),
                     F.round("t", 6).alias("t"))


@query("a7_t_tests_with_p")
def _(t):
    return rnd(eda.class_t_tests(t.loans, NUMERIC, "loan_approved"), 6)


@query("a8_crosstab",
       "SELECT employment_status, round(avg(case when loan_approved = 0 then 1e0 else 0e0 end), 6) AS share_0, "
       "round(avg(case when loan_approved = 1 then 1e0 else 0e0 end), 6) AS share_1 FROM loan_applications GROUP BY employment_status")
def _(t):
    return eda.crosstab_share(t.loans, "employment_status", "loan_approved")


def _box(c: str) -> str:
    return (f"SELECT '{c}' AS \"column\", loan_approved AS label, q[1] AS q25, q[2] AS q50, q[3] AS q75, "
            f"min(case when {c} >= q[1] - 1.5e0 * (q[3] - q[1]) then {c} end) AS whisker_lo, "
            f"max(case when {c} <= q[3] + 1.5e0 * (q[3] - q[1]) then {c} end) AS whisker_hi, "
            f"count(case when {c} < q[1] - 1.5e0 * (q[3] - q[1]) or {c} > q[3] + 1.5e0 * (q[3] - q[1]) then 1 end) AS outliers "
            f"FROM loan_applications JOIN (SELECT loan_approved AS k, quantile_cont({c}, [0.25, 0.5, 0.75]) AS q "
            "FROM loan_applications GROUP BY loan_approved) ON k = loan_approved GROUP BY loan_approved, q")


@query("a9_box_numbers",
       "SELECT \"column\", label, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, "
       "round(whisker_lo, 4) AS whisker_lo, round(whisker_hi, 4) AS whisker_hi, outliers FROM (" + union(_box(c) for c in _AMOUNTS) + ")")
def _(t):
    return rnd(eda.box_numbers(t.loans, _AMOUNTS, "loan_approved"), 4)


_D = len(ALL)


@query("a10_completeness_totals",
       f"SELECT count(*) * {_D} AS cells, {' + '.join(f'count(*) - count({c})' for c in ALL)} AS missing, "
       f"round((count(*) * {_D} - ({' + '.join(f'count(*) - count({c})' for c in ALL)})) * 100e0 / (count(*) * {_D}), 4) AS completeness_pct "
       "FROM loan_applications")
def _(t):
    return eda.completeness_totals(t.loans)


@query("q9_feature_quality", union(
    f"SELECT '{c}' AS \"column\", '{SPARK_TYPES[c]}' AS dtype, count(distinct {c}) AS unique_values, "
    f"round((count(*) - count({c})) * 100e0 / count(*), 2) AS missing_pct, round(count(distinct {c}) * 1e0 / count(*), 4) AS unique_ratio, "
    f"round(100e0 - (count(*) - count({c})) * 100e0 / count(*) - case when count(distinct {c}) * 1e0 / count(*) > 0.95e0 and '{SPARK_TYPES[c]}' = 'string' then 10e0 else 0e0 end, 1) AS quality_score "
    "FROM loan_applications" for c in ALL if c != "application_date"))
def _(t):
    return eda.feature_quality(t.loans)
