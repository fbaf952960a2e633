"""Queries: sources and sinks, compositions, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendframe.operators import select
from lendframe.operators.stats import column_stats, params_frame
from lendframe.plans.catalog_eda import rnd
from lendframe.plans.catalog_rules import _ALL as _ALL_RULES
from lendframe.plans.feature_set import LOAN_FEATURES, FeatureConfig, FeatureSet
from lendframe.plans.preprocess import PreprocessConfig, Preprocessing
from lendframe.plans.registry import query
from lendframe.plans.validated_load import row_counts, validated_load
from lendframe.session import saved, scratch_path
from lendframe.sources import files
from lendframe.sources.loans import NUMERIC, loan_applications
from lendframe.streaming import flows

L = "loan_applications"


@query("s1_csv_scan", "SELECT o_orderkey, o_totalprice, o_orderdate, o_orderpriority FROM orders", loans=False)
def _(t):
    path = scratch_path(t.spark, "orders-csv")
    files.write_table(t.orders.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"), path, "csv")
    return files.read_csv(t.spark, path, "o_orderkey bigint, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")


@query("s1_csv_inferred", f"SELECT application_id, age, gender, credit_score, owns_property, loan_amount, application_date FROM {L}")
def _(t):
    """The whole loan table through CSV files, with inferred types and a parsed date."""
    path = scratch_path(t.spark, "loans-csv")
    files.write_table(t.loans.withColumn("application_date", F.date_format("application_date", "yyyy-MM-dd HH:mm:ss")), path, "csv")
    df = files.read_csv(t.spark, path)
    return df.select(F.col("application_id").cast("bigint"), "age", "gender", "credit_score", "owns_property", "loan_amount",
                     F.col("application_date").cast("timestamp_ntz").alias("application_date"))


@query("s2_table_sink", f"SELECT loan_purpose, count(*) AS n, round(avg(loan_amount), 4) AS mean_amount FROM {L} GROUP BY loan_purpose")
def _(t):
    path = scratch_path(t.spark, "by-purpose")
    out = t.loans.groupBy("loan_purpose").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loan_amount"), 4).alias("mean_amount"))
    files.write_table(out, path, "parquet", partition_by=("loan_purpose",))
    return t.spark.read.parquet(path)


@query("s4_json_sessions", "SELECT user_id AS session_id, min(ts) AS start_time, count(*) AS steps FROM events GROUP BY user_id", loans=False)
def _(t):
    path = scratch_path(t.spark, "sessions-json")
    s = t.events.groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("start_time"), F.count(F.lit(1)).alias("steps"))
    files.write_table(s, path, "json")
    return files.read_sessions(t.spark, path, schema="session_id bigint, start_time timestamp_ntz, steps bigint", multi_line=False)


@query("s4_multiline_sessions", "SELECT user_id % 50 AS session_id, min(ts) AS start_time, count(*) AS steps FROM events GROUP BY user_id % 50", loans=False)
def _(t):
    """One JSON document over several lines a file, many files, read by a pattern and sorted by start."""
    path = scratch_path(t.spark, "sessions")
    s = t.events.groupBy((F.col("user_id") % 50).alias("session_id")).agg(F.min("ts").alias("start_time"), F.count(F.lit(1)).alias("steps"))
    doc = F.to_json(F.struct("session_id", F.col("start_time").cast("string").alias("start_time"), "steps"), {"pretty": "true"})
    # one file a session: these documents are few by nature (50 here)
    s.select("session_id", doc.alias("value")).withColumn("part", F.col("session_id")).repartition("part").select("value", "part").write.partitionBy("part").text(path)
    return files.read_sessions(t.spark, f"{path}/part=*", schema="session_id bigint, start_time timestamp_ntz, steps bigint")


_W1 = ["annual_income", "loan_amount", "credit_score"]


@query("w1_preprocess", f"WITH q AS (SELECT " + ", ".join(
    f"median({c}) AS md_{c}, avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, quantile_cont({c}, 0.25) - 1.5e0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
    f"quantile_cont({c}, 0.75) + 1.5e0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}" for c in _W1) + f" FROM {L}) SELECT application_id, "
    + ", ".join(f"round((least(greatest(coalesce({c}, md_{c}), lo_{c}), hi_{c}) - m_{c}) / s_{c}, 6) AS {c}" for c in _W1) + " FROM lab, q")
def _(t):
    df = t.loans.select("application_id", *_W1)
    p = Preprocessing(PreprocessConfig(steps=("duplicates", "missing", "outliers", "scaling")))
    return rnd(p.fit_transform(df), 6)


@query("w1_preprocess_all_steps")
def _(t):
    p = Preprocessing(PreprocessConfig(target="loan_approved", exclude=("application_date",), fit_mode="sequential"))
    out = p.fit_transform(t.loans)
    return out.agg(F.count(F.lit(1)).alias("rows"), *[F.round(F.avg(c), 6).alias(c) for c in ("annual_income", "credit_score", "age")])


_W1C = [c for c in NUMERIC]


@query("w1_preprocess_rows", "WITH f AS (SELECT * REPLACE (" + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM lab)) AS {c}" for c in ("years_employed", "credit_score", "property_value"))
       + ") FROM lab), q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in _W1C) + " FROM f), c AS (SELECT application_id, gender, loan_approved, "
       + ", ".join(f"least(greatest(cast({c} as double), a_{c} - 1.5e0 * (b_{c} - a_{c})), b_{c} + 1.5e0 * (b_{c} - a_{c})) AS {c}" for c in _W1C)
       + " FROM f, q), m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, case when stddev_pop({c}) = 0 then 1e0 else stddev_pop({c}) end AS s_{c}" for c in _W1C)
       + " FROM c) SELECT application_id, gender, loan_approved, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _W1C) + " FROM c, m")
def _(t):
    """Every row after all steps, each fitted on the output of the one before."""
    p = Preprocessing(PreprocessConfig(target="loan_approved", exclude=("application_date",), fit_mode="sequential"))
    return rnd(p.fit_transform(t.loans).select("application_id", "gender", "loan_approved", *_W1C), 6)


_W2 = FeatureConfig(one_hot=["gender"], target=["loan_purpose"], ordinal={"education": ["High School", "Some College", "Bachelor's", "Advanced"]},
                    numeric=["annual_income", "credit_score"], outlier_columns=["annual_income"], outlier_threshold=2.0, scaling="robust",
                    arithmetic=[("annual_income", "credit_score")])


def _rob(c, x):
    return f"({x} - md_{c}) / (b_{c} - a_{c})"


_AI = _rob("annual_income", "least(greatest(annual_income, a_annual_income - 2e0 * (b_annual_income - a_annual_income)), b_annual_income + 2e0 * (b_annual_income - a_annual_income))")
_CS = _rob("credit_score", "coalesce(credit_score, md_credit_score)")


@query("w2_feature_set", "WITH q AS (SELECT " + ", ".join(f"median({c}) AS md_{c}, quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in ("annual_income", "credit_score"))
       + f" FROM {L}), g AS (SELECT avg(loan_approved) AS g FROM {L}), e AS (SELECT loan_purpose AS lp, (sum(loan_approved) + min(g)) / (count(*) + 1e0) AS enc FROM {L}, g GROUP BY loan_purpose), "
       f"x AS (SELECT application_id, loan_approved, gender, education, enc, {_AI} AS ai, {_CS} AS cs FROM {L} JOIN e ON lp = loan_purpose, q) "
       "SELECT application_id, loan_approved, round(ai, 6) AS annual_income, round(cs, 6) AS credit_score, round(enc, 6) AS loan_purpose_target, "
       "cast(case education when 'High School' then 0 when 'Some College' then 1 when 'Bachelor''s' then 2 else 3 end as int) AS education_ordinal, cast(case when gender = 'Male' then 1 else 0 end as int) AS \"gender_Male\", "
       "cast(case when gender = 'Female' then 1 else 0 end as int) AS \"gender_Female\", round(ai + cs, 6) AS annual_income_plus_credit_score, round(ai - cs, 6) AS annual_income_minus_credit_score, "
       "round(ai * cs, 6) AS annual_income_times_credit_score, round(coalesce(ai / nullif(cs, 0), (SELECT median(ai / nullif(cs, 0)) FROM x)), 6) AS annual_income_div_credit_score FROM x")
def _(t):
    df = t.loans.select("application_id", "loan_approved", "gender", "education", "loan_purpose", "annual_income", "credit_score")
    return rnd(FeatureSet(_W2).fit(df).transform(df), 6)


@query("w5_loan_feature_set")
def _(t):
    df = t.loans
    f = FeatureSet(LOAN_FEATURES).fit(df)
    return f.transform(df)


def _w5_sql() -> str:
    """The default feature set in SQL: every generated feature, and its mean, variance and binned mutual information."""
    c = LOAN_FEATURES
    used = list(dict.fromkeys([*c.numeric, *c.polynomial, *[x for p in c.ratios + c.arithmetic for x in p]]))
    stats = list(dict.fromkeys([*used, *c.outlier_columns]))
    q = ", ".join(f"quantile_cont({x}, 0.25) AS a_{x}, median({x}) AS d_{x}, quantile_cont({x}, 0.75) AS b_{x}" for x in stats)

    def base(x):
        v = f"coalesce(cast({x} as double), d_{x})"
        if x in c.outlier_columns:
            v = f"least(greatest({v}, a_{x} - {c.outlier_threshold}e0 * (b_{x} - a_{x})), b_{x} + {c.outlier_threshold}e0 * (b_{x} - a_{x}))"
        return f"({v} - d_{x}) / (case when b_{x} = a_{x} then 1e0 else b_{x} - a_{x} end)" if x in c.numeric else v
    text = sorted({*c.one_hot, *c.target, *c.label, *c.ordinal})
    rat = lambda a, b: f"({a} / nullif({b}, 0))"
    pairs = list(dict.fromkeys(c.ratios + c.arithmetic))
    views = [f"q AS (SELECT avg(loan_approved) AS g, {q} FROM {L})",
             f"b AS MATERIALIZED (SELECT application_id, loan_approved, {', '.join(text)}, {', '.join(f'{base(x)} AS {x}' for x in used)} FROM {L}, q)",
             "r AS (SELECT " + ", ".join(f"median({rat(x, y)}) AS \"{x}/{y}\"" for x, y in pairs) + ", coalesce(median(nullif(annual_income, 0)), 1e0) AS ai FROM b)"]
    views += [f"t_{x} AS (SELECT {x} AS v, (sum(loan_approved) + min(g)) / (count(*) + 1e0) AS e FROM {L}, q GROUP BY {x})" for x in c.target]
    ratio = lambda x, y: f"coalesce({rat('b.' + x, 'b.' + y)}, r.\"{x}/{y}\")"
    f = {x: f"b.{x}" for x in used}
    f |= {f"{x}_target": f"t_{x}.e" for x in c.target}
    f |= {f"{x}_label": f"(SELECT count(DISTINCT {x}) FROM {L} z WHERE z.{x} < b.{x})" for x in c.label}
    f |= {f"{x}_ordinal": "case b." + x + "".join(f" when '{v.replace(chr(39), chr(39) * 2)}' then {i}" for i, v in enumerate(vs)) + " else -1 end" for x, vs in c.ordinal.items()}
    p1, p2 = c.polynomial
    f[f"{p1}__{p2}"] = f"b.{p1} * b.{p2}"
    f |= {f"{x}_to_{y}_ratio": ratio(x, y) for x, y in c.ratios}
    for x, y in c.arithmetic:
        f |= {f"{x}_plus_{y}": f"b.{x} + b.{y}", f"{x}_minus_{y}": f"b.{x} - b.{y}", f"{x}_times_{y}": f"b.{x} * b.{y}", f"{x}_div_{y}": ratio(x, y)}
    d = "case when b.annual_income = 0 then r.ai else b.annual_income end"
    f |= {"debt_burden_score": f"b.debt_to_income_ratio * b.loan_amount / ({d})", "creditworthiness_score": "b.credit_score * b.credit_history_length / 100e0"}
    joins = "".join(f" JOIN t_{x} ON t_{x}.v = b.{x}" for x in c.target)
    plain = " UNION ALL ".join(f"SELECT '{k}' AS feature, cast(\"{k}\" as double) AS x, y FROM wide" for k in f)
    hot = " UNION ALL ".join(f"SELECT '{x}_' || v.v || v.again AS feature, cast(case when b.{x} = v.v then 1 else 0 end as double) AS x, b.loan_approved AS y FROM b, (SELECT v, case when row_number() OVER w > 1 then '_' || row_number() OVER w else '' end AS again FROM (SELECT DISTINCT {x} AS v FROM {L} WHERE {x} IS NOT NULL) WINDOW w AS (PARTITION BY lower(v) ORDER BY v)) v" for x in c.one_hot)
    views += [f"wide AS MATERIALIZED (SELECT b.loan_approved AS y, {', '.join(f'{e} AS {chr(34)}{k}{chr(34)}' for k, e in f.items())} FROM b{joins}, r)",
              f"cells AS MATERIALIZED ({plain} UNION ALL {hot})",
              "m AS (SELECT feature, avg(x) AS mean, var_pop(x) AS variance, quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS e FROM cells GROUP BY feature)",
              "ed AS (SELECT feature, mean, variance, list_sort(list_distinct(e))[2:-2] AS e FROM m)",
              "n AS (SELECT feature, len(list_filter(e, lambda v: cells.x >= v)) AS bin, y, count(*) AS n FROM cells JOIN ed USING (feature) GROUP BY ALL)",
              "nb AS (SELECT feature, bin, sum(n) AS nb FROM n GROUP BY ALL)", "nl AS (SELECT feature, y, sum(n) AS nl FROM n GROUP BY ALL)", "nt AS (SELECT feature, sum(n) AS nt FROM n GROUP BY ALL)",
              "s AS (SELECT feature, sum(n / nt * ln(n * 1e0 * nt / (nb * 1e0 * nl))) AS score FROM n JOIN nb USING (feature, bin) JOIN nl USING (feature, y) JOIN nt USING (feature) GROUP BY feature)"]
    return "WITH " + ", ".join(views) + " SELECT feature, round(mean, 6) AS mean, round(variance, 6) AS variance, round(score, 6) AS score FROM ed JOIN s USING (feature)"


@query("w5_feature_report", _w5_sql())
def _(t):
    """Mean, variance and score of every feature of the default set, before the selection."""
    f = FeatureSet(LOAN_FEATURES).fit(t.loans)
    full = saved(f.features(t.loans), "loan-features")
    st = column_stats(full, f.generated, quantiles=())
    moments = params_frame(t.spark, [(c, s.mean, s.std_pop ** 2) for c, s in st.items()], "feature string, mean double, variance double")
    score = select.mutual_information(full, f.generated, "loan_approved", counts={c: s.count for c, s in st.items()})
    return rnd(moments.join(score.withColumnRenamed("column", "feature"), "feature"), 6)


@query("w4_validated_load", f"SELECT application_id, age, least(greatest(debt_to_income_ratio, 0e0), 1e0) AS debt_to_income_ratio, coalesce(property_value, 0e0) AS property_value, "
       f"greatest(loan_amount, 1000e0) AS loan_amount FROM {L}")
def _(t):
    return validated_load(t.loans).cleaned.select("application_id", "age", "debt_to_income_ratio", "property_value", "loan_amount")


@query("w4_row_counts")
def _(t):
    return row_counts(validated_load(t.loans))


# --- streams: all files of the table, processed once, same numbers as the batch form ------------

_CONF = "abs(2e0 * least(value / 50e0, 1e0) - 1e0)"


@query("k11_stream_windows", f"SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(avg({_CONF}), 6) AS mean_confidence FROM events GROUP BY ALL", loans=False)
def _(t):
    s = flows.table_stream(t.spark, f"{t.dir}/events*.parquet")
    s = s.withColumn("ts", F.col("ts").cast("timestamp"))
    w = flows.confidence_windows(s, "ts", F.expr("abs(2D * least(value / 50D, 1D) - 1D)"), by=("event_type",))
    path = scratch_path(t.spark, "windows")
    flows.run_windows(w, path, scratch_path(t.spark, "windows-state"))
    return rnd(flows.latest_windows(t.spark, path, ("window_start", "event_type")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), 6)


@query("k11_window_drift", f"WITH w AS (SELECT date_trunc('day', ts) AS window_start, count(*) AS n, avg({_CONF}) AS m FROM events GROUP BY ALL) "
       "SELECT window_start, n, round(m, 6) AS mean_confidence, round(abs(m - lag(m) OVER (ORDER BY window_start)), 6) AS drift, coalesce(abs(m - lag(m) OVER (ORDER BY window_start)) > 0.05e0, false) AS drifted FROM w", loans=False)
def _(t):
    w = t.events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("window_start")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.expr("abs(2D * least(value / 50D, 1D) - 1D)")).alias("mean_confidence"))
    return rnd(flows.drift_between_windows(w), 6)


@query("b0_stream_violations", f"SELECT rule, violation_type, count(*) AS violations FROM ({_ALL_RULES}) GROUP BY rule, violation_type")
def _(t):
    src = scratch_path(t.spark, "loans")
    loan_applications(t.spark, t.dir).write.parquet(src)
    v = flows.rule_violations(flows.table_stream(t.spark, src))
    out = scratch_path(t.spark, "violations")
    flows.run_to_table(v, out, scratch_path(t.spark, "violations-state"))
    return t.spark.read.parquet(out).groupBy("rule", "violation_type").agg(F.count(F.lit(1)).alias("violations"))
