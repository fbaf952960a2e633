"""Queries: conversions and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendframe.functions import convert
from lendframe.operators import validate
from lendframe.operators.rules import RuleBook
from lendframe.operators.schema import LOAN_SCHEMA, FieldConstraint
from lendframe.operators.stats import params_frame
from lendframe.plans.catalog_eda import ALL, rnd, union
from lendframe.plans.catalog_rules import _ALL as _ALL_RULES
from lendframe.plans.registry import query
from lendframe.sources.loans import NUMERIC

L = "loan_applications"
# Text columns in many spellings, valid in both engines.
_INT = ("case o_orderkey % 7 when 0 then cast(o_custkey as varchar(20)) when 1 then concat('  ', cast(o_custkey as varchar(20)), ' ') "
        "when 2 then concat(cast(o_custkey as varchar(20)), '.0') when 3 then concat(cast(o_custkey as varchar(20)), '.5') "
        "when 4 then concat(cast(o_custkey as varchar(20)), '.7%') when 5 then concat('1,', lpad(cast(o_custkey % 1000 as varchar(20)), 3, '0')) else 'n/a' end")
_FLT = ("case o_orderkey % 7 when 0 then concat('$', cast(o_custkey as varchar(20)), '.25') when 1 then concat(cast(o_custkey as varchar(20)), '%') "
        "when 2 then concat('€', cast(o_custkey as varchar(20))) when 3 then concat(' -', cast(o_custkey as varchar(20)), '.5 ') "
        "when 4 then concat('£1,', lpad(cast(o_custkey % 1000 as varchar(20)), 3, '0'), '.75') when 5 then '1.5e3' else 'unknown' end")
_BOOL = ("case o_orderkey % 8 when 0 then ' Yes ' when 1 then 'no' when 2 then 'TRUE' when 3 then 'Off' when 4 then '1' when 5 then '' when 6 then 'maybe' else 'Disabled' end")
_DATE = ("case o_orderkey % 7 when 0 then concat('1998-0', cast(1 + o_custkey % 9 as varchar(2)), '-11 10:11:12') when 1 then concat('0', cast(1 + o_custkey % 9 as varchar(2)), '/25/1997') "
         "when 2 then '25/12/1996' when 3 then concat('2001-03-0', cast(1 + o_custkey % 9 as varchar(2)), 'T01:02:03') when 4 then cast(900000000 + o_custkey as varchar(20)) "
         "when 5 then '1999-05-06' else 'soon' end")


def _texts(t):
    return t.orders.selectExpr("o_orderkey", f"{_INT} AS i", f"{_FLT} AS f", f"{_BOOL} AS b", f"{_DATE} AS d")


_NUM = "regexp_matches({x}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$')"


def _parse(x: str) -> str:
    return f"case when {_NUM.format(x=x)} then try_cast({x} as double) end"


_CI = "replace(trim(i), ',', '')"
_CF = "replace(trim(f), ',', '')"


@query("t1_to_integer", f"SELECT o_orderkey, cast(case when {_CI} like '%\\%' escape '\\' then trunc({_parse(f'rtrim({_CI}, chr(37))')}) "
       f"when ({_parse(_CI)}) = trunc({_parse(_CI)}) then {_parse(_CI)} end as bigint) AS v FROM (SELECT o_orderkey, {_INT} AS i FROM orders)", loans=False)
def _(t):
    return _texts(t).select("o_orderkey", convert.to_integer(F.col("i")).alias("v"))


@query("t2_to_float", f"SELECT o_orderkey, round(case when {_CF} like '%\\%' escape '\\' then ({_parse(f'rtrim({_CF}, chr(37))')}) / 100e0 "
       f"else {_parse(f'''regexp_replace({_CF}, '[$€£¥]', '', 'g')''')} end, 6) AS v FROM (SELECT o_orderkey, {_FLT} AS f FROM orders)", loans=False)
def _(t):
    return _texts(t).select("o_orderkey", F.round(convert.to_float(F.col("f")), 6).alias("v"))


@query("t3_to_string", f"SELECT o_orderkey, coalesce(trim(nullif(i, 'n/a')), '') AS s, trim(nullif(i, 'n/a')) AS c FROM (SELECT o_orderkey, {_INT} AS i FROM orders)", loans=False)
def _(t):
    x = F.nullif(F.col("i"), F.lit("n/a"))
    return _texts(t).select("o_orderkey", convert.to_string(x).alias("s"), convert.to_categorical(x).alias("c"))


@query("t4_to_boolean", f"SELECT o_orderkey, case when lower(trim(b)) in ('true', 'yes', 'y', '1', 'on', 'enabled') then true "
       f"when lower(trim(b)) in ('false', 'no', 'n', '0', 'off', 'disabled', '') then false end AS v FROM (SELECT o_orderkey, {_BOOL} AS b FROM orders)", loans=False)
def _(t):
    return _texts(t).select("o_orderkey", convert.to_boolean(F.col("b")).alias("v"))


@query("t5_to_datetime", "SELECT o_orderkey, coalesce(try_strptime(d, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%Y-%m-%dT%H:%M:%S']), "
       f"make_timestamp(cast(try_cast(d as double) * 1000000 as bigint))) AS v FROM (SELECT o_orderkey, {_DATE} AS d FROM orders)", loans=False)
def _(t):
    return _texts(t).select("o_orderkey", convert.to_datetime(F.col("d")).cast("timestamp_ntz").alias("v"))


@query("t6_convert_table", f"SELECT count(*) AS n, count(cast(case when {_CI} like '%\\%' escape '\\' then trunc({_parse(f'rtrim({_CI}, chr(37))')}) "
       f"when ({_parse(_CI)}) = trunc({_parse(_CI)}) then {_parse(_CI)} end as bigint)) AS ints, "
       f"count(case when lower(trim(b)) in ('true', 'yes', 'y', '1', 'on', 'enabled', 'false', 'no', 'n', '0', 'off', 'disabled', '') then 1 end) AS bools "
       f"FROM (SELECT o_orderkey, {_INT} AS i, {_BOOL} AS b FROM orders)", loans=False)
def _(t):
    df = convert.convert_dataframe(_texts(t), {"i": "integer", "b": "boolean"})
    return df.agg(F.count(F.lit(1)).alias("n"), F.count("i").alias("ints"), F.count("b").alias("bools"))


def _infer(c: str) -> str:
    v = f"cast({c} as varchar)"
    return (f"SELECT '{c}' AS \"column\", case when bool_and(lower(trim(v)) in ('true', 'yes', 'y', '1', 'on', 'enabled', 'false', 'no', 'n', '0', 'off', 'disabled')) and count(distinct v) <= 2 then 'boolean' "
            f"when bool_and(({_parse('trim(v)')}) is null and try_cast(v as timestamp) is not null) then 'datetime' "
            f"when bool_and(coalesce(({_parse('trim(v)')}) = floor({_parse('trim(v)')}), false)) then 'integer' when bool_and(({_parse('trim(v)')}) is not null) then 'float' "
            f"when count(distinct v) < 20 or count(distinct v) * 1e0 / count(*) < 0.1e0 then 'categorical' else 'string' end AS inferred_type, "
            f"count(distinct v) AS \"distinct\", count(*) AS total FROM (SELECT {v} AS v FROM {L} WHERE {c} IS NOT NULL)")


@query("t7_infer_types", union(_infer(c) for c in ALL))
def _(t):
    return convert.infer_types(t.dealt(t.loans))


@query("t8_coerce_numeric", f"SELECT o_orderkey, coalesce({_parse('trim(i)')}, 0e0) AS v FROM (SELECT o_orderkey, {_INT} AS i FROM orders)", loans=False)
def _(t):
    return _texts(t).select("o_orderkey", convert.coerce_numeric(F.col("i")).alias("v"))


# --- V ------------------------------------------------------------------------------------------

_REQ = {c.name for c in LOAN_SCHEMA if c.required}


@query("v1_schema_check", union(
    f"SELECT '{c}' AS \"column\", '{'unexpected' if c == 'application_id' else 'present'}' AS status, {str(c in _REQ).lower()} AS required, count({c}) AS non_null FROM {L}"
    for c in ALL if c not in ("state", "age")) + " UNION ALL SELECT 'state', 'missing', true, 0 UNION ALL SELECT 'age', 'missing', true, 0")
def _(t):
    return validate.schema_table(t.loans.drop("state", "age"))


@query("v2_required_but_empty", union(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count({c}) = 0 AS all_null FROM {L}" for c in ALL if c in _REQ))
def _(t):
    return validate.required_but_empty(t.loans)


def _checks(c: FieldConstraint) -> list[tuple[str, str]]:
    out = []
    if c.required and not c.nullable:
        out.append(("null_value", f"{c.name} is null"))
    if c.min_value is not None:
        out += [("below_minimum", f"{c.name} < {c.min_value}"), ("above_maximum", f"{c.name} > {c.max_value}")]
    if c.allowed is not None:
        vals = ", ".join(str(a) if isinstance(a, int) else "'" + a.replace("'", "''") + "'" for a in c.allowed)
        out.append(("not_allowed", f"{c.name} not in ({vals})"))
    return out


_RANGE = [(c.name, e, p) for c in LOAN_SCHEMA for e, p in _checks(c) if e in ("below_minimum", "above_maximum")]
_EVERY = [(c.name, e, p) for c in LOAN_SCHEMA for e, p in _checks(c)]


@query("v3_range_violations", union(
    f"SELECT application_id, '{n}' AS field, '{e}' AS error_type, round(cast({n} as double), 6) AS value FROM {L} WHERE {p}" for n, e, p in _RANGE))
def _(t):
    v = validate.violations(t.loans, "application_id")
    return v.where(F.col("error_type").isin("below_minimum", "above_maximum")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6))


@query("v3_range_samples", "SELECT field, error_type, value, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY field, error_type ORDER BY value) AS rank FROM ("
       "SELECT field, error_type, value, count(*) AS cnt FROM (" + union(
           f"SELECT '{n}' AS field, '{e}' AS error_type, cast({n} as varchar) AS value FROM {L} WHERE {p}" for n, e, p in _EVERY)
       + ") GROUP BY ALL)) WHERE rank <= 5")
def _(t):
    return validate.sample_values(validate.violations(t.loans, "application_id"))


_LEN = (FieldConstraint("loan_purpose", "string", nullable=True, min_length=5, max_length=12),
        FieldConstraint("state", "string", nullable=True, min_length=1, max_length=2))


@query("v4_length", union(f"SELECT '{c.name}' AS field, '{e}' AS error_type, count(*) AS errors FROM {L} WHERE length({c.name}) {op} HAVING count(*) > 0"
                          for c in _LEN for e, op in (("too_short", f"< {c.min_length}"), ("too_long", f"> {c.max_length}"))))
def _(t):
    return validate.summarize(validate.violations(t.loans, "application_id", _LEN))


@query("v5_not_allowed", union(
    f"SELECT '{n}' AS field, {n} AS value, count(*) AS cnt FROM {L} WHERE {p} GROUP BY {n}" for n, e, p in _EVERY if e == "not_allowed" and n != "loan_approved"))
def _(t):
    v = validate.violations(t.loans, "application_id").where("error_type = 'not_allowed'")
    return v.groupBy("field", "value").agg(F.count(F.lit(1)).alias("cnt"))


@query("v6_pattern", "SELECT c_custkey, 'c_name' AS field, 'bad_pattern' AS error_type, c_name AS value FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]*[02468]$')", loans=False)
def _(t):
    return validate.violations(t.customer, "c_custkey", (FieldConstraint("c_name", "string", nullable=True, pattern="Customer#[0-9]*[02468]$"),))


_CONTACT = ("SELECT c_custkey, case when c_custkey % 3 = 0 then concat('user', cast(c_custkey as varchar(20)), '@example.org') else concat('user', cast(c_custkey as varchar(20)), '@example') end AS email, "
            "case when c_custkey % 4 = 0 then concat('(555) 123-', lpad(cast(c_custkey % 10000 as varchar(20)), 4, '0')) else concat('12-34-', cast(c_custkey as varchar(20))) end AS phone, "
            "lpad(cast(c_custkey as varchar(20)), case when c_custkey % 5 = 0 then 4 else 5 end, '0') AS zip_code, "
            "lpad(cast(c_custkey as varchar(20)), case when c_custkey % 6 = 0 then 12 else 16 end, '4') AS credit_card, "
            "concat('123-', lpad(cast(c_custkey % 100 as varchar(20)), 2, '0'), case when c_custkey % 2 = 0 then '-1234' else '-123' end) AS ssn, "
            "lpad(cast(c_custkey as varchar(20)), case when c_custkey % 7 = 0 then 8 else 9 end, '1') AS routing_number, "
            "lpad(cast(c_custkey as varchar(20)), case when c_custkey % 8 = 0 then 7 else 10 end, '2') AS account_number FROM customer")


@query("v7_formats", f"WITH x AS ({_CONTACT}) " + union(
    f"SELECT '{n}' AS field, 'bad_{n}' AS error_type, count(*) AS errors FROM x WHERE NOT regexp_matches({n}, '{p}') HAVING count(*) > 0"
    for n, p in validate.FORMATS.items()), loans=False)
def _(t):
    t.customer.createOrReplaceTempView("customer")
    x = t.spark.sql(_CONTACT)
    return validate.summarize(validate.violations(x, "c_custkey", (), {n: n for n in validate.FORMATS}))


@query("v8_custom_check", f"SELECT application_id, 'loan_term_months' AS field, 'failed_check' AS error_type, cast(loan_term_months as varchar) AS value FROM {L} WHERE loan_term_months % 24 <> 0")
def _(t):
    return validate.violations(t.loans, "application_id", (FieldConstraint("loan_term_months", "integer", nullable=True, check=lambda x: x % 24 == 0),))


@query("v9_table_rule", f"SELECT application_id, 'debt_below_income' AS field, 'rule_failed' AS error_type, cast(null as varchar) AS value FROM {L} WHERE NOT existing_debt < annual_income")
def _(t):
    return validate.violations(t.loans, "application_id", (), None, {"debt_below_income": lambda df: df["existing_debt"] < df["annual_income"]})


_EVERY_SQL = union(f"SELECT '{n}' AS field, '{e}' AS error_type FROM {L} WHERE {p}" for n, e, p in _EVERY)


@query("v10_validate_all", f"SELECT error_type, count(*) AS errors, count(distinct field) AS failed_fields FROM ({_EVERY_SQL} UNION ALL SELECT rule, violation_type FROM ({_ALL_RULES})) GROUP BY error_type")
def _(t):
    r = validate.validate_all(t.loans, "application_id", rule_book=RuleBook())
    per = r.violations.groupBy("error_type", "field").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("error_type").agg(F.sum("n").alias("errors"), F.count(F.lit(1)).alias("failed_fields"))


@query("v11_quarantine", f"SELECT loan_purpose, count(*) AS good_rows FROM {L} WHERE NOT (" + " OR ".join(f"coalesce({p}, false)" for _, _, p in _EVERY) + ") GROUP BY loan_purpose")
def _(t):
    @validate.validate_output(columns=["loan_purpose", "good_rows"], types={"good_rows": "bigint"})
    def run(df):
        good, _v = validate.validate_input("application_id", mode="quarantine")(lambda x: x)(df)
        return good.groupBy("loan_purpose").agg(F.count(F.lit(1)).alias("good_rows"))
    return run(t.loans)


@query("v12_validate_and_clean", f"SELECT application_id, credit_score, coalesce(property_value, 0e0) AS property_value FROM {L} WHERE credit_score IS NOT NULL AND years_employed IS NOT NULL")
def _(t):
    return validate.validate_and_clean(t.loans, ["credit_score", "years_employed"], {"property_value": 0.0}).select("application_id", "credit_score", "property_value")


@query("v13_clean_by_schema", f"SELECT application_id, age, least(greatest(debt_to_income_ratio, 0e0), 1e0) AS debt_to_income_ratio, coalesce(property_value, 0e0) AS property_value, "
       f"greatest(loan_amount, 1000e0) AS loan_amount FROM {L}")
def _(t):
    return validate.clean_by_schema(t.loans).select("application_id", "age", "debt_to_income_ratio", "property_value", "loan_amount")


def _any(c: FieldConstraint) -> str:
    return " OR ".join(f"coalesce({p}, false)" for _, p in _checks(c)) or "false"


@query("v14_field_rates", union(
    f"SELECT '{c.name}' AS \"column\", count(case when {_any(c)} then 1 end) AS errors, round(count(case when {_any(c)} then 1 end) * 1e0 / count(*), 6) AS error_rate, "
    f"round((count(*) - count({c.name})) * 1e0 / count(*), 6) AS null_rate FROM {L}" for c in LOAN_SCHEMA))
def _(t):
    return rnd(validate.field_rates(t.loans), 6)


@query("v14_quality_score", f"SELECT (SELECT count(*) FROM {L}) AS rows, count(*) AS errors, round((1e0 - count(*) * 1e0 / ((SELECT count(*) FROM {L}) * {len(_REQ)})) * 100e0, 6) AS score FROM ({_EVERY_SQL})")
def _(t):
    return rnd(validate.quality_score(t.loans), 6)


_ML = NUMERIC


@query("v15_model_inputs", f"SELECT 'enough_rows' AS \"check\", count(*) >= 100 AS passed, cast(count(*) as double) AS measure FROM {L} UNION ALL "
       "SELECT 'no_sparse_features', s = 0, cast(s as double) FROM (SELECT " + " + ".join(f"case when count({c}) < 0.5e0 * count(*) then 1 else 0 end" for c in _ML) + f" AS s FROM {L}) UNION ALL "
       "SELECT 'no_constant_features', s = 0, cast(s as double) FROM (SELECT " + " + ".join(f"case when count(distinct {c}) <= 1 then 1 else 0 end" for c in _ML) + f" AS s FROM {L}) UNION ALL "
       f"SELECT 'min_class_size', min(n) >= 10, cast(min(n) as double) FROM (SELECT count(*) AS n FROM {L} GROUP BY loan_approved) UNION ALL "
       f"SELECT 'class_balance', max(n) * 1e0 / min(n) <= 10, round(max(n) * 1e0 / min(n), 6) FROM (SELECT count(*) AS n FROM {L} GROUP BY loan_approved)")
def _(t):
    return rnd(validate.model_inputs(t.loans, _ML, "loan_approved"), 6)


@query("v16_drift", union(
    f"SELECT '{c}' AS \"column\", case when '{c}' = 'loan_approved' then 'extra' when count({c}) = 0 then 'empty' when (count(*) - count({c})) * 1e0 / count(*) > 0.8e0 then 'mostly_null' else 'ok' end AS status, "
    f"round((count(*) - count({c})) * 1e0 / count(*), 6) AS null_ratio FROM {L}" for c in ALL if c != "gender") + " UNION ALL SELECT 'gender', 'missing', null")
def _(t):
    return rnd(validate.drift(t.loans.drop("gender"), [c for c in ALL if c != "loan_approved"]), 6)


@query("v10_type_spread", f"SELECT field, error_type, count(*) AS errors FROM ({_EVERY_SQL}) GROUP BY field, error_type")
def _(t):
    return validate.summarize(validate.violations(t.loans, "application_id"))
