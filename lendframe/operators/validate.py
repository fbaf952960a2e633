"""Validation: every check of a row is one array expression, exploded into a violations table.

``(id, field, error_type, value)`` rows come from a single scan without a
shuffle; summaries combine per task before their one small shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lendframe.operators.schema import LOAN_SCHEMA, FieldConstraint
from lendframe.operators.stats import params_frame, profile

# Named text formats.
FORMATS: dict[str, str] = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?1?[-.\s]?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})$",
    "ssn": r"^\d{3}-?\d{2}-?\d{4}$",
    "zip_code": r"^\d{5}(-\d{4})?$",
    "credit_card": r"^[0-9]{13,19}$",
    "routing_number": r"^[0-9]{9}$",
    "account_number": r"^[0-9]{8,17}$",
}
MAX_SCHEMA_ERRORS = 10


class ValidationError(ValueError):
    """A guard found a table that does not meet its contract."""


@dataclass
class SchemaReport:
    missing: list[str]
    unexpected: list[str]
    present: list[str]
    all_null: list[str] = field(default_factory=list)

    @property
    def errors(self) -> int:
        return len(self.missing) + len(self.all_null)


def check_columns(df: DataFrame, schema: tuple[FieldConstraint, ...] = LOAN_SCHEMA) -> SchemaReport:
    """Missing required and unexpected columns; looks at names only."""
    known = {c.name for c in schema}
    return SchemaReport([c.name for c in schema if c.required and c.name not in df.columns],
                        [c for c in df.columns if c not in known], [c for c in df.columns if c in known])


def schema_table(df: DataFrame, schema: tuple[FieldConstraint, ...] = LOAN_SCHEMA) -> DataFrame:
    """Long form of the column check with non-null counts: one pass."""
    r = check_columns(df, schema)
    required = {c.name for c in schema if c.required}
    seen = profile(df, df.columns, {
        "status": lambda c: F.lit("unexpected" if c in r.unexpected else "present"),
        "required": lambda c: F.lit(c in required),
        "non_null": lambda c: F.count(F.col(c)),
    })
    if not r.missing:
        return seen
    return seen.unionByName(params_frame(df.sparkSession, [(c, "missing", True, 0) for c in r.missing],
                                         "column string, status string, required boolean, non_null bigint"))


def required_but_empty(df: DataFrame, schema: tuple[FieldConstraint, ...] = LOAN_SCHEMA) -> DataFrame:
    cols = [c.name for c in schema if c.required and c.name in df.columns]
    return profile(df, cols, {"non_null": lambda c: F.count(F.col(c))}).withColumn("all_null", F.col("non_null") == 0)


def field_checks(c: FieldConstraint, formats: dict[str, str] | None = None) -> list[tuple[str, Column]]:
    """``(error_type, predicate)`` pairs of one field; nulls only break ``null_value``."""
    x, out = F.col(c.name), []
    if c.required and not c.nullable:
        out.append(("null_value", x.isNull()))
    if c.min_value is not None:
        out.append(("below_minimum", x < F.lit(c.min_value)))
    if c.max_value is not None:
        out.append(("above_maximum", x > F.lit(c.max_value)))
    if c.min_length is not None:
        out.append(("too_short", F.length(x) < c.min_length))
    if c.max_length is not None:
        out.append(("too_long", F.length(x) > c.max_length))
    if c.allowed is not None:
        out.append(("not_allowed", ~x.isin(*c.allowed)))
    if c.pattern is not None:
        out.append(("bad_pattern", ~x.rlike(c.pattern if c.pattern.startswith("^") else f"^(?:{c.pattern})")))
    if c.check is not None:
        out.append(("failed_check", ~c.check(x)))
    return out


def violations(df: DataFrame, id_col: str, schema: tuple[FieldConstraint, ...] = LOAN_SCHEMA,
               formats: dict[str, str] | None = None,
               table_rules: dict[str, Callable[[DataFrame], Column]] | None = None) -> DataFrame:
    """Violations of constraints, named formats (column -> format) and custom table rules, one scan.

    A table rule maps the frame to a boolean column that is true for valid rows.
    """
    entries = []
    for c in schema:
        if c.name in df.columns:
            entries += [(c.name, err, p) for err, p in field_checks(c)]
    for col, fmt in (formats or {}).items():
        entries.append((col, f"bad_{fmt}", ~F.col(col).rlike(FORMATS[fmt])))
    for name, rule in (table_rules or {}).items():
        entries.append((name, "rule_failed", ~rule(df)))
    cells = [F.when(F.coalesce(p, F.lit(False)),
                    F.struct(F.lit(f).alias("field"), F.lit(e).alias("error_type"),
                             (F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string")).alias("value")))
             for f, e, p in entries]
    return df.select(id_col, F.explode(F.filter(F.array(*cells), lambda v: v.isNotNull())).alias("v")).select(id_col, "v.*")


def add_format(name: str, pattern: str) -> None:
    FORMATS[name] = pattern


def summarize(v: DataFrame) -> DataFrame:
    """Errors per type and field."""
    return v.groupBy("field", "error_type").agg(F.count(F.lit(1)).alias("errors"))


def sample_values(v: DataFrame, n: int = 5) -> DataFrame:
    """Up to ``n`` distinct bad values per field and error, smallest first, with their counts.

    Equal values are combined first; the rank limit is applied per task before the shuffle.
    """
    w = Window.partitionBy("field", "error_type").orderBy("value")
    g = v.groupBy("field", "error_type", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


@dataclass
class ValidationResult:
    schema: SchemaReport
    violations: DataFrame | None
    stopped: bool = False


def validate_all(df: DataFrame, id_col: str, schema: tuple[FieldConstraint, ...] = LOAN_SCHEMA,
                 formats: dict[str, str] | None = None,
                 table_rules: dict[str, Callable[[DataFrame], Column]] | None = None,
                 rule_book=None) -> ValidationResult:
    """Schema first: required fields that are missing or all null are violations without a row id, and with more than
    10 of them the row checks are not run."""
    report = check_columns(df, schema)
    report.all_null = [r["column"] for r in required_but_empty(df, schema).where("all_null").collect()]  # one per field
    if report.errors > MAX_SCHEMA_ERRORS:
        return ValidationResult(report, None, True)
    v = violations(df, id_col, schema, formats, table_rules)
    if report.errors:
        rows = [(f, "missing_field") for f in report.missing] + [(f, "all_null") for f in report.all_null]
        v = v.unionByName(params_frame(df.sparkSession, rows, "field string, error_type string").select(
            F.lit(None).cast(df.schema[id_col].dataType).alias(id_col), "field", "error_type",
            *[F.lit(None).cast(t).alias(c) for c, t in v.dtypes if c not in (id_col, "field", "error_type")]))
    if rule_book is not None:
        b = rule_book.violations(df, id_col).select(
            id_col, F.col("rule").alias("field"), F.col("violation_type").alias("error_type"),
            F.col("actual").cast("string").alias("value"))
        v = v.unionByName(b)
    return ValidationResult(report, v)


def clean_by_schema(df: DataFrame, schema: tuple[FieldConstraint, ...] = LOAN_SCHEMA) -> DataFrame:
    """Clip numbers to the schema limits; fill nulls of optional or nullable fields (0, '' or false)."""
    new = {}
    for c in schema:
        if c.name not in df.columns:
            continue
        x, t = F.col(c.name), df.schema[c.name].dataType
        if isinstance(t, T.NumericType):
            if c.min_value is not None:
                x = F.when(x < c.min_value, F.lit(c.min_value).cast(t)).otherwise(x)
            if c.max_value is not None:
                x = F.when(x > c.max_value, F.lit(c.max_value).cast(t)).otherwise(x)
        if c.nullable or not c.required:
            zero = 0 if isinstance(t, T.NumericType) else "" if isinstance(t, T.StringType) else (
                False if isinstance(t, T.BooleanType) else None)
            if zero is not None:
                x = F.coalesce(x, F.lit(zero).cast(t))
        new[c.name] = x
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def validate_and_clean(df: DataFrame, drop_null: list[str] | None = None, fill: dict | None = None) -> DataFrame:
    """Fill the given columns, then drop rows with nulls in the others."""
    out = df.fillna(fill) if fill else df
    return out.dropna(subset=drop_null) if drop_null else out


def field_rates(df: DataFrame, schema: tuple[FieldConstraint, ...] = LOAN_SCHEMA) -> DataFrame:
    """Errors, error rate and null rate per field: one pass."""
    cons = {c.name: c for c in schema if c.name in df.columns}
    any_error = {n: functools.reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for _, p in field_checks(c)],
                                     F.lit(False)) for n, c in cons.items()}
    return profile(df, list(cons), {
        "errors": lambda c: F.count_if(any_error[c]),
        "error_rate": lambda c: F.try_divide(F.count_if(any_error[c]), F.count(F.lit(1))),
        "null_rate": lambda c: F.try_divide(F.count_if(F.col(c).isNull()), F.count(F.lit(1))),
    })


def quality_score(df: DataFrame, schema: tuple[FieldConstraint, ...] = LOAN_SCHEMA) -> DataFrame:
    """``(1 - errors / (rows * required fields)) * 100`` with its inputs."""
    cons = [c for c in schema if c.name in df.columns]
    required = sum(1 for c in schema if c.required)
    err = functools.reduce(lambda a, b: a + b,
                           [F.count_if(F.coalesce(p, F.lit(False))) for c in cons for _, p in field_checks(c)])
    return df.agg(F.count(F.lit(1)).alias("rows"), err.alias("errors")).withColumn(
        "score", F.greatest(F.lit(0.0), (1.0 - F.try_divide("errors", F.col("rows") * required)) * 100.0))


def model_inputs(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Checks before training: rows, mostly-null and constant features, class sizes and balance."""
    agg = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{c}") for c in features],
                 *[(F.min(c) == F.max(c)).alias(f"k_{c}") for c in features]).first()
    counts = [r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()]  # one row per class
    rows = agg["rows"]
    sparse = [c for c in features if rows - agg[f"n_{c}"] > rows * 0.5]
    constant = [c for c in features if agg[f"k_{c}"] is not False]
    lo, hi = (min(counts), max(counts)) if counts else (0, 0)
    ratio = hi / lo if lo else None
    out = [("enough_rows", rows >= 100, float(rows)), ("no_sparse_features", not sparse, float(len(sparse))),
           ("no_constant_features", not constant, float(len(constant))), ("min_class_size", lo >= 10, float(lo)),
           ("class_balance", ratio is not None and ratio <= 10, ratio)]
    return params_frame(df.sparkSession, out, "check string, passed boolean, measure double")


def drift(df: DataFrame, fitted_columns: list[str], null_limit: float = 0.8) -> DataFrame:
    """Columns against those seen at fit: missing, extra, empty or mostly null."""
    missing = [c for c in fitted_columns if c not in df.columns]
    ratio = profile(df, df.columns, {"null_ratio": lambda c: F.try_divide(F.count_if(F.col(c).isNull()), F.count(F.lit(1)))})
    extra = F.col("column").isin(*fitted_columns) == F.lit(False)
    out = ratio.select("column", F.when(extra, "extra").when(F.col("null_ratio") == 1, "empty")
                       .when(F.col("null_ratio") > null_limit, "mostly_null").otherwise("ok").alias("status"), "null_ratio")
    if missing:
        out = out.unionByName(params_frame(df.sparkSession, [(c, "missing", None) for c in missing],
                                           "column string, status string, null_ratio double"))
    return out


# --- guards on functions over frames ------------------------------------------------------------

def require_fields(*names: str):
    """The first argument must have these columns."""
    def deco(fn):
        @functools.wraps(fn)
        def run(df: DataFrame, *a, **k):
            lost = [n for n in names if n not in df.columns]
            if lost:
                raise ValidationError(f"missing required fields {lost}")
            return fn(df, *a, **k)
        return run
    return deco


def validate_input(id_col: str, schema: tuple[FieldConstraint, ...] = LOAN_SCHEMA, mode: str = "raise"):
    """Check the first argument. ``raise`` stops on any violation; ``quarantine`` passes good rows on and
    returns ``(result, violations)``."""
    def deco(fn):
        @functools.wraps(fn)
        def run(df: DataFrame, *a, **k):
            report = check_columns(df, schema)
            if report.missing:
                raise ValidationError(f"missing required fields {report.missing}")
            v = violations(df, id_col, schema)
            if mode == "quarantine":
                bad = v.select(id_col).distinct()
                return fn(df.join(bad, id_col, "left_anti"), *a, **k), v
            if not v.isEmpty():
                raise ValidationError("input breaks field constraints")
            return fn(df, *a, **k)
        return run
    return deco


def validate_schema(schema: tuple[FieldConstraint, ...] = LOAN_SCHEMA):
    return require_fields(*[c.name for c in schema if c.required])


def validate_output(columns: list[str] | None = None, types: dict[str, str] | None = None,
                    min_rows: int | None = None, max_rows: int | None = None):
    """Check the returned frame's columns and types by schema, and its size by one bounded count."""
    def deco(fn):
        @functools.wraps(fn)
        def run(*a, **k):
            out = fn(*a, **k)
            have = dict(out.dtypes)
            lost = [c for c in columns or [] if c not in have]
            wrong = {c: have.get(c) for c, t in (types or {}).items() if have.get(c) != t}
            if lost or wrong:
                raise ValidationError(f"output columns missing {lost}, types differ {wrong}")
            if min_rows is not None or max_rows is not None:
                n = out.limit(max(min_rows or 0, (max_rows or 0) + 1)).count()
                if (min_rows is not None and n < min_rows) or (max_rows is not None and n > max_rows):
                    raise ValidationError("output has too few or too many rows")
            return out
        return run
    return deco
