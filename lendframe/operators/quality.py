"""Data-quality dimensions and the weighted score.

Each dimension is one aggregate pass that yields one row per column; the
overall score is arithmetic on those few numbers.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lendframe.operators.stats import (
    column_stats, long_cells, numeric_columns, params_frame, profile, string_columns)

# Weight of each dimension in the overall score.
WEIGHTS = {"completeness": 0.25, "validity": 0.20, "consistency": 0.20, "uniqueness": 0.15,
           "accuracy": 0.10, "timeliness": 0.10}
# Lower limit of each quality level.
LEVELS = (("Excellent", 0.95), ("Good", 0.85), ("Fair", 0.70))
CRITICAL_COMPLETENESS = 0.70
# Patterns of contact columns.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^\+?[\d\s\-\(\)]{7,}$"


def level(score: float) -> str:
    return next((name for name, lo in LEVELS if score >= lo), "Poor")


def level_column(score: Column) -> Column:
    out = F.lit("Poor")
    for name, lo in reversed(LEVELS):
        out = F.when(score >= lo, name).otherwise(out)
    return out


def completeness(df: DataFrame) -> DataFrame:
    """Non-null ratio per column and whether it is a critical gap."""
    out = profile(df, df.columns, {
        "ratio": lambda c: F.try_divide(F.count(F.col(c)), F.count(F.lit(1))),
        "missing": lambda c: F.count_if(F.col(c).isNull()),
    })
    return out.withColumn("critical_gap", F.col("ratio") < CRITICAL_COMPLETENESS)


def _invalid(df: DataFrame, c: str, limits: dict) -> Column:
    """Number of invalid values of one column by its name, type and limits."""
    x, name, t = F.col(c), c.lower(), df.schema[c].dataType
    tests = []
    if isinstance(t, T.StringType):
        if name == "email":
            tests.append(~x.rlike(EMAIL))
        elif name in ("phone", "phone_number"):
            tests.append(~x.rlike(PHONE))
    elif isinstance(t, T.NumericType):
        if name == "age":
            tests.append((x < 0) | (x > 150))
        elif name in ("salary", "income", "amount"):
            tests.append(x < 0)
    if c in limits:
        lo, hi = limits[c]
        if lo is not None:
            tests.append(x < lo)
        if hi is not None:
            tests.append(x > hi)
    return sum((F.count_if(F.coalesce(p, F.lit(False))) for p in tests), F.lit(0).cast("bigint"))


def validity(df: DataFrame, limits: dict[str, tuple] | None = None) -> DataFrame:
    """Valid count and ratio over non-null values per column; 0 for an all-null column."""
    limits = limits or {}
    out = profile(df, df.columns, {"total": lambda c: F.count(F.col(c)),
                                   "invalid": lambda c: _invalid(df, c, limits)})
    return out.select("column", "total", (F.col("total") - F.col("invalid")).alias("valid"),
                      F.coalesce(F.try_divide(F.col("total") - F.col("invalid"), "total"), F.lit(0.0)).alias("ratio"))


def decimal_places(text: Column) -> Column:
    """Digits after the point of the shortest decimal form; text may be in scientific form (``1.25E7``), which alone is split."""
    mantissa = F.split_part(text, F.lit("E"), F.lit(1))
    exp = F.coalesce(F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int"), F.lit(0))
    frac = F.split_part(mantissa, F.lit("."), F.lit(2))
    digits = F.when((frac == "0") & (exp != 0), 0).otherwise(F.length(frac))
    dot = F.instr(text, ".")
    return F.when(F.instr(text, "E") == 0, F.when(dot == 0, 1).otherwise(F.greatest(F.length(text) - dot, F.lit(1)))).otherwise(
        F.greatest(digits - exp, F.lit(1)))


def consistency(df: DataFrame) -> DataFrame:
    """1 minus 0.1 for case variants, for untrimmed text, and for over 3 decimal precisions.

    Text: combined (column, value) pairs, grouped again by lower-cased value.
    Doubles: grouped by decimal length, a handful of groups per column.
    """
    text = string_columns(df)
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    parts = []
    if text:
        v = long_cells(df, text).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        folded = v.groupBy("column", F.lower("value").alias("folded")).agg(
            F.count(F.lit(1)).alias("variants"), F.sum(F.when(F.col("value") != F.trim("value"), F.col("n")).otherwise(0)).alias("untrimmed"))
        parts.append(folded.groupBy("column").agg(
            (F.sum("variants") - F.count(F.lit(1))).alias("case_variants"), F.sum("untrimmed").alias("untrimmed"),
            F.lit(0).cast("bigint").alias("precisions")))
    if doubles:
        cells = long_cells(df, doubles).where("value is not null")
        places = cells.groupBy("column", decimal_places(F.col("value")).alias("places")).agg(F.lit(1))
        parts.append(places.groupBy("column").agg(
            F.lit(0).cast("bigint").alias("case_variants"), F.lit(0).cast("bigint").alias("untrimmed"),
            F.count(F.lit(1)).alias("precisions")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    names = params_frame(df.sparkSession, [(c,) for c in df.columns], "column string")
    out = names.join(found, "column", "left").na.fill(0)
    score = (1.0 - F.when(F.col("case_variants") > 0, 0.1).otherwise(0.0)
             - F.when(F.col("untrimmed") > 0, 0.1).otherwise(0.0)
             - F.when(F.col("precisions") > 3, 0.1).otherwise(0.0))
    return out.withColumn("score", score)


def uniqueness(df: DataFrame) -> DataFrame:
    """Distinct count, ratio and duplicate count per column; key candidates above 0.95 with over 10 values."""
    v = long_cells(df, df.columns).where("value is not null").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))
    u = v.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_count"))
    return u.select("column", "total", "unique_count", (F.col("unique_count") / F.col("total")).alias("ratio"),
                    (F.col("total") - F.col("unique_count")).alias("duplicates"),
                    ((F.col("unique_count") / F.col("total") > 0.95) & (F.col("total") > 10)).alias("key_candidate"))


def row_uniqueness(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and their ratio. Copies of one row are combined before the shuffle."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").alias("total"), F.count(F.lit(1)).alias("distinct_rows")).select(
        "total", "distinct_rows", (F.col("total") - F.col("distinct_rows")).alias("duplicates"),
        F.coalesce(F.try_divide("distinct_rows", "total"), F.lit(1.0)).alias("ratio"))


def accuracy(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of values beyond 3 IQR per numeric column with over 10 values; above 10 % counts against accuracy."""
    cols = columns or numeric_columns(df)
    stats = {c: s for c, s in column_stats(df, cols, quantiles=(0.25, 0.75)).items() if s.count > 10}
    if not stats:
        return params_frame(df.sparkSession, [], "column string, total bigint, extreme bigint, ratio double, flagged boolean")
    out = profile(df, list(stats), {
        "total": lambda c: F.count(F.col(c)),
        "extreme": lambda c: F.count_if(~F.col(c).cast("double").between(*stats[c].fences(3.0)))})
    return out.select("column", "total", "extreme", (F.col("extreme") / F.col("total")).alias("ratio"),
                      (F.col("extreme") / F.col("total") > 0.1).alias("flagged"))


def timeliness(df: DataFrame, as_of: datetime.date | str) -> DataFrame:
    """Age in days of the newest value of each date column against ``as_of``; over 365 days is stale."""
    cols = [c for c in df.columns if "date" in c.lower() or "time" in c.lower()]
    cols = [c for c in cols if isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType))]
    if not cols:
        return params_frame(df.sparkSession, [], "column string, oldest date, newest date, days_old int, stale boolean")
    out = profile(df, cols, {"newest": lambda c: F.max(F.col(c).try_cast("date")),
                             "oldest": lambda c: F.min(F.col(c).try_cast("date"))})
    age = F.date_diff(F.lit(str(as_of)).cast("date"), F.col("newest"))
    return out.select("column", "oldest", "newest", age.alias("days_old"), (age > 365).alias("stale"))


@dataclass
class QualityReport:
    scores: dict[str, float]
    overall: float
    issues: dict[str, int] = field(default_factory=dict)

    @property
    def level(self) -> str:
        return level(self.overall)

    @property
    def severity(self) -> dict[str, int]:
        """Number of dimensions that are critical (Poor), moderate (Fair) and minor (Good)."""
        got = [level(v) for v in self.scores.values()]
        return {"critical": got.count("Poor"), "moderate": got.count("Fair"), "minor": got.count("Good")}

    @property
    def recommendations(self) -> list[str]:
        advice = {"completeness": "impute missing values", "validity": "add validation rules",
                  "consistency": "standardize formats", "uniqueness": "remove duplicates"}
        out = [a for k, a in advice.items() if self.scores[k] < 0.9]
        if self.overall < 0.7:
            out.append("improve overall data quality")
        elif self.overall < 0.85:
            out.append("work on the lowest dimension")
        return out


def assess(df: DataFrame, as_of: datetime.date | str, limits: dict[str, tuple] | None = None,
           weights: dict[str, float] | None = None) -> QualityReport:
    """All six dimensions; what reaches the driver is one row per dimension."""
    weights = weights or WEIGHTS
    d = len(df.columns)
    comp = completeness(df).agg(F.avg("ratio"), F.count_if("critical_gap")).first()
    val = validity(df, limits).agg(F.coalesce(F.try_divide(F.sum("valid"), F.sum("total")), F.lit(0.0)),
                                   F.count_if(F.col("ratio") < 0.7)).first()
    con = consistency(df).agg(F.sum("score") / d, F.count_if(F.col("score") < 1.0)).first()
    uni = row_uniqueness(df).select("ratio", "duplicates").first()
    acc = accuracy(df).agg(F.count_if("flagged")).first()[0]
    tim = timeliness(df, as_of).agg(F.count_if("stale")).first()[0]
    scores = {"completeness": comp[0], "validity": val[0], "consistency": con[0], "uniqueness": uni[0],
              "accuracy": max(0.0, 0.8 - 0.1 * acc), "timeliness": max(0.0, 0.8 - 0.2 * tim)}
    issues = {"completeness": comp[1], "validity": val[1], "consistency": con[1], "uniqueness": uni[1],
              "accuracy": acc, "timeliness": tim}
    total = sum(weights[k] for k in scores)
    return QualityReport(scores, sum(scores[k] * weights[k] for k in scores) / total, issues)


def report_table(spark, r: QualityReport) -> DataFrame:
    rows = [(k, v, level(v), int(r.issues[k])) for k, v in r.scores.items()]
    rows.append(("overall", r.overall, level(r.overall), sum(r.issues.values())))
    return params_frame(spark, rows, "dimension string, score double, level string, issues bigint")


class QualityGateError(ValueError):
    """The table scores below the required quality."""


def gate(r: QualityReport, minimum: float = 0.7, on_fail: str = "warn") -> bool:
    """True when the score reaches the minimum; ``on_fail='raise'`` stops instead of passing data on."""
    ok = r.overall >= minimum
    if not ok and on_fail == "raise":
        raise QualityGateError(f"quality {r.overall:.4f} is below {minimum}")
    return ok
