"""Outlier bounds, treatments and summaries.

Fit returns plain bounds per column; treatment is a projection of literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lendframe.operators.stats import ColumnStats, column_stats, exact_quantiles, params_frame, profile


@dataclass
class OutlierBounds:
    """Values outside ``[lo, hi]`` are outliers; a column without bounds has none."""

    method: str
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    clip: dict[str, tuple[float, float]] = field(default_factory=dict)

    def flag(self, c: str) -> Column:
        if c not in self.bounds:
            return F.lit(False)
        lo, hi = self.bounds[c]
        x = F.col(c).cast("double")
        return F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False))


def fit_iqr(df: DataFrame, columns: list[str], multiplier: float = 1.5, stats: dict[str, ColumnStats] | None = None) -> OutlierBounds:
    """Quartile fences; all columns in one exact-quantile pass, or none where ``stats`` has the quartiles."""
    q = {c: stats[c].quantiles for c in columns} if stats else exact_quantiles(df, {c: (0.25, 0.75) for c in columns})
    b = {}
    for c in columns:
        lo, hi = q[c][0.25], q[c][0.75]
        if lo is not None:
            b[c] = (lo - multiplier * (hi - lo), hi + multiplier * (hi - lo))
    return OutlierBounds("iqr", b, dict(b))


def fit_zscore(df: DataFrame, columns: list[str], threshold: float = 3.0) -> OutlierBounds:
    """Mean plus/minus threshold sample deviations; a constant column has no outliers."""
    b = {}
    for c, s in column_stats(df, columns, quantiles=()).items():
        if s.std:
            b[c] = (s.mean - threshold * s.std, s.mean + threshold * s.std)
    return OutlierBounds("zscore", b, dict(b))


def percentile_clip(df: DataFrame, columns: list[str], lo: float = 0.05, hi: float = 0.95) -> dict:
    """Clip limits for detectors without bounds of their own (forest, density)."""
    q = exact_quantiles(df, {c: (lo, hi) for c in columns})
    return {c: (q[c][lo], q[c][hi]) for c in columns}


def treat(df: DataFrame, fitted: OutlierBounds, action: str = "clip") -> DataFrame:
    """clip, remove (rows with any outlier), flag (``{c}_outlier``), null, or log (signed ``log1p``)."""
    cols = [c for c in fitted.bounds if c in df.columns]
    if action == "remove":
        hit = F.lit(False)
        for c in cols:
            hit = hit | fitted.flag(c)
        return df.where(~hit)
    if action == "flag":
        return df.select("*", *[fitted.flag(c).alias(f"{c}_outlier") for c in cols])
    new = {}
    for c in cols:
        x = F.col(c).cast("double")
        if action == "clip":
            lo, hi = fitted.clip[c]
            new[c] = F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)
        elif action == "null":
            new[c] = F.when(~fitted.flag(c), x)
        elif action == "log":
            new[c] = F.signum(x) * F.log1p(F.abs(x))
        else:
            raise ValueError(f"unknown outlier action {action}")
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def summary(df: DataFrame, fitted: OutlierBounds) -> DataFrame:
    """Outlier count, share and the statistics of the outliers per column; one pass."""
    cols = list(fitted.bounds)
    x = lambda c: F.when(fitted.flag(c), F.col(c).cast("double"))
    return profile(df, cols, {
        "method": lambda c: F.lit(fitted.method),
        "outliers": lambda c: F.count_if(fitted.flag(c)),
        "pct": lambda c: F.try_divide(F.count_if(fitted.flag(c)) * 100.0, F.count(F.lit(1))),
        "min": lambda c: F.min(x(c)), "max": lambda c: F.max(x(c)),
        "mean": lambda c: F.avg(x(c)), "std": lambda c: F.stddev_samp(x(c)),
    }).orderBy(F.desc("outliers"), "column")


def outlier_values(df: DataFrame, fitted: OutlierBounds, id_col: str) -> DataFrame:
    """Long table ``(id, column, value, lo, hi)`` of every outlier cell; one scan, no shuffle."""
    hits = F.filter(F.array(*[
        F.when(fitted.flag(c), F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"),
                                        F.lit(b[0]).alias("lo"), F.lit(b[1]).alias("hi")))
        for c, b in fitted.bounds.items()]), lambda e: e.isNotNull())
    return df.select(id_col, F.explode(hits).alias("e")).select(id_col, "e.*")


def bounds_table(spark, fitted: OutlierBounds) -> DataFrame:
    return params_frame(spark, [(c, fitted.method, a, b) for c, (a, b) in fitted.bounds.items()],
                        "column string, method string, lo double, hi double")
