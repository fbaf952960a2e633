"""Exploratory statistics as aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lendframe.operators.stats import (
    ColumnStats, column_stats, exact_quantiles, numeric_columns, params_frame, profile)


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Type, non-null and null counts and null share per column; one pass."""
    types = dict(df.dtypes)
    return profile(df, columns or df.columns, {
        "dtype": lambda c: F.lit(types[c]),
        "non_null": lambda c: F.count(F.col(c)),
        "nulls": lambda c: F.count_if(F.col(c).isNull()),
        "null_pct": lambda c: F.round(F.try_divide(F.count_if(F.col(c).isNull()) * 100.0, F.count(F.lit(1))), 2),
    })


def describe(df: DataFrame, columns: list[str] | None = None, digits: int = 2) -> DataFrame:
    """count, mean, std, min, exact quartiles and max per numeric column."""
    stats = column_stats(df, columns)
    out = params_frame(df.sparkSession, [
        (c, s.count, s.mean, s.std, s.min, s.q(0.25), s.q(0.5), s.q(0.75), s.max) for c, s in stats.items()],
        "column string, count bigint, mean double, std double, min double, q25 double, q50 double, "
        "q75 double, max double")
    return out.select("column", "count", *[F.round(c, digits).alias(c) for c in out.columns[2:]])


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts and shares per value, most frequent first."""
    total = df.count()  # one number
    out = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("cnt")).withColumn(
        "pct", F.round(F.col("cnt") * 100.0 / F.lit(max(total, 1)), 4))
    out = out.orderBy(F.desc("cnt"), F.asc("value"))
    return out.limit(top) if top else out


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and shares per (column, value) for many columns in one scan."""
    from lendframe.operators.stats import long_cells
    counts = long_cells(df, columns).where("value is not null").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("cnt"))
    totals = counts.groupBy("column").agg(F.sum("cnt").alias("total"))
    return counts.join(totals, "column").select(
        "column", "value", "cnt", F.round(F.col("cnt") * 100.0 / F.col("total"), 4).alias("pct"))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairwise-complete correlation of all column pairs.

    A few columns use ``corr`` directly. For more, d*d aggregate expressions no
    longer compile well, so each task turns its Arrow batches into d x d matrices
    of centred cross products and only those partial matrices are shuffled.
    """
    cols = columns or numeric_columns(df)
    if len(cols) <= 6:
        pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
        rows = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                                  F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"))
                         for a, b in pairs])
        return df.agg(rows.alias("_r")).selectExpr("inline(_r)")
    stats = column_stats(df, cols, quantiles=())
    means = np.array([stats[c].mean or 0.0 for c in cols])
    d = len(cols)

    def partial(batches):
        total = np.zeros((6, d, d))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - means
            m = ~np.isnan(x)
            x = np.where(m, x, 0.0)
            m = m.astype(float)
            x2 = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, x.T @ x, x2.T @ m, m.T @ x2])
        i, j = np.triu_indices(d, 1)
        yield pd.DataFrame({"i": i, "j": j, **{f"s{k}": total[k][i, j] for k in range(6)}})

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(
        partial, "i int, j int, s0 double, s1 double, s2 double, s3 double, s4 double, s5 double")
    s = parts.groupBy("i", "j").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(6)])
    n = F.col("s0")
    r = (n * F.col("s3") - F.col("s1") * F.col("s2")) / F.sqrt(
        (n * F.col("s4") - F.col("s1") * F.col("s1")) * (n * F.col("s5") - F.col("s2") * F.col("s2")))
    names = F.array(*[F.lit(c) for c in cols])
    return s.select(F.element_at(names, F.col("i") + 1).alias("column_a"),
                    F.element_at(names, F.col("j") + 1).alias("column_b"),
                    F.when((n * F.col("s4") - F.col("s1") * F.col("s1") > 0)
                           & (n * F.col("s5") - F.col("s2") * F.col("s2") > 0), r).alias("r"))


def correlation_with(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """Correlation of every column with the target, strongest first, with its direction."""
    cols = [c for c in (columns or numeric_columns(df)) if c != target]
    return profile(df, cols, {"r": lambda c: F.corr(F.col(c).cast("double"), F.col(target).cast("double"))}).select(
        "column", "r", F.abs("r").alias("abs_r"),
        F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction")
    ).orderBy(F.desc_nulls_last("abs_r"), "column")


def trimmed_stats(df: DataFrame, columns: list[str], method: str = "iqr") -> DataFrame:
    """Mean and median of values inside 1.5 IQR fences or the 5th to 95th percentile."""
    probs = (0.25, 0.75) if method == "iqr" else (0.05, 0.95)
    q = exact_quantiles(df, {c: probs for c in columns})
    bounds = {}
    for c in columns:
        a, b = (q[c][p] for p in probs)
        bounds[c] = (a - 1.5 * (b - a), b + 1.5 * (b - a)) if method == "iqr" else (a, b)
    kept = df.select(*[F.when(F.col(c).between(*bounds[c]), F.col(c)).alias(c) for c in columns])
    stats = column_stats(kept, columns, quantiles=(0.5,))
    return params_frame(df.sparkSession, [(c, s.count, s.mean, s.q(0.5)) for c, s in stats.items()],
                        "column string, kept bigint, mean double, median double")


def histogram(df: DataFrame, column: str, bins: int = 30, lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """Equal-width histogram: bin number (0-based), left edge, count; empty bins are left out."""
    if lo is None or hi is None:
        s = column_stats(df, [column], quantiles=())[column]
        lo, hi = (s.min if lo is None else lo), (s.max if hi is None else hi)
    width = (hi - lo) / bins if hi > lo else 1.0
    x = F.col(column).cast("double")
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1).cast("bigint"))
    return df.where(x.between(lo, hi)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("cnt")).withColumn(
        "left_edge", F.lit(lo) + F.col("bin") * F.lit(width))


def crosstab_share(df: DataFrame, column: str, label: str) -> DataFrame:
    """Share of label 0 and 1 per category; one hash aggregate."""
    return df.groupBy(column).agg(
        F.round(F.avg(F.when(F.col(label) == 0, 1.0).otherwise(0.0)), 6).alias("share_0"),
        F.round(F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0)), 6).alias("share_1"))


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularized incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def t_p_value(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300))
                     + b * math.log(max(1.0 - x, 1e-300)))
    if x < (a + 1.0) / (a + b + 2.0):
        return min(1.0, front * _beta_cf(a, b, x) / a)
    return max(0.0, 1.0 - front * _beta_cf(b, a, 1.0 - x) / b)


def class_t_tests(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Pooled two-sample t-test of label 1 against 0 per column, with stars; one pass."""
    aggs = []
    for i, c in enumerate(columns):
        for k in (0, 1):
            x = F.when(F.col(label) == k, F.col(c).cast("double"))
            aggs += [F.count(x).alias(f"n{i}_{k}"), F.avg(x).alias(f"m{i}_{k}"), F.var_samp(x).alias(f"v{i}_{k}")]
    r = df.agg(*aggs).first()
    rows = []
    for i, c in enumerate(columns):
        n0, n1 = r[f"n{i}_0"], r[f"n{i}_1"]
        t = p = None
        if n0 > 1 and n1 > 1:
            pooled = ((n0 - 1) * r[f"v{i}_0"] + (n1 - 1) * r[f"v{i}_1"]) / (n0 + n1 - 2)
            if pooled > 0:
                t = (r[f"m{i}_1"] - r[f"m{i}_0"]) / math.sqrt(pooled * (1.0 / n0 + 1.0 / n1))
                p = t_p_value(t, n0 + n1 - 2)
        stars = "" if p is None else "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "ns"
        rows.append((c, n0, n1, r[f"m{i}_0"], r[f"m{i}_1"], t, p, stars))
    return params_frame(df.sparkSession, rows,
                        "column string, n0 bigint, n1 bigint, mean0 double, mean1 double, t double, p double, "
                        "stars string")


def box_numbers(df: DataFrame, columns: list[str], label: str, classes: tuple = (0, 1)) -> DataFrame:
    """Quartiles, whiskers (last value inside 1.5 IQR) and outlier count per class.

    Each (column, class) is a masked column, so the exact quantiles of all of
    them come from the same passes and no class gathers in one task.
    """
    masked = df.select(*[F.when(F.col(label) == k, F.col(c).cast("double")).alias(f"{c}__{k}")
                         for c in columns for k in classes])
    stats = column_stats(masked, masked.columns)
    fences = {m: s.fences() for m, s in stats.items()}
    r = masked.agg(*[e for m in masked.columns for e in (
        F.min(F.when(F.col(m) >= fences[m][0], F.col(m))).alias(f"{m}__lo"),
        F.max(F.when(F.col(m) <= fences[m][1], F.col(m))).alias(f"{m}__hi"),
        F.count_if(~F.col(m).between(*fences[m])).alias(f"{m}__out")) if fences[m]]).first()
    rows = []
    for c in columns:
        for k in classes:
            m = f"{c}__{k}"
            s: ColumnStats = stats[m]
            if fences[m]:
                rows.append((c, int(k), s.q(0.25), s.q(0.5), s.q(0.75), r[f"{m}__lo"], r[f"{m}__hi"], r[f"{m}__out"]))
    return params_frame(df.sparkSession, rows,
                        "column string, label int, q25 double, q50 double, q75 double, whisker_lo double, "
                        "whisker_hi double, outliers bigint")


def completeness_totals(df: DataFrame) -> DataFrame:
    """Cells, missing cells and completeness in percent."""
    d = len(df.columns)
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0).cast("bigint"))
    return df.agg((F.count(F.lit(1)) * d).alias("cells"), missing.alias("missing")).withColumn(
        "completeness_pct", F.round((F.col("cells") - F.col("missing")) * 100.0 / F.col("cells"), 4))


def feature_quality(df: DataFrame, exclude: tuple[str, ...] = ("application_date",)) -> DataFrame:
    """100 minus the null percentage, minus 10 for near-unique text columns.

    Distinct counts come from combined (column, value) pairs, so no value list is held in one task.
    """
    from lendframe.operators.stats import long_cells
    cols = [c for c in df.columns if c not in exclude]
    types = dict(df.dtypes)
    names = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    per_value = long_cells(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return per_value.groupBy("column").agg(
        F.sum("cnt").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("unique_values"),
    ).select(
        "column", names[F.col("column")].alias("dtype"), "unique_values",
        F.round(F.col("nulls") * 100.0 / F.col("rows"), 2).alias("missing_pct"),
        F.round(F.col("unique_values") / F.col("rows"), 4).alias("unique_ratio"),
        F.round(100.0 - F.col("nulls") * 100.0 / F.col("rows")
                - F.when((F.col("unique_values") / F.col("rows") > 0.95)
                         & (names[F.col("column")] == "string"), 10.0).otherwise(0.0), 1).alias("quality_score"))
