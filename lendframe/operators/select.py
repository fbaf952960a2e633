"""Feature selection and principal components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lendframe.operators.eda import correlation_matrix
from lendframe.operators.scale import fit_bins
from lendframe.operators.stats import ColumnStats, column_stats, params_frame


def low_variance(df: DataFrame, columns: list[str], threshold: float = 0.01, population: bool = False,
                 stats: dict[str, ColumnStats] | None = None) -> DataFrame:
    """Variance per column and whether it stays (above the threshold); no job where ``stats`` has the moments."""
    s = stats or column_stats(df, columns, quantiles=())
    v = {c: (st.std_pop if population else st.std) for c, st in s.items()}
    return params_frame(df.sparkSession, [(c, None if v[c] is None else v[c] ** 2, bool(v[c] is not None and v[c] ** 2 > threshold))
                                          for c in columns], "column string, variance double, keep boolean")


def correlated(df: DataFrame, columns: list[str], threshold: float = 0.95, keep_by: str = "order") -> list[str]:
    """Columns to drop: of each pair with |r| above the threshold the later one, or the one with less variance.

    The driver sees one number per column pair.
    """
    pairs = {(r["column_a"], r["column_b"]): r["r"] for r in correlation_matrix(df, columns).collect()}
    var = {c: (s.std or 0.0) for c, s in column_stats(df, columns, quantiles=()).items()} if keep_by == "variance" else {}
    dropped: list[str] = []
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            r = pairs.get((a, b))
            if r is None or abs(r) <= threshold or a in dropped or b in dropped:
                continue
            dropped.append((a if var[a] < var[b] else b) if keep_by == "variance" else b)
    return dropped


def cap_features(df: DataFrame, originals: list[str], generated: list[str], limit: int) -> list[str]:
    """Originals plus the generated features with the highest variance, up to the limit."""
    s = column_stats(df, generated, quantiles=())
    ranked = sorted(generated, key=lambda c: (-settled(s[c].std), c))
    return originals + ranked[: max(0, limit - len(originals))]


def bin_counts(df: DataFrame, edges: dict[str, list[float]], label: str) -> DataFrame:
    """``column, bin, <label>, n``: rows per bin and class of many columns; bin -1 counts the nulls.

    Counted by numpy per Arrow batch: a projection with every bin of every column would be too large for generated code.
    What a task sends on is one row per column, bin and class.
    """
    columns = list(edges)
    inner = [np.array(edges[c][1:-1], np.float64) for c in columns]

    def run(batches):
        total: dict = {}
        for b in batches:
            y = b.column(0).dictionary_encode()
            classes = [*y.dictionary.to_pylist(), None]
            k = len(classes)
            code = y.indices.fill_null(k - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, e in enumerate(inner):
                x = b.column(i + 1)
                at = np.searchsorted(e, x.fill_null(0.0).to_numpy(zero_copy_only=False), "right") + 1
                at[x.is_null().to_numpy(zero_copy_only=False)] = 0
                n = np.bincount(at * k + code, minlength=(len(e) + 2) * k)
                for j in np.flatnonzero(n).tolist():
                    key = (i, j // k - 1, classes[j % k])
                    total[key] = total.get(key, 0) + int(n[j])
        i, at, y, n = zip(*[(*key, v) for key, v in total.items()]) if total else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(at, pa.int32()), pa.array(y, label_type), pa.array(n, pa.int64())],
                                         names=["i", "bin", "y", "n"])
    from pyspark.sql.pandas.types import to_arrow_type
    label_type = to_arrow_type(df.schema[label].dataType)
    rows = df.select(F.col(label).alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    parts = rows.mapInArrow(run, f"i int, bin int, y {df.schema[label].dataType.simpleString()}, n bigint")
    names = F.array(*[F.lit(c) for c in columns])
    return parts.groupBy("i", "bin", "y").agg(F.sum("n").alias("n")).select(
        F.get(names, F.col("i")).alias("column"), "bin", F.col("y").alias(label), "n")


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 10, counts: dict[str, int] | None = None) -> DataFrame:
    """Binned mutual information (nats) per column: one (column, bin, label) count table, then sums over it.

    ``counts``: filled values per column, where they are known.
    """
    from lendframe.session import saved
    n = saved(bin_counts(df, fit_bins(df, columns, bins, counts=counts), label), "bins")  # columns x bins x classes rows, read four times
    by_bin = n.groupBy("column", "bin").agg(F.sum("n").alias("nb"))
    by_label = n.groupBy("column", label).agg(F.sum("n").alias("nl"))
    tot = n.groupBy("column").agg(F.sum("n").alias("nt"))
    j = n.join(by_bin, ["column", "bin"]).join(by_label, ["column", label]).join(tot, "column")
    return j.groupBy("column").agg(
        F.sum(F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("nb") * F.col("nl")))).alias("score"))


def anova_f(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """One-way F per column from class counts, means and variances: one shuffle of (columns x classes) rows.

    The spread between classes is summed from centred means, so that equal columns do not part by rounding.
    """
    cells = df.where(F.col(label).isNotNull()).select(label, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select(label, "e.*")
    g = cells.where("x is not null").groupBy("column", label).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("v"))
    every = Window.partitionBy("column")  # one row per class
    g = g.withColumn("gm", F.sum(F.col("n") * F.col("m")).over(every) / F.sum("n").over(every))
    s = g.groupBy("column").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("between"))
    return s.select("column", F.try_divide(F.col("between") / (F.col("k") - 1),
                                           F.col("within") / (F.col("n") - F.col("k"))).alias("score"))


def settled(score: float | None, digits: int = 9) -> float:
    """A score without the digits that rounding noise decides; ties then go by name."""
    return float(f"{score or 0.0:.{digits}g}")


def chi_square(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Sum of feature values per class against class share times the total; negative columns are shifted by their minimum."""
    st = column_stats(df, columns, quantiles=())
    shift = {c: -min(0.0, st[c].min or 0.0) for c in columns}
    cells = df.where(F.col(label).isNotNull()).select(label, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) + shift[c]).alias("x")) for c in columns
    ])).alias("e")).select(label, "e.*")
    g = cells.groupBy("column", label).agg(F.sum("x").alias("o"), F.count(F.lit(1)).alias("n"))
    t = g.groupBy("column").agg(F.sum("o").alias("to"), F.sum("n").alias("tn"))
    e = F.col("n") / F.col("tn") * F.col("to")
    return g.join(t, "column").groupBy("column").agg(F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("score"))


SCORES: dict[str, Callable[[DataFrame, list[str], str], DataFrame]] = {
    "mutual_info": mutual_information, "f_classif": anova_f, "chi2": chi_square}


def select_best(df: DataFrame, columns: list[str], label: str, k: int | None = None, percentile: float | None = None,
                score: str | Callable[[DataFrame, str, str], Column] = "mutual_info", counts: dict[str, int] | None = None) -> list[str]:
    """The k best (or best percentile of) columns. A custom score maps (frame, feature, label) to an aggregate column."""
    if callable(score):
        r = df.agg(*[score(df, c, label).alias(c) for c in columns]).first()
        got = {c: r[c] for c in columns}
    elif score == "mutual_info":
        got = {r["column"]: r["score"] for r in mutual_information(df, columns, label, counts=counts).collect()}  # one row per column
    else:
        got = {r["column"]: r["score"] for r in SCORES[score](df, columns, label).collect()}  # one row per column
    n = k if k is not None else max(1, int(len(columns) * (percentile or 100.0) / 100.0))
    return sorted(columns, key=lambda c: (-settled(got.get(c)), c))[:n]


def covariance(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector, sample covariance and row count of complete rows (Spark's summarizer over a vector column)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    d = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    s = column_stats(d, columns, quantiles=())
    v = VectorAssembler(inputCols=columns, outputCol="v").transform(d).select("v")
    r = Correlation.corr(v, "v").first()[0].toArray()
    sd = np.array([s[c].std for c in columns])
    return np.array([s[c].mean for c in columns]), np.nan_to_num(r, nan=0.0) * np.outer(sd, sd), s[columns[0]].count


def fit_pca(df: DataFrame, columns: list[str], components: int | float | str = 2) -> dict:
    """Components by number, by explained-variance share, or all ('mle' keeps those above mean variance).

    Only the d x d covariance reaches the driver; d is the number of columns.
    """
    mean, cov, n = covariance(df, columns)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(val)[::-1]
    val, vec = np.maximum(val[order], 0.0), vec[:, order]
    sign = np.sign(vec[np.abs(vec).argmax(axis=0), range(len(columns))])
    vec = vec * np.where(sign == 0, 1.0, sign)
    ratio = val / val.sum()
    if components == "mle":
        k = max(1, int((val > val.mean()).sum()))
    elif isinstance(components, float) and components < 1:
        k = int(np.searchsorted(np.cumsum(ratio), components) + 1)
    else:
        k = int(components)
    return {"columns": columns, "mean": mean, "vectors": vec[:, :k], "variance": val[:k], "ratio": ratio[:k], "n": n}


def apply_pca(df: DataFrame, p: dict, whiten: bool = False) -> DataFrame:
    """Centre, project, and for ``whiten`` divide by the root variance; columns ``pc1..pck``."""
    new = []
    for j in range(p["vectors"].shape[1]):
        s = F.lit(0.0)
        for i, c in enumerate(p["columns"]):
            s = s + (F.col(c).cast("double") - float(p["mean"][i])) * float(p["vectors"][i, j])
        if whiten:
            s = s / float(np.sqrt(p["variance"][j]) or 1.0)
        new.append(s.alias(f"pc{j + 1}"))
    return df.select("*", *new)


def loadings(spark, p: dict) -> DataFrame:
    return params_frame(spark, [(c, j + 1, float(p["vectors"][i, j])) for i, c in enumerate(p["columns"])
                                for j in range(p["vectors"].shape[1])], "column string, component int, loading double")


def recursive_elimination(df: DataFrame, columns: list[str], label: str, keep: int | float = 0.5, step: int = 1,
                          estimator: str = "forest", trees: int = 50) -> list[tuple[str, int]]:
    """Drop the least important features until ``keep`` are left; returns ``(column, rank)``, rank 1 kept."""
    from lendframe.operators.models import assemble, fit_forest, fit_logistic, importances
    keep = keep if isinstance(keep, int) else max(1, int(len(columns) * keep))
    left, rank = list(columns), {}
    data = assemble(df, columns, label, out=None).persist()
    level = 0
    gone: list[list[str]] = []
    while len(left) > keep:
        x = assemble(data, left, label)
        m = fit_forest(x, label, trees=trees) if estimator == "forest" else fit_logistic(x, label)
        imp = importances(m, left)
        worst = sorted(left, key=lambda c: (imp[c], c))[: min(step, len(left) - keep)]
        gone.append(worst)
        left = [c for c in left if c not in worst]
    data.unpersist()
    for c in left:
        rank[c] = 1
    for level, names in enumerate(reversed(gone), start=2):
        for c in names:
            rank[c] = level
    return [(c, rank[c]) for c in columns]


def from_importance(df: DataFrame, columns: list[str], label: str, trees: int = 50) -> list[str]:
    """Columns whose forest importance reaches the median importance."""
    from lendframe.operators.models import assemble, fit_forest, importances
    imp = importances(fit_forest(assemble(df, columns, label), label, trees=trees), columns)
    mid = float(np.median(list(imp.values())))
    return [c for c in columns if imp[c] >= mid]


