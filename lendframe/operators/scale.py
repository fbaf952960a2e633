"""Scaling, power and quantile transforms, binning.

Every fit is one or two aggregate passes for all columns; every transform is a
projection with literal parameters and has an inverse where one exists.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from lendframe.operators.ranking import running_totals
from lendframe.operators.stats import (
    ColumnStats, column_stats, exact_quantiles, modes, numeric_cells, numeric_columns, params_frame, profile, string_columns)


@dataclass
class Scaler:
    """``(x - center) / scale`` per column, after an optional power transform."""

    method: dict[str, str] = field(default_factory=dict)
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    lam: dict[str, float] = field(default_factory=dict)
    shift: dict[str, float] = field(default_factory=dict)


def yeo_johnson(x: Column, lam: float) -> Column:
    pos = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1.0, F.lit(lam)) - 1.0) / lam
    two = 2.0 - lam
    neg = -F.log1p(-x) if abs(two) < 1e-12 else -(F.pow(1.0 - x, F.lit(two)) - 1.0) / two
    return F.when(x >= 0, pos).otherwise(F.when(x < 0, neg))


def yeo_johnson_inverse(y: Column, lam: float) -> Column:
    pos = F.expm1(y) if abs(lam) < 1e-12 else F.pow(y * lam + 1.0, F.lit(1.0 / lam)) - 1.0
    two = 2.0 - lam
    neg = -F.expm1(-y) if abs(two) < 1e-12 else 1.0 - F.pow(1.0 - two * y, F.lit(1.0 / two))
    return F.when(y >= 0, pos).otherwise(F.when(y < 0, neg))


def box_cox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1.0) / lam


def log_likelihoods(df: DataFrame, columns: list[str], lams: dict[str, list[float]], kind: str = "yeo-johnson",
                    shift: dict[str, float] | None = None) -> dict[str, list[float]]:
    """Profile log-likelihood of each lambda of each column: one aggregate pass.

    ``-n/2 * ln(var(y)) + (lambda - 1) * sum(ln jacobian)``.
    """
    shift = shift or {}
    moved = df.select(*[(F.col(c).cast("double") + shift.get(c, 0.0)).alias(c) for c in columns])
    if kind == "yeo-johnson":
        rows = _yeo_johnson_sums(moved, [np.array(lams[c], dtype=float) for c in columns]).collect()
    else:
        grid = F.element_at(F.array(*[F.lit(np.array(lams[c], dtype=float)) for c in columns]), F.col("i") + 1)
        cells = numeric_cells(moved, columns).where("x is not null").select("i", "x", F.posexplode(grid).alias("k", "lam"))
        x, lam = F.col("x"), F.col("lam")
        y = F.when(F.abs(lam) < 1e-12, F.log(x)).otherwise((F.pow(x, lam) - 1.0) / lam)
        rows = cells.groupBy("i", "k").agg(F.count(y).alias("n"), F.sum(F.log(x)).alias("j"), F.var_pop(y).alias("v")).collect()
    out = {c: [-math.inf] * len(lams[c]) for c in columns}
    for r in rows:  # columns x lambdas rows
        if r["v"]:
            c = columns[r["i"]]
            out[c][r["k"]] = -0.5 * r["n"] * math.log(r["v"]) + (lams[c][r["k"]] - 1.0) * r["j"]
    return out


def _yeo_johnson_sums(df: DataFrame, grid: list[np.ndarray]) -> DataFrame:
    """``i, k, n, j, v``: rows, logarithm of the jacobian and variance of column ``i`` at its lambda ``k``.

    Numpy takes one logarithm a value for all lambdas; a task sends on one row per column and lambda.
    """
    def run(batches):
        held: dict[int, tuple] = {}  # rows, jacobian, mean and squared deviations by lambda, smallest and largest value
        with np.errstate(all="ignore"):
            for b in batches:
                for i, lam in enumerate(grid):
                    x = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                    if not len(x):
                        continue
                    log, low = np.log1p(np.abs(x)), x < 0
                    sign = np.where(low, -1.0, 1.0)
                    y = np.empty((len(lam), len(x)))
                    for k, at in enumerate(lam):
                        power = np.where(low, 2.0 - at, at) if low.any() else at
                        flat = np.abs(power) < 1e-12
                        y[k] = sign * np.where(flat, log, np.expm1(power * log) / np.where(flat, 1.0, power))
                    mean = y.mean(axis=1)
                    part = len(x), np.sum(sign * log), mean, np.sum((y - mean[:, None]) ** 2, axis=1), x.min(), x.max()
                    held[i] = _merged(held[i], part) if i in held else part
        for i, (n, j, mean, dev, lo, hi) in held.items():
            size = len(mean)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, i, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n, np.int64)),
                 pa.array(np.full(size, j)), pa.array(mean), pa.array(dev), pa.array(np.full(size, lo)), pa.array(np.full(size, hi))],
                names=["i", "k", "n", "j", "mean", "dev", "lo", "hi"])

    def merge(key, t):
        out = None
        for r in t.itertuples():  # one a task
            part = r.n, r.j, r.mean, r.dev, r.lo, r.hi
            out = part if out is None else _merged(out, part)
        # equal values have no variance, whatever the rounding of their powers
        return pd.DataFrame([(*key, out[0], out[1], 0.0 if out[4] == out[5] else out[3] / out[0])], columns=["i", "k", "n", "j", "v"])
    parts = df.mapInArrow(run, "i int, k int, n bigint, j double, mean double, dev double, lo double, hi double")
    return parts.groupBy("i", "k").applyInPandas(merge, "i int, k int, n bigint, j double, v double")


def _merged(a: tuple, b: tuple) -> tuple:
    """Rows, sum, mean, squared deviations, smallest and largest value of two parts together."""
    n, gap = a[0] + b[0], b[2] - a[2]
    return n, a[1] + b[1], a[2] + gap * (b[0] / n), a[3] + b[3] + gap * gap * (a[0] * b[0] / n), np.minimum(a[4], b[4]), np.maximum(a[5], b[5])


def fit_lambda(df: DataFrame, columns: list[str], kind: str = "yeo-johnson", shift: dict[str, float] | None = None,
               lo: float = -3.0, hi: float = 3.0, points: int = 13, rounds: int = 4) -> dict[str, float]:
    """Maximum-likelihood lambda by grid refinement; each round is one pass over all columns."""
    window = {c: (lo, hi) for c in columns}
    best: dict[str, float] = {}
    for _ in range(rounds):
        grid = {c: [a + (b - a) * k / (points - 1) for k in range(points)] for c, (a, b) in window.items()}
        ll = log_likelihoods(df, columns, grid, kind, shift)
        for c in columns:
            k = max(range(points), key=lambda m: ll[c][m])
            step = (window[c][1] - window[c][0]) / (points - 1)
            best[c] = grid[c][k]
            if 0 < k < points - 1 and all(map(math.isfinite, ll[c][k - 1:k + 2])):
                a, b, d = ll[c][k - 1], ll[c][k], ll[c][k + 1]
                if a - 2 * b + d < 0:
                    best[c] = grid[c][k] + 0.5 * step * (a - d) / (a - 2 * b + d)
            window[c] = (best[c] - step, best[c] + step)
    return best


def scaler_from_stats(stats: dict[str, ColumnStats], method: str | dict[str, str] = "standard",
                      quantile_range: tuple[float, float] = (0.25, 0.75)) -> Scaler:
    s = Scaler()
    for c, st in stats.items():
        m = method if isinstance(method, str) else method.get(c, "none")
        if m == "none" or st.count == 0:
            continue
        s.method[c] = m
        if m == "standard":
            s.center[c], s.scale[c] = st.mean, st.std_pop or 1.0
        elif m == "minmax":
            s.center[c], s.scale[c] = st.min, (st.max - st.min) or 1.0
        elif m == "robust":
            a, b = (st.q(p) for p in quantile_range)
            s.center[c], s.scale[c] = st.q(0.5), (b - a) or 1.0
        elif m not in ("power", "box-cox"):
            raise ValueError(f"unknown scaling method {m}")
    return s


def fit_scaler(df: DataFrame, columns: list[str], method: str | dict[str, str] = "standard", *,
               quantile_range: tuple[float, float] = (0.25, 0.75), standardize: bool = True,
               stats: dict[str, ColumnStats] | None = None) -> Scaler:
    """standard (population deviation), minmax, robust, power (Yeo-Johnson), box-cox, or auto per column."""
    if stats is None:
        qs = tuple(sorted({0.25, 0.5, 0.75, *quantile_range}))
        methods = {method} if isinstance(method, str) else set(method.values())
        stats = column_stats(df, columns, quantiles=qs if methods & {"robust", "auto"} else (), shape="auto" in methods)
    if method == "auto":
        method = {c: d["method"] for c, d in choose_methods(df, columns, stats).items()}
    s = scaler_from_stats({c: stats[c] for c in columns}, method, quantile_range)
    for kind, name in (("yeo-johnson", "power"), ("box-cox", "box-cox")):
        cols = [c for c, m in s.method.items() if m == name]
        if not cols:
            continue
        if kind == "box-cox":
            s.shift.update({c: (abs(stats[c].min) + 1.0) if stats[c].min <= 0 else 0.0 for c in cols})
        s.lam.update(fit_lambda(df, cols, kind, s.shift))
        if standardize:
            powered = df.select(*[_power(s, c).alias(c) for c in cols])
            for c, st in column_stats(powered, cols, quantiles=()).items():
                s.center[c], s.scale[c] = st.mean, st.std_pop or 1.0
        else:
            s.center.update({c: 0.0 for c in cols})
            s.scale.update({c: 1.0 for c in cols})
    return s


def _power(s: Scaler, c: str) -> Column:
    x = F.col(c).cast("double")
    if s.method[c] == "power":
        return yeo_johnson(x, s.lam[c])
    return box_cox(x + s.shift[c], s.lam[c])


def apply_scaler(df: DataFrame, s: Scaler) -> DataFrame:
    out = []
    for c in df.columns:
        if c in s.center:
            x = _power(s, c) if c in s.lam else F.col(c).cast("double")
            out.append(((x - F.lit(s.center[c])) / F.lit(s.scale[c])).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def invert_scaler(df: DataFrame, s: Scaler) -> DataFrame:
    out = []
    for c in df.columns:
        if c in s.center:
            y = F.col(c) * F.lit(s.scale[c]) + F.lit(s.center[c])
            if s.method[c] == "power":
                y = yeo_johnson_inverse(y, s.lam[c])
            elif s.method[c] == "box-cox":
                lam = s.lam[c]
                y = (F.exp(y) if abs(lam) < 1e-12 else F.pow(y * lam + 1.0, F.lit(1.0 / lam))) - s.shift[c]
            out.append(y.alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def iqr_outlier_counts(df: DataFrame, stats: dict[str, ColumnStats], k: float = 1.5) -> dict[str, int]:
    cols = [c for c, s in stats.items() if s.fences(k)]
    if not cols:
        return {}
    r = df.agg(*[F.count_if(~F.col(c).cast("double").between(*stats[c].fences(k))).alias(f"o{i}")
                 for i, c in enumerate(cols)]).first()
    return {c: r[i] for i, c in enumerate(cols)}


def choose_methods(df: DataFrame, columns: list[str], stats: dict[str, ColumnStats] | None = None) -> dict[str, dict]:
    """Method per column: under 10 values standard; strong skew power; many outliers robust;
    inside [0, 1] or [0, 100] minmax; else standard."""
    stats = stats or column_stats(df, columns)
    outliers = iqr_outlier_counts(df, {c: stats[c] for c in columns})
    out = {}
    for c in columns:
        s = stats[c]
        ratio = outliers.get(c, 0) / s.count if s.count else 0.0
        if s.count < 10:
            m = "standard"
        elif s.skew is not None and abs(s.skew) > 2:
            m = "power"
        elif ratio > 0.1:
            m = "robust"
        elif s.min >= 0 and s.max <= 100:
            m = "minmax"
        else:
            m = "standard"
        out[c] = {"method": m, "skew": s.skew, "outlier_ratio": ratio}
    return out


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """mean, std, range, quartiles, adjusted skewness and kurtosis, null share, distinct, IQR outliers."""
    stats = column_stats(df, columns, distinct=True)
    out = iqr_outlier_counts(df, stats)
    return params_frame(df.sparkSession, [
        (c, s.mean, s.std, s.min, s.max, s.q(0.25), s.q(0.5), s.q(0.75), s.skew, s.kurt,
         100.0 * s.nulls / s.n if s.n else None, s.distinct, out.get(c, 0)) for c, s in stats.items()],
        "column string, mean double, std double, min double, max double, q25 double, q50 double, q75 double, "
        "skewness double, kurtosis double, missing_pct double, unique_values bigint, outliers_iqr bigint")


def auto_assign(df: DataFrame, columns: list[str]) -> DataFrame:
    """Which columns to scale (deviation above 0), treat (over 5 % outliers) and normalize (skewed, not treated)."""
    stats = column_stats(df, columns)
    out = iqr_outlier_counts(df, stats)
    rows = []
    for c, s in stats.items():
        many = out.get(c, 0) > s.n * 0.05
        rows.append((c, bool(s.std and s.std > 0), many, bool(s.skew is not None and abs(s.skew) > 2 and not many)))
    return params_frame(df.sparkSession, rows, "column string, scale boolean, treat_outliers boolean, normalize boolean")


# --- quantile transform -------------------------------------------------------------------------

@dataclass
class QuantileMap:
    """Knots ``(value, lowest reference, highest reference)`` per column, strictly increasing in value."""

    knots: dict[str, list[tuple[float, float, float]]]


def fit_quantile_map(df: DataFrame, columns: list[str], n_quantiles: int = 1000) -> QuantileMap:
    """At most ``n_quantiles`` quantiles per column (never more than rows), exact at any size.

    Values are folded to counts, and running totals over ordered buckets give each value the ranks it covers; only the
    values at wanted ranks reach the driver, so all knots of all columns come from one pass.
    """
    counts = df.agg(*[F.count(c) for c in columns]).first()
    counts = dict(zip(columns, counts, strict=True))
    probs = {}
    for c in columns:
        m = max(2, min(n_quantiles, counts[c]))
        probs[c] = tuple(k / (m - 1) for k in range(m))
    qs = evenly_spaced(df, columns, probs, counts)
    knots = {}
    for c in columns:
        ks: list[tuple[float, float, float]] = []
        for p in probs[c]:
            v = qs[c][p]
            if ks and v <= ks[-1][0]:
                ks[-1] = (ks[-1][0], ks[-1][1], p)
            else:
                ks.append((v, p, p))
        knots[c] = ks
    return QuantileMap(knots)


def evenly_spaced(df: DataFrame, columns: list[str], probs: dict[str, tuple[float, ...]],
                  counts: dict[str, int]) -> dict[str, dict[float, float | None]]:
    """Linear-interpolated quantiles at evenly spaced probabilities from 0 to 1."""
    n = F.get(F.lit(np.array([counts[c] for c in columns], dtype=np.int64)), F.col("i"))
    steps = F.get(F.lit(np.array([len(probs[c]) - 1 for c in columns], dtype=np.int64)), F.col("i"))
    cells = numeric_cells(df, columns).where("x is not null").groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"))
    runs = running_totals(cells, "x", ["n"], ["i"])
    lo, hi = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1  # the ranks that a value covers
    rank = lambda k: F.floor(k / steps * (n - 1))
    # candidates with a step to spare on either side, then the exact test
    scale_ = steps / F.greatest(n - 1, F.lit(1))
    span = F.sequence(F.greatest(F.floor((lo - 1) * scale_) - 1, F.lit(0)), F.least(F.ceil((hi + 1) * scale_) + 1, steps))
    at = lambda side: F.filter(span, lambda k: F.least(rank(k) + side, n - 1).between(lo, hi))
    picked = runs.select("i", "x", F.explode(F.concat(
        F.transform(at(0), lambda k: F.struct(k.alias("k"), F.lit(0).alias("side"))),
        F.transform(at(1), lambda k: F.struct(k.alias("k"), F.lit(1).alias("side"))))).alias("e")).select("i", "x", "e.*")
    got = {(r["i"], r["k"], r["side"]): r["x"] for r in picked.collect()}  # two per knot
    out: dict[str, dict[float, float | None]] = {}
    for i, c in enumerate(columns):
        out[c] = {}
        for k, p in enumerate(probs[c]):
            pos = p * (counts[c] - 1)
            f = pos - math.floor(pos)
            a, b = got.get((i, k, 0)), got.get((i, k, 1))
            out[c][p] = None if a is None else a if f == 0 or a == b else (1 - f) * a + f * b
    return out


def apply_quantile_map(df: DataFrame, q: QuantileMap, output: str = "uniform") -> DataFrame:
    """Interpolate between knots; a value equal to a repeated knot takes the middle of its references.

    The knot is found by the JVM-side binary search of ``Bucketizer``.
    """
    for c, ks in q.knots.items():
        if len(ks) < 2:
            df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.lit(0.0)))
            continue
        splits = [k[0] for k in ks]
        idx = f"_k_{c}"
        df = df.withColumn(c, F.col(c).cast("double"))
        df = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol=c, outputCol=idx,
                        handleInvalid="keep").transform(df)
        x, i = F.col(c), F.col(idx).cast("int")  # i = number of knots <= x
        val, low, high = (F.lit(np.array([k[m] for k in ks])) for m in range(3))
        at = lambda a, j: F.get(a, j - 1)
        inner = at(high, i) + (at(low, i + 1) - at(high, i)) * (x - at(val, i)) / (at(val, i + 1) - at(val, i))
        u = (F.when(x.isNull(), None).when(x <= splits[0], F.lit(0.0)).when(x >= splits[-1], F.lit(1.0))
             .when(x == at(val, i), (at(low, i) + at(high, i)) / 2).otherwise(inner))
        df = df.withColumn(c, probit(u) if output == "normal" else u).drop(idx)
    return df


def probit(u: Column) -> Column:
    """Inverse normal distribution by a rational approximation, inputs clipped to [1e-7, 1 - 1e-7]."""
    # Coefficients of Acklam's published approximation.
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]

    def poly(coefs, x, last=None):
        acc = F.lit(coefs[0])
        for k in coefs[1:]:
            acc = acc * x + k
        return acc if last is None else acc * x + last

    p = F.greatest(F.least(u, F.lit(1 - 1e-7)), F.lit(1e-7))
    r = (p - 0.5) * (p - 0.5)
    mid = poly(a, r) * (p - 0.5) / poly(b, r, 1.0)
    ql = F.sqrt(-2.0 * F.log(p))
    qh = F.sqrt(-2.0 * F.log(1.0 - p))
    tail = lambda q: poly(c, q) / poly(d, q, 1.0)
    return F.when(u.isNull(), None).when(p < 0.02425, tail(ql)).when(p > 1 - 0.02425, -tail(qh)).otherwise(mid)


# --- binning ------------------------------------------------------------------------------------

def fit_bins(df: DataFrame, columns: list[str], n_bins: int = 5, strategy: str = "quantile",
             counts: dict[str, int] | None = None) -> dict[str, list[float]]:
    """Bin edges per column: quantile (repeated edges merged) or uniform."""
    if strategy == "uniform":
        st = column_stats(df, columns, quantiles=())
        return {c: [s.min + (s.max - s.min) * k / n_bins for k in range(n_bins + 1)] for c, s in st.items()}
    if strategy == "quantile":
        probs = tuple(k / n_bins for k in range(n_bins + 1))
        q = exact_quantiles(df, {c: probs for c in columns}, counts)
        out = {}
        for c in columns:
            edges: list[float] = []
            for p in probs:
                if not edges or q[c][p] > edges[-1]:
                    edges.append(q[c][p])
            out[c] = edges
        return out
    if strategy == "kmeans":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler
        out = {}
        st = column_stats(df, columns, quantiles=())
        for c in columns:
            x = VectorAssembler(inputCols=[c], outputCol="_v").transform(
                df.select(F.col(c).cast("double").alias(c)).dropna())
            centers = sorted(v[0] for v in KMeans(k=n_bins, seed=1, featuresCol="_v").fit(x).clusterCenters())
            out[c] = [st[c].min, *[(a + b) / 2 for a, b in zip(centers, centers[1:])], st[c].max]
        return out
    raise ValueError(f"unknown bin strategy {strategy}")


def bin_ordinal(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Replace a value by its bin number; bins are closed on the left, ends are open to both sides."""
    out = []
    for c in df.columns:
        if c in edges:
            inner = edges[c][1:-1]
            x = F.col(c).cast("double")
            code = sum((F.when(x >= F.lit(e), 1).otherwise(0) for e in inner), F.lit(0))
            out.append(F.when(x.isNotNull(), code).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def cut(x: Column, edges: list[float]) -> Column:
    """Right-closed fixed bins numbered from 0; values outside all bins give null."""
    out = F.when(F.lit(False), F.lit(0))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        hi = F.lit(True) if b == math.inf else x <= F.lit(float(b))
        out = out.when((x > F.lit(float(a))) & hi, F.lit(k))
    return out


# --- reports ------------------------------------------------------------------------------------

def scaling_summary(df: DataFrame, s: Scaler) -> DataFrame:
    """Method with mean, population deviation, min and max before and after scaling."""
    cols = list(s.center)
    meas = {"mean": lambda c: F.avg(c), "std": lambda c: F.stddev_pop(c), "min": lambda c: F.min(c),
            "max": lambda c: F.max(c)}
    before = profile(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols, meas)
    after = profile(apply_scaler(df.select(*cols), s), cols, meas)
    m = params_frame(df.sparkSession, [(c, s.method[c]) for c in cols], "column string, method string")
    b = before.select("column", *[F.col(k).alias(f"{k}_before") for k in meas])
    a = after.select("column", *[F.col(k).alias(f"{k}_after") for k in meas])
    return m.join(b, "column").join(a, "column")


def data_issues(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Long table ``(column, issue, measure)``: constant, skewed, many outliers, near-unique, dominated."""
    nums = numeric_columns(df, exclude)
    stats = column_stats(df, nums, distinct=True)
    outliers = iqr_outlier_counts(df, stats)
    rows: list[tuple[str, str, float]] = []
    for c, s in stats.items():
        if s.distinct <= 1:
            rows.append((c, "constant", float(s.distinct)))
            continue
        if s.skew is not None and abs(s.skew) > 3:
            rows.append((c, "high_skewness", abs(s.skew)))
        if s.count > 10 and outliers.get(c, 0) / s.count > 0.2:
            rows.append((c, "many_outliers", outliers[c] / s.count))
    for r in modes(df, string_columns(df, exclude)).collect():  # one row per column
        if r["distinct"] > r["total"] * 0.8:
            rows.append((r["column"], "high_cardinality", r["distinct"] / r["total"]))
        if r["distinct"] > 1 and r["cnt"] / r["total"] > 0.9:
            rows.append((r["column"], "imbalanced", r["cnt"] / r["total"]))
    return params_frame(df.sparkSession, rows, "column string, issue string, measure double")
