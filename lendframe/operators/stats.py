"""Fused column statistics: one aggregate pass feeds most fitted operators.

Results are small (columns x statistics), so they live on the driver as
plain numbers and go into later plans as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Up to this many rows the built-in exact ``percentile`` (a value map in one
#: task) is used; beyond it the bracket search below.
EXACT_PERCENTILE_ROWS = 200_000
#: Bits by which a read narrows a bracket, and rows of a bracket that are few enough to be listed by value.
BUCKET_BITS = 12
LISTED_ROWS = 10_000


@dataclass
class ColumnStats:
    """Statistics of one numeric column."""

    n: int
    count: int
    mean: float | None = None
    std: float | None = None
    std_pop: float | None = None
    min: float | None = None
    max: float | None = None
    skew_pop: float | None = None
    kurt_pop: float | None = None
    distinct: int | None = None
    quantiles: dict[float, float] = field(default_factory=dict)

    @property
    def nulls(self) -> int:
        return self.n - self.count

    @property
    def skew(self) -> float | None:
        """Bias-adjusted skewness."""
        n, g = self.count, self.skew_pop
        if n < 3 or g is None or math.isnan(g):
            return None
        return g * math.sqrt(n * (n - 1)) / (n - 2)

    @property
    def kurt(self) -> float | None:
        """Bias-adjusted excess kurtosis."""
        n, g = self.count, self.kurt_pop
        if n < 4 or g is None or math.isnan(g):
            return None
        return ((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3))

    def q(self, p: float) -> float | None:
        return self.quantiles.get(p)

    def fences(self, k: float = 1.5) -> tuple[float, float] | None:
        a, b = self.q(0.25), self.q(0.75)
        return None if a is None or b is None else (a - k * (b - a), b + k * (b - a))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def column_stats(df: DataFrame, columns: list[str] | None = None, *,
                 quantiles: tuple[float, ...] = (0.25, 0.5, 0.75),
                 distinct: bool = False, shape: bool = True) -> dict[str, ColumnStats]:
    """All statistics of all columns: one job, one more when quantiles are wanted; ``shape=False`` leaves out skewness and kurtosis."""
    columns = columns if columns is not None else numeric_columns(df)
    if not columns:
        return {}
    # Long form: a handful of aggregates over (column number, value) cells compiles to tight code,
    # where columns x statistics aggregates side by side would not be compiled at all.
    x = F.col("x")
    g, k = (F.skewness(x), F.kurtosis(x)) if shape else (F.lit(None), F.lit(None))
    rows = numeric_cells(df, columns).groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.count(x).alias("c"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"),
        F.stddev_pop(x).alias("p"), F.min(x).alias("lo"), F.max(x).alias("hi"), g.alias("g"), k.alias("k")).collect()
    got = {r["i"]: r for r in rows}
    out = {c: ColumnStats(0, 0) for c in columns}
    for i, c in enumerate(columns):
        if i in got:
            r = got[i]
            out[c] = ColumnStats(r["n"], r["c"], r["m"], r["s"], r["p"], r["lo"], r["hi"], r["g"], r["k"])
    if quantiles:
        qs = exact_quantiles(df, {c: quantiles for c in columns}, {c: s.count for c, s in out.items()})
        for c in columns:
            out[c].quantiles = qs[c]
    if distinct:
        for c, v in distinct_counts(df, columns).items():
            out[c].distinct = v
    return out


def numeric_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells as ``(i, x)``: column number and value as double, nulls kept; one scan, nothing shuffled yet."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)
    ])).alias("e")).select("e.i", "e.x")


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact distinct counts of many columns.

    One (column, value) pair per cell is combined before the shuffle and the
    keys spread evenly, so neither a hot value nor a wide table gathers in one task.
    """
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)
    ])).alias("e")).select("e.*").where("v is not null")
    rows = cells.groupBy("i", "v").agg(F.lit(1)).groupBy("i").count().collect()
    got = {r["i"]: r["count"] for r in rows}
    return {c: got.get(i, 0) for i, c in enumerate(columns)}


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[float, ...]],
                    counts: dict[str, int] | None = None,
                    limit: int | None = None) -> dict[str, dict[float, float]]:
    """Exact linear-interpolated quantiles, at any size.

    Small inputs use ``percentile``. Larger ones narrow a bracket around every
    wanted rank by counts, in numpy per Arrow batch: three or four reads in all,
    whose work does not depend on the number of wanted quantiles.
    """
    cols = list(wanted)
    if not cols:
        return {}
    if counts is None:
        r = df.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(cols)]).first()
        counts = {c: r[i] for i, c in enumerate(cols)}
    limit = EXACT_PERCENTILE_ROWS if limit is None else limit
    small = [c for c in cols if counts[c] <= limit]
    out: dict[str, dict[float, float]] = {c: {} for c in cols}
    if small and len({wanted[c] for c in small}) == 1:
        probs = wanted[small[0]]
        rows = numeric_cells(df, small).groupBy("i").agg(
            F.percentile("x", F.lit(np.array(probs, dtype=float))).alias("q")).collect()
        for c in small:
            out[c] = {p: None for p in probs}
        for r in rows:
            if r["q"] is not None:
                out[small[r["i"]]] = dict(zip(probs, r["q"]))
    elif small:
        r = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*[F.lit(float(p)) for p in wanted[c]]))
                     .alias(f"q{i}") for i, c in enumerate(small)]).first()
        for i, c in enumerate(small):
            out[c] = dict(zip(wanted[c], r[i])) if r[i] is not None else {p: None for p in wanted[c]}
    big = {c: wanted[c] for c in cols if counts[c] > limit}
    if big:
        out.update(_bracket_search(df, big, counts))
    return out


def _keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; zeros are equal, NaN is the largest value."""
    x = x + 0.0
    x[np.isnan(x)] = np.nan
    bits = x.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2 ** 63 - 1))


def _value(key: int) -> float:
    return float(np.array([key if key >= 0 else key ^ (2 ** 63 - 1)], np.int64).view(np.float64)[0])


def _bucketed(df: DataFrame, columns: dict[str, list[tuple[int, int, bool]]]) -> DataFrame:
    """``i, at, sub, n, lo, hi``: filled buckets of the brackets of each column, with their rows and smallest and largest key.

    A bracket ``(lo, hi, listed)`` is cut into at most ``2 ** BUCKET_BITS`` buckets; a listed one into its values.
    """
    brackets = [[(lo, hi, listed, max(0, (hi - lo).bit_length() - BUCKET_BITS)) for lo, hi, listed in v] for v in columns.values()]

    def run(batches):
        found: dict[tuple[int, int], np.ndarray] = {}  # rows, smallest and largest key by bucket
        values: dict[tuple[int, int], list] = {}
        for b in batches:
            for i, own in enumerate(brackets):
                keys = np.sort(_keys(b.column(i).drop_null().to_numpy(zero_copy_only=False)))
                for at, (lo, hi, listed, shift) in enumerate(own):
                    part = keys[np.searchsorted(keys, lo):np.searchsorted(keys, hi, "right")]
                    if not len(part):
                        continue
                    if listed:
                        values.setdefault((i, at), []).append(part)
                        continue
                    # the difference of two keys may need all 64 bits
                    sub = (part.view(np.uint64) - np.uint64(lo % 2 ** 64)) >> np.uint64(shift)
                    first = np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1]]))
                    last = np.concatenate([first[1:], [len(sub)]])
                    if (i, at) not in found:
                        found[i, at] = np.tile(np.array([[0], [2 ** 63 - 1], [-2 ** 63]], np.int64), 1 << BUCKET_BITS)
                    own_n, own_lo, own_hi = found[i, at]
                    sub = sub[first].astype(np.int64)
                    own_n[sub] += last - first
                    own_lo[sub] = np.minimum(own_lo[sub], part[first])
                    own_hi[sub] = np.maximum(own_hi[sub], part[last - 1])
        for (i, at), t in found.items():
            sub = np.flatnonzero(t[0])
            yield batch(i, at, sub, *t[:, sub])
        for (i, at), parts in values.items():
            x, n = np.unique(np.concatenate(parts), return_counts=True)
            yield batch(i, at, x, n, x, x)

    def batch(i, at, sub, n, lo, hi):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(sub), v, np.int32)) for v in (i, at)] + [pa.array(v, pa.int64()) for v in (sub, n, lo, hi)],
                                          names=["i", "at", "sub", "n", "lo", "hi"])
    cells = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    return cells.mapInArrow(run, "i int, at int, sub bigint, n bigint, lo bigint, hi bigint").groupBy("i", "at", "sub").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _bracket_search(df: DataFrame, wanted: dict[str, tuple[float, ...]], counts: dict[str, int]) -> dict[str, dict[float, float]]:
    """Every wanted rank has a bracket of values, at first all of them. Each read cuts the brackets into buckets, and the bucket that holds
    the rank is the next bracket, until it is one value. Brackets of at most ``LISTED_ROWS`` rows are listed by value at once.

    What is shuffled is a number of buckets that does not grow with the rows.
    """
    # bracket and rows below it by column and rank
    todo = {c: {r: (-2 ** 63, 2 ** 63 - 1, counts[c], 0) for p in probs for r in _ranks(p, counts[c])} for c, probs in wanted.items()}
    known: dict[str, dict[int, float]] = {c: {} for c in wanted}
    while todo:
        cols = {c: sorted({(lo, hi, n <= LISTED_ROWS) for lo, hi, n, _ in ranks.values()}) for c, ranks in todo.items()}
        # by column: place of the bracket, rank within it, and rank
        targets = [[(cols[c].index((lo, hi, n <= LISTED_ROWS)), r - below, r) for r, (lo, hi, n, below) in ranks.items()] for c, ranks in todo.items()]

        def pick(key, t):
            t, out = t.sort_values(["at", "sub"]), []
            for at, rel, r in targets[key[0]]:
                own = t[t["at"] == at]
                cum = own["n"].to_numpy().cumsum()
                j = int(np.searchsorted(cum, rel, "right"))
                if j < len(own):
                    row = own.iloc[j]
                    out.append((key[0], r, row["lo"], row["hi"], row["n"], cum[j] - row["n"]))
            return pd.DataFrame(out, columns=["i", "r", "lo", "hi", "n", "below"])
        # at most 2 ** BUCKET_BITS rows a bracket in a group, and one a rank to the driver
        got = _bucketed(df, cols).groupBy("i").applyInPandas(pick, "i int, r bigint, lo bigint, hi bigint, n bigint, below bigint").collect()
        if len(got) < sum(map(len, targets)):
            raise ValueError("no bracket found: the counts are not those of the rows")
        names = list(todo)
        left: dict[str, dict[int, tuple[int, int, int, int]]] = {}
        for g in got:
            c = names[g["i"]]
            if g["lo"] == g["hi"]:
                known[c][g["r"]] = _value(g["lo"])
            else:
                left.setdefault(c, {})[g["r"]] = (g["lo"], g["hi"], g["n"], todo[c][g["r"]][3] + g["below"])
        todo = left
    out: dict[str, dict[float, float]] = {c: {} for c in wanted}
    for c, probs in wanted.items():
        for p in probs:
            lo, hi = _ranks(p, counts[c])
            a, b, frac = known[c][lo], known[c][hi], p * (counts[c] - 1) - lo
            out[c][p] = (1.0 - frac) * a + frac * b if b != a else a
    return out


def _ranks(p: float, count: int) -> tuple[int, int]:
    """The two ranks that a quantile lies between."""
    at = math.floor(p * (count - 1))
    return at, min(at + 1, count - 1)


def profile(df: DataFrame, columns: list[str], measures, name: str = "column") -> DataFrame:
    """One row per column from one aggregate pass.

    ``measures`` maps output names to functions of the column name that return
    an aggregate ``Column``. The only shuffle carries one partial row per task.
    """
    rows = F.array(*[
        F.struct(F.lit(c).alias(name), *[fn(c).alias(k) for k, fn in measures.items()]) for c in columns])
    return df.agg(rows.alias("_r")).selectExpr("inline(_r)")


def long_cells(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells as ``(column, value)`` with the value as text, one scan."""
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("_e")).select(*keep, "_e.*")


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value per column, ties to the smallest; columns ``column, value, cnt, total, distinct``.

    Counts per value are combined before the shuffle; the second step sees one
    row per distinct value and again combines before its shuffle.
    """
    per_value = long_cells(df, columns).where("value is not null").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("cnt"))
    best = F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("value").alias("value")))
    return per_value.groupBy("column").agg(
        best.alias("b"), F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("distinct")
    ).select("column", F.col("b.value").alias("value"), (-F.col("b.neg")).alias("cnt"), "total", "distinct")


def params_frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    """Fitted parameters (a handful of numbers per column) as a table."""
    return spark.createDataFrame(rows, schema)


# --- requests of several fits, answered together ------------------------------------------------

@dataclass
class Answers:
    """What :class:`Requests` found. ``values`` is a stored table ``column, value, n, labelled, label_sum``."""

    rows: int
    stats: dict[str, ColumnStats]
    values: DataFrame | None
    distinct: dict[str, int]
    filled: dict[str, int]

    def nulls(self, c: str) -> int:
        return self.stats[c].nulls if c in self.stats else self.rows - self.filled.get(c, 0)

    def small_columns(self, columns: list[str], limit: int) -> dict[str, list[str]]:
        """Sorted values of the columns that have at most ``limit``."""
        small = [c for c in columns if self.distinct.get(c, 0) <= limit]
        out: dict[str, list[str]] = {c: [] for c in small}
        if small:
            for r in self.values.where(F.col("column").isin(small)).select("column", "value").collect():  # at most limit per column
                out[r["column"]].append(r["value"])
        return {c: sorted(v) for c, v in out.items()}

    def modes(self, columns: list[str]) -> dict[str, str]:
        """Most frequent value per column, ties to the smallest."""
        best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value")))
        return {r["column"]: r["b"]["value"] for r in self.values.where(F.col("column").isin(columns)).groupBy("column").agg(best.alias("b")).collect()}


class Requests:
    """Collects the statistics that several fits want, and reads the table once for each kind of them.

    Moments and null counts of all numeric columns are one scan, quantiles of all columns at all wanted probabilities one more, and
    the values of all text columns, with their counts and label sums, a third: three reads, however many operators ask.
    """

    def __init__(self):
        self._moments: dict[str, None] = {}
        self._probs: dict[str, set[float]] = {}
        self._values: dict[str, None] = {}

    def moments(self, columns) -> "Requests":
        self._moments.update(dict.fromkeys(columns))
        return self

    def quantiles(self, columns, probs=(0.25, 0.5, 0.75)) -> "Requests":
        for c in columns:
            self._probs.setdefault(c, set()).update(probs)
        return self.moments(columns)

    def values(self, columns) -> "Requests":
        self._values.update(dict.fromkeys(columns))
        return self

    def run(self, df: DataFrame, label: str | None = None) -> Answers:
        from lendframe.session import saved
        st = column_stats(df, list(self._moments), quantiles=())
        if self._probs:
            probs = tuple(sorted(set().union(*self._probs.values())))
            got = exact_quantiles(df, {c: probs for c in self._probs}, {c: st[c].count for c in self._probs})
            for c, q in got.items():
                st[c].quantiles = q
        table, distinct, filled = None, {}, {}
        if self._values:
            y = F.lit(None).cast("double") if label is None else F.col(label).cast("double")
            cells = long_cells(df.withColumn("_y", y), list(self._values), keep=("_y",)).where("value is not null")
            table = saved(cells.groupBy("column", "value").agg(
                F.count(F.lit(1)).alias("n"), F.count("_y").alias("labelled"), F.sum("_y").alias("label_sum")), "values")
            for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).collect():
                distinct[r["column"]], filled[r["column"]] = r["d"], r["n"]
        rows = next(iter(st.values())).n if st else (df.count() if self._values else 0)
        return Answers(rows, st, table, distinct, filled)
