"""Missing-value operators: fit gives one value per column, transform is ``coalesce``."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from lendframe.operators.stats import Answers, column_stats, exact_quantiles, modes, numeric_columns, params_frame, profile


@dataclass
class ImputeParams:
    fill: dict[str, Any] = field(default_factory=dict)
    strategy: dict[str, str] = field(default_factory=dict)
    drop: list[str] = field(default_factory=list)


def _null_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    r = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c: r[i] for i, c in enumerate(columns)}


def fit_imputer(df: DataFrame, strategies: dict[str, str] | None = None, *, default_numeric: str = "median",
                default_other: str = "mode", constants: dict[str, Any] | None = None,
                exclude: tuple[str, ...] = (), only_with_nulls: bool = True, answers: Answers | None = None) -> ImputeParams:
    """Strategies: mean, median, mode, constant (0 or 'Unknown' unless given), drop.

    At most four jobs whatever the number of columns: null counts, means, medians, modes. With ``answers`` (moments and medians
    of the numeric columns, values of the others) only a mode is read, from the stored values.
    """
    strategies, constants = strategies or {}, constants or {}
    cols = [c for c in df.columns if c not in exclude]
    if only_with_nulls:
        nulls = {c: answers.nulls(c) for c in cols} if answers else _null_counts(df, cols)
        cols = [c for c in cols if nulls[c] > 0]
    numeric = set(numeric_columns(df))
    p = ImputeParams()
    for c in cols:
        p.strategy[c] = strategies.get(c, default_numeric if c in numeric else default_other)
    by = lambda s: [c for c in cols if p.strategy[c] == s]
    if by("mean"):
        for c, s in (answers.stats if answers else column_stats(df, by("mean"), quantiles=())).items():
            if c in by("mean"):
                p.fill[c] = s.mean
    if by("median"):
        q = {c: answers.stats[c].quantiles for c in by("median")} if answers else exact_quantiles(df, {c: (0.5,) for c in by("median")})
        for c in by("median"):
            p.fill[c] = q[c][0.5]
    if by("mode"):
        types = {f.name: f.dataType for f in df.schema.fields}
        listed = [c for c in by("mode") if answers and c in answers.distinct]
        found = answers.modes(listed) if listed else {}
        rest = [c for c in by("mode") if c not in listed and not (answers and c in answers.filled)]
        found |= {r["column"]: r["value"] for r in modes(df, rest).collect()} if rest else {}  # one row per column
        for c, v in found.items():
            p.fill[c] = _from_text(v, types[c])
    for c in by("constant"):
        p.fill[c] = constants.get(c, 0 if c in numeric else "Unknown")
    p.drop = by("drop")
    unknown = set(p.strategy.values()) - {"mean", "median", "mode", "constant", "drop"}
    if unknown:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    p.fill = {c: v for c, v in p.fill.items() if v is not None}
    return p


def _from_text(v: str, t: T.DataType) -> Any:
    if isinstance(t, T.IntegralType):
        return int(v)
    if isinstance(t, T.NumericType):
        return float(v)
    if isinstance(t, T.BooleanType):
        return v == "true"
    return v


def impute(df: DataFrame, p: ImputeParams) -> DataFrame:
    out = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in df.columns:
        if c in p.drop:
            continue
        if c in p.fill:
            v = p.fill[c]
            whole = isinstance(types[c], T.IntegralType) and isinstance(v, float) and not v.is_integer()
            out.append(F.coalesce(F.col(c).cast("double") if whole else F.col(c),
                                  F.lit(v) if whole else F.lit(v).cast(types[c])).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def fit_skew_imputer(df: DataFrame, columns: list[str], text: list[str] = (), limit: float = 1.0) -> ImputeParams:
    """Median for skewed columns (absolute adjusted skewness above the limit), mean otherwise; text 'Missing'."""
    p = ImputeParams()
    for c, s in column_stats(df, columns, quantiles=(0.5,)).items():
        skewed = s.skew is not None and abs(s.skew) > limit
        p.strategy[c] = "median" if skewed else "mean"
        p.fill[c] = s.q(0.5) if skewed else s.mean
    for c in text:
        p.strategy[c], p.fill[c] = "constant", "Missing"
    return p


def fit_cascade_imputer(df: DataFrame, columns: list[str], text: list[str] = ()) -> ImputeParams:
    """Median, else mean, else 0; text takes the mode, else 'Unknown'."""
    p = ImputeParams()
    for c, s in column_stats(df, columns, quantiles=(0.5,)).items():
        v = next((x for x in (s.q(0.5), s.mean) if x is not None), 0.0)
        p.strategy[c], p.fill[c] = "cascade", v
    if text:
        got = {r["column"]: r["value"] for r in modes(df, list(text)).collect()}
        for c in text:
            p.strategy[c], p.fill[c] = "cascade", got.get(c, "Unknown")
    return p


def missing_summary(df: DataFrame, p: ImputeParams | None = None) -> DataFrame:
    """Null count, share, type and strategy per column with nulls, most first; one pass."""
    types = dict(df.dtypes)
    strategy = p.strategy if p else {}
    return profile(df, df.columns, {
        "dtype": lambda c: F.lit(types[c]),
        "nulls": lambda c: F.count_if(F.col(c).isNull()),
        "pct": lambda c: F.round(F.try_divide(F.count_if(F.col(c).isNull()) * 100.0, F.count(F.lit(1))), 4),
        "strategy": lambda c: F.lit(strategy.get(c, "none")),
    }).where("nulls > 0").orderBy(F.desc("nulls"), "column")


def params_table(spark, p: ImputeParams) -> DataFrame:
    return params_frame(spark, [(c, p.strategy[c], str(p.fill.get(c))) for c in p.strategy],
                        "column string, strategy string, value string")
