"""Generated features. Whatever depends on the data (shifts, medians) is fixed at fit."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lendframe.operators.stats import column_stats, exact_quantiles

SMALL = 1e-6


@dataclass
class MathParams:
    shift: dict[str, float] = field(default_factory=dict)


def fit_math(df: DataFrame, columns: list[str]) -> MathParams:
    """Shift ``|min| + 1`` for columns with negative values."""
    return MathParams({c: abs(s.min) + 1.0 for c, s in column_stats(df, columns, quantiles=()).items()
                       if s.min is not None and s.min < 0})


def _signed(x: Column, c: str, p: MathParams, negatives: str) -> Column | None:
    if c not in p.shift:
        return x
    if negatives == "shift":
        return x + p.shift[c]
    return F.abs(x) if negatives == "abs" else None


def math_feature(c: str, op: str, p: MathParams, negatives: str = "shift") -> Column:
    """log, sqrt, square, exp or reciprocal with the zero and negative policies of the fit."""
    x = F.col(c).cast("double")
    if op == "log":
        safe = _signed(F.when(x == 0, F.lit(SMALL)).otherwise(x), c, p, negatives)
        return x if safe is None else F.log1p(safe)
    if op == "sqrt":
        safe = _signed(x, c, p, negatives)
        return x if safe is None else F.sqrt(safe)
    if op == "square":
        return x * x
    if op == "exp":
        return F.exp(F.greatest(F.least(x, F.lit(50.0)), F.lit(-50.0)))
    if op == "reciprocal":
        return F.lit(1.0) / F.when(x == 0, F.lit(SMALL)).otherwise(x)
    raise ValueError(f"unknown operation {op}")


def add_math(df: DataFrame, columns: list[str], ops: list[str], p: MathParams, negatives: str = "shift",
             custom: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    new = [math_feature(c, op, p, negatives).alias(f"{c}_{op}") for c in columns for op in ops]
    new += [fn(F.col(c)).alias(f"{c}_{name}") for name, fn in (custom or {}).items() for c in columns]
    return df.select("*", *new)


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, interaction_only: bool = True,
               bias: bool = False) -> DataFrame:
    """Products up to a degree; names join the factors with ``__``."""
    pick = itertools.combinations if interaction_only else itertools.combinations_with_replacement
    new = [F.lit(1.0).alias("bias")] if bias else []
    for d in range(2, degree + 1):
        for combo in pick(columns, d):
            prod = F.col(combo[0]).cast("double")
            for c in combo[1:]:
                prod = prod * F.col(c).cast("double")
            new.append(prod.alias("__".join(combo)))
    return df.select("*", *new)


@dataclass
class RatioParams:
    median: dict[str, float]


def _ratio(a: str, b: str) -> Column:
    return F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b).cast("double"), F.lit(0.0)))


def fit_ratios(df: DataFrame, pairs: list[tuple[str, str]]) -> RatioParams:
    """Median of every ratio; all pairs in one exact-quantile pass."""
    r = df.select(*[_ratio(a, b).alias(f"{a}_to_{b}_ratio") for a, b in pairs])
    q = exact_quantiles(r, {c: (0.5,) for c in r.columns})
    return RatioParams({c: v[0.5] for c, v in q.items()})


def fit_medians(df: DataFrame, ratios: list[tuple[str, str]], formulas: dict[str, tuple[str, str | None]]) -> tuple[RatioParams, dict[str, float]]:
    """Medians of ratios and of the denominators of domain formulas, all in one exact-quantile pass."""
    ratios = list(dict.fromkeys(ratios))
    cols = sorted({d for _, d in formulas.values() if d})
    r = df.select(*[_ratio(a, b).alias(f"{a}_to_{b}_ratio") for a, b in ratios], *[F.nullif(F.col(c), F.lit(0)).alias(c) for c in cols])
    q = exact_quantiles(r, {c: (0.5,) for c in r.columns})
    return (RatioParams({f"{a}_to_{b}_ratio": q[f"{a}_to_{b}_ratio"][0.5] for a, b in ratios}),
            {c: 1.0 if q[c][0.5] is None else q[c][0.5] for c in cols})


def add_ratios(df: DataFrame, pairs: list[tuple[str, str]], p: RatioParams) -> DataFrame:
    """``a / b``; a missing or zero-denominator ratio takes the fitted median."""
    return df.select("*", *[F.coalesce(_ratio(a, b), F.lit(p.median[f"{a}_to_{b}_ratio"])).alias(f"{a}_to_{b}_ratio")
                            for a, b in pairs])


def add_arithmetic(df: DataFrame, pairs: list[tuple[str, str]], ops: tuple[str, ...] = ("+", "-", "*", "/"),
                   medians: RatioParams | None = None) -> DataFrame:
    names = {"+": "plus", "-": "minus", "*": "times", "/": "div"}
    new = []
    for a, b in pairs:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        for op in ops:
            if op == "/":
                v = _ratio(a, b)
                if medians is not None:
                    v = F.coalesce(v, F.lit(medians.median[f"{a}_to_{b}_ratio"]))
            else:
                v = x + y if op == "+" else x - y if op == "-" else x * y
            new.append(v.alias(f"{a}_{names[op]}_{b}"))
    return df.select("*", *new)


# The default domain formulas, with the denominator whose zeros take the median of its other values.
DOMAIN_FORMULAS: dict[str, tuple[str, str | None]] = {
    "debt_burden_score": ("try_divide(debt_to_income_ratio * loan_amount, {d})", "annual_income"),
    "creditworthiness_score": ("credit_score * credit_history_length / 100D", None),
    "loan_to_income_ratio": ("try_divide(loan_amount, {d})", "total_household_income"),
    "total_debt_after_loan": ("existing_debt + loan_amount", None),
    "collateral_ratio": ("try_divide(property_value, {d})", "loan_amount"),
}


def fit_domain(df: DataFrame, formulas: dict[str, tuple[str, str | None]] | None = None) -> dict[str, float]:
    """Median of the nonzero values of each denominator; 1 where all are zero or null."""
    cols = sorted({d for _, d in (formulas or DOMAIN_FORMULAS).values() if d})
    q = exact_quantiles(df.select(*[F.nullif(F.col(c), F.lit(0)).alias(c) for c in cols]), {c: (0.5,) for c in cols})
    return {c: 1.0 if q[c][0.5] is None else q[c][0.5] for c in cols}


def add_domain(df: DataFrame, medians: dict[str, float],
               formulas: dict[str, tuple[str, str | None]] | None = None) -> DataFrame:
    """Formula features; a formula is any Spark SQL expression, ``{d}`` marks the guarded denominator."""
    new = []
    for name, (text, d) in (formulas or DOMAIN_FORMULAS).items():
        guarded = f"if({d} = 0, {float(medians[d])!r}D, {d})" if d else ""
        new.append(F.expr(text.format(d=guarded)).alias(name))
    return df.select("*", *new)
