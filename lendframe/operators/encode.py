"""Categorical encoders. Small category lists become literals; large ones stay tables and are joined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lendframe.operators.ranking import ordered_row_number
from lendframe.operators.stats import distinct_counts, long_cells, params_frame, string_columns

#: Most categories that may become columns or literals.
MAX_LITERAL_CATEGORIES = 1000


def fit_categories(df: DataFrame, columns: list[str], limit: int = MAX_LITERAL_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct values per column, after a check that they are few."""
    counts = distinct_counts(df, columns)
    over = {c: n for c, n in counts.items() if n > limit}
    if over:
        raise ValueError(f"too many categories for a column each: {over}; use one_hot_sparse with label_table")
    rows = long_cells(df, columns).where("value is not null").distinct().collect()  # at most limit per column
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, categories: dict[str, list[str]], drop_first: bool = False, keep: bool = False) -> DataFrame:
    """0/1 columns ``{column}_{value}``; unknown values and nulls give all zeros."""
    new = []
    taken: dict[str, int] = {}
    for c, values in categories.items():
        for v in values[1 if drop_first else 0:]:
            name = f"{c}_{v}"
            n = taken[name.lower()] = taken.get(name.lower(), 0) + 1
            # column names ignore case: values that differ by case only are numbered
            new.append(F.when(F.col(c).cast("string") == F.lit(v), 1).otherwise(0).alias(name if n == 1 else f"{name}_{n}"))
    rest = [c for c in df.columns if keep or c not in categories]
    return df.select(*rest, *new)


def label_table(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: codes from 0 in sorted order."""
    values = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return ordered_row_number(values, ["value"], "code").withColumn("code", (F.col("code") - 1).cast("int"))


def label_table_of(values: DataFrame, column: str) -> DataFrame:
    """``(value, code)`` of one column from the stored values of :class:`~lendframe.operators.stats.Answers`."""
    return label_table(values.where(F.col("column") == column).select(F.col("value").alias(column)), column)


def one_hot_sparse(df: DataFrame, column: str, table: DataFrame, out: str | None = None) -> DataFrame:
    """One sparse 0/1 vector instead of a column per category: no limit on their number.

    ``table`` is a ``label_table``; unknown values and nulls give the empty vector.
    """
    size = table.count()
    coded = label_encode(df, column, table, "_slot", -1)
    enc = OneHotEncoder(inputCols=["_slot"], outputCols=[out or f"{column}_vector"], dropLast=True, handleInvalid="keep")
    model = enc.fit(table.select(F.col("code").cast("double").alias("_slot")))
    # invalid values have a place after the last code, and the last place is dropped: they give the empty vector
    return model.transform(coded.withColumn("_slot", F.when(F.col("_slot") < 0, float(size)).otherwise(
        F.col("_slot")).cast("double"))).drop("_slot")


def label_encode(df: DataFrame, column: str, table: DataFrame, out: str | None = None, unknown: int = 0) -> DataFrame:
    """Join the codes; unknown values take ``unknown``. Spark broadcasts the table only while it is small."""
    t = table.select(F.col("value").alias("_v"), F.col("code").alias("_code"))
    return df.join(t, F.col(column).cast("string") == F.col("_v"), "left").withColumn(
        out or f"{column}_code", F.coalesce("_code", F.lit(unknown))).drop("_v", "_code")


def label_codes(df: DataFrame, categories: dict[str, list[str]], unknown: int = 0, null: int | None = None) -> DataFrame:
    """Codes of several small columns as literals, no join; ``null`` sets the code of missing values."""
    new = {}
    for c, values in categories.items():
        pos = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c).cast("string")) - 1
        code = F.when(pos >= 0, pos).otherwise(unknown)
        if null is not None:
            code = F.when(F.col(c).isNull(), null).otherwise(code)
        new[c] = code.cast("int")
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def ordinal(df: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """Position in the given order from 0; unknown values and nulls give -1."""
    return label_codes(df, orders, unknown=-1, null=-1)


def category_codes(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """Alphabetical codes with -1 for missing values."""
    return label_codes(df, categories, unknown=-1, null=-1)


# --- target encoding ----------------------------------------------------------------------------

@dataclass
class TargetEncoding:
    """``table`` has one row per category: ``value, n, encoded``."""

    column: str
    table: DataFrame
    global_mean: float


def fit_target(df: DataFrame, column: str, label: str, smoothing: float = 1.0) -> TargetEncoding:
    """Smoothed label mean ``(n * mean + s * global) / (n + s)``; counts combine before the shuffle."""
    y = F.col(label).cast("double")
    g = df.agg(F.avg(y)).first()[0]
    t = df.where(F.col(label).isNotNull() & F.col(column).isNotNull()).groupBy(
        F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"))
    enc = (F.col("s") + F.lit(smoothing * g)) / (F.col("n") + F.lit(float(smoothing)))
    return TargetEncoding(column, t.select("value", "n", enc.alias("encoded")), g)


def target_from_values(values: DataFrame, column: str, global_mean: float, smoothing: float = 1.0) -> TargetEncoding:
    """The encoding of one column from the stored values of :class:`~lendframe.operators.stats.Answers`; no job."""
    t = values.where((F.col("column") == column) & (F.col("labelled") > 0))
    enc = (F.col("label_sum") + F.lit(smoothing * global_mean)) / (F.col("labelled") + F.lit(float(smoothing)))
    return TargetEncoding(column, t.select("value", F.col("labelled").alias("n"), enc.alias("encoded")), global_mean)


def apply_target(df: DataFrame, enc: TargetEncoding, out: str | None = None) -> DataFrame:
    """Unseen values and nulls take the global mean."""
    t = enc.table.select(F.col("value").alias("_v"), F.col("encoded").alias("_e"))
    return df.join(t, F.col(enc.column).cast("string") == F.col("_v"), "left").withColumn(
        out or f"{enc.column}_encoded", F.coalesce("_e", F.lit(enc.global_mean))).drop("_v", "_e")


def out_of_fold_target(df: DataFrame, column: str, label: str, fold: str = "fold", smoothing: float = 1.0,
                       out: str | None = None) -> DataFrame:
    """Encode each row from the other folds only: group totals minus the row's own fold.

    The data is aggregated once by (category, fold); totals come from that small table.
    """
    y = F.col(label).cast("double")
    cf = df.groupBy(F.col(column).cast("string").alias("_v"), F.col(fold).alias("_f")).agg(
        F.count(y).alias("n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("s"))
    per_fold = cf.groupBy("_f").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    tot = per_fold.agg(F.sum("fn"), F.sum("fs")).first()
    glob = per_fold.select("_f", (F.lit(tot[1]) - F.col("fs")).alias("gs"), (F.lit(tot[0]) - F.col("fn")).alias("gn"))
    w = Window.partitionBy("_v")  # one row per fold
    rest = cf.withColumn("rn", F.sum("n").over(w) - F.col("n")).withColumn("rs", F.sum("s").over(w) - F.col("s"))
    t = rest.join(glob, "_f").select(
        "_v", "_f", ((F.col("rs") + smoothing * F.col("gs") / F.col("gn")) / (F.col("rn") + smoothing)).alias("_e"))
    return df.join(t, F.col(column).cast("string").eqNullSafe(F.col("_v")) & (F.col(fold) == F.col("_f"))).withColumn(
        out or f"{column}_encoded", F.col("_e")).drop("_v", "_f", "_e")


# --- column typing ------------------------------------------------------------------------------

def assign_encoders(df: DataFrame, columns: list[str] | None = None, max_one_hot: int = 50) -> DataFrame:
    """One-hot for up to ``max_one_hot`` categories, label codes above."""
    cols = columns or string_columns(df)
    n = distinct_counts(df, cols)
    return params_frame(df.sparkSession, [(c, n[c], "onehot" if n[c] <= max_one_hot else "label") for c in cols],
                        "column string, categories bigint, encoder string")


def feature_types(df: DataFrame, exclude: tuple[str, ...] = (), max_numeric: int = 20) -> DataFrame:
    """Text, or numeric with up to 20 distinct values, is categorical; the rest is numerical."""
    cols = [c for c in df.columns if c not in exclude]
    n = distinct_counts(df, cols)
    rows = []
    for c in cols:
        t = df.schema[c].dataType
        cat = isinstance(t, T.StringType) or (isinstance(t, T.NumericType) and n[c] <= max_numeric)
        rows.append((c, "categorical" if cat else "numerical", n[c]))
    return params_frame(df.sparkSession, rows, "column string, kind string, distinct bigint")
