"""Text-to-type conversions as native expressions; a failure gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Words accepted as booleans.
TRUE_WORDS = ["true", "yes", "y", "1", "on", "enabled"]
FALSE_WORDS = ["false", "no", "n", "0", "off", "disabled", ""]
# Accepted date formats, tried in this order (month first before day first).
DATE_FORMATS = [
    "yyyy-M-d H:m:s.SSSSSS", "yyyy-M-d H:m:s", "yyyy-M-d", "M/d/yyyy", "M/d/yyyy H:m:s", "d/M/yyyy",
    "d/M/yyyy H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s.SSSSSS", "yyyy-M-d'T'H:m:s.SSSSSS'Z'",
]


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _clean(x: Column) -> Column:
    return F.regexp_replace(F.trim(x.cast("string")), ",", "")


def to_integer(x: Column) -> Column:
    """Whole numbers; a percent sign is cut off and the value truncated; other fractions are null."""
    t = _clean(x)
    pct = t.endswith("%")
    v = F.when(pct, _number(F.regexp_replace(t, "%$", ""))).otherwise(_number(t))
    whole = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))
    return F.when(pct | (v == whole), whole).try_cast("bigint")


def to_float(x: Column) -> Column:
    """Numbers; percent is divided by 100; currency signs are dropped."""
    t = _clean(x)
    return F.when(t.endswith("%"), _number(F.regexp_replace(t, "%$", "")) / 100.0).otherwise(
        _number(F.regexp_replace(t, "[$€£¥]", "")))


def to_string(x: Column) -> Column:
    """Trimmed text; null becomes empty."""
    return F.coalesce(F.trim(x.cast("string")), F.lit(""))


def to_categorical(x: Column) -> Column:
    return F.trim(x.cast("string"))


def to_boolean(x: Column) -> Column:
    t = F.lower(F.trim(x.cast("string")))
    t = F.when(t.isin("1.0", "0.0"), F.substring(t, 1, 1)).otherwise(t)
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def to_datetime(x: Column) -> Column:
    """The accepted formats in order, then a generic parse, then unix seconds (session zone UTC)."""
    t = F.trim(x.cast("string"))
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS]
    seconds = _number(t)
    return F.coalesce(*tries, F.when(seconds.isNull(), t.try_cast("timestamp")),
                      F.timestamp_micros((seconds * 1_000_000).try_cast("bigint")))


CONVERTERS = {"integer": to_integer, "float": to_float, "string": to_string, "boolean": to_boolean,
              "datetime": to_datetime, "categorical": to_categorical}


class ConversionError(ValueError):
    """Some values of a strict conversion do not parse."""


def convert_dataframe(df: DataFrame, types: dict[str, str], strict: bool = False) -> DataFrame:
    """Convert the named columns; strict mode counts failures first (one pass) and raises if any."""
    new = {c: CONVERTERS[t](F.col(c)) for c, t in types.items()}
    if strict:
        r = df.agg(*[F.count_if(F.col(c).isNotNull() & new[c].isNull()).alias(c) for c in types]).first()
        bad = {c: r[c] for c in types if r[c]}
        if bad:
            raise ConversionError(f"values that do not convert: {bad}")
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def coerce_numeric(x: Column) -> Column:
    """Number or 0."""
    return F.coalesce(_number(F.trim(x.cast("string"))), F.lit(0.0))


def infer_types(df: DataFrame, sample_size: int | None = None) -> DataFrame:
    """Inferred type per column: boolean, datetime, integer, float, categorical, else string.

    Values are combined per (column, value) before the shuffle. ``sample_size`` looks at that many
    rows only, chosen by the hash of the row; the default reads all.
    """
    from lendframe.operators.stats import long_cells
    src = df.orderBy(F.xxhash64(*df.columns)).limit(sample_size) if sample_size else df
    v = long_cells(src, src.columns).where("value is not null").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))
    num = _number(F.trim("value"))
    word = F.lower(F.trim("value"))
    date = num.isNull() & to_datetime(F.col("value")).isNotNull()
    agg = v.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total"),
        F.count_if(~word.isin(*[w for w in TRUE_WORDS + FALSE_WORDS if w])).alias("not_bool"),
        F.count_if(~date).alias("not_date"), F.count_if(num.isNull()).alias("not_num"),
        F.count_if(num.isNull() | (num != F.floor(num))).alias("not_int"))
    kind = (F.when((F.col("not_bool") == 0) & (F.col("distinct") <= 2), "boolean")
            .when(F.col("not_date") == 0, "datetime").when(F.col("not_int") == 0, "integer")
            .when(F.col("not_num") == 0, "float")
            .when((F.col("distinct") < 20) | (F.col("distinct") / F.col("total") < 0.1), "categorical")
            .otherwise("string"))
    return agg.select("column", kind.alias("inferred_type"), "distinct", "total")
