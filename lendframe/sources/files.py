"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Keywords that mark a label column, looked for in column names.
TARGET_KEYWORDS = ("approved", "target", "label", "outcome")


MICROS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             date_columns: tuple[str, ...] = ("application_date",)) -> DataFrame:
    """CSV with header. Give a schema for large inputs: inference reads the files twice."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    for c in date_columns:
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType):
            df = df.withColumn(c, F.expr(f"try_to_timestamp(`{c}`)"))
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: tuple[str, ...] = ()) -> None:
    """Write a result, comparison or split table as csv, json or parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    if fmt in ("csv", "json"):  # text formats keep microseconds
        w = w.option("timestampFormat", MICROS).option("timestampNTZFormat", MICROS)
    w.format(fmt).save(path)


def read_sessions(spark: SparkSession, path: str, order: str = "start_time",
                  schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """Metadata or session documents, one JSON document per file (or per line), sorted by start."""
    reader = spark.read.option("multiLine", multi_line)
    df = reader.schema(schema).json(path) if schema else reader.json(path)
    return df.orderBy(order) if order in df.columns else df


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without any null in the given (default: all) columns."""
    return df.dropna(subset=columns)


def with_target(df: DataFrame, name: str = "target",
                keywords: tuple[str, ...] = TARGET_KEYWORDS) -> DataFrame:
    """Copy the first column whose name holds a target keyword; else the score-and-income rule."""
    for c in df.columns:
        if any(k in c.lower() for k in keywords):
            return df.withColumn(name, F.col(c))
    rule = (F.col("credit_score") >= 650) & (F.col("annual_income") >= 30000)
    return df.withColumn(name, F.when(F.coalesce(rule, F.lit(False)), 1).otherwise(0))
