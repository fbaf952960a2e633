"""Streaming entry points. Row-wise operators take a streaming frame as they are; windows need a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lendframe.operators.rules import RuleBook
from lendframe.operators.schema import LOAN_SCHEMA, FieldConstraint
from lendframe.operators.validate import violations


def table_stream(spark: SparkSession, path: str, schema=None, max_files: int | None = None) -> DataFrame:
    """Stream of the parquet files under a path or glob; the schema is read from the files when not given."""
    schema = schema or spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def rule_violations(stream: DataFrame, id_col: str = "application_id", book: RuleBook | None = None) -> DataFrame:
    return (book or RuleBook()).violations(stream, id_col)


def field_violations(stream: DataFrame, id_col: str, schema: tuple[FieldConstraint, ...] = LOAN_SCHEMA) -> DataFrame:
    return violations(stream, id_col, schema)


def confidence_windows(stream: DataFrame, time_col: str, value: Column, window: str = "1 day", lateness: str = "1 hour",
                       by: tuple[str, ...] = ()) -> DataFrame:
    """Mean confidence per tumbling window: the event-time form of the drift monitor.

    State is one partial average per open window; the watermark closes windows.
    """
    return stream.withWatermark(time_col, lateness).groupBy(F.window(time_col, window).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_confidence")).select(
        F.col("w.start").alias("window_start"), *by, "n", "mean_confidence")


def drift_between_windows(windows: DataFrame, limit: float = 0.05) -> DataFrame:
    """Windows (a finished, small table) against the one before."""
    from pyspark.sql import Window
    w = Window.orderBy("window_start")  # one row per window
    d = F.abs(F.col("mean_confidence") - F.lag("mean_confidence").over(w))
    return windows.select("*", d.alias("drift"), F.coalesce(d > limit, F.lit(False)).alias("drifted"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all available data into a parquet table; restartable from the checkpoint."""
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_windows(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write the windows that each batch changed to a folder of its own; a repeated batch replaces its folder.

    Update mode keeps only windows that the watermark has not closed in the state.
    """
    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    q = (stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def latest_windows(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """The last state of every window that ``run_windows`` has written."""
    d = spark.read.parquet(path)
    rest = [c for c in d.columns if c not in keys and c != "epoch"]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("s")).select(*keys, *[f"s.{c}" for c in rest])
