"""Run tables: leaderboard, registry listings, retention, training logs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lendframe.operators.ranking import ordered_row_number, running, running_totals


def leaderboard(runs: DataFrame, metric: str = "accuracy", target: float = 0.9, time_col: str = "duration") -> DataFrame:
    """Runs by falling metric with rank, best, fastest and target flags. The rank comes from one range sort."""
    r = ordered_row_number(runs, [F.desc_nulls_last(metric), F.asc("run_id")], "rank")
    fastest = runs.agg(F.min(time_col)).first()[0]
    return r.select(
        *runs.columns, "rank", (F.col("rank") == 1).alias("is_best"), (F.col(time_col) == F.lit(fastest)).alias("is_fastest"),
        (F.col(metric) >= target).alias("meets_target")).orderBy("rank")


def list_runs(runs: DataFrame, **filters: str) -> DataFrame:
    """Runs that match all given fields, by name and newest first."""
    out = runs
    for c, v in filters.items():
        if v is not None:
            out = out.where(F.col(c) == v)
    return out.orderBy(F.asc("model_name"), F.desc("created_at"))


def compare_runs(runs: DataFrame, run_ids: list[int], metrics: list[str], column: str = "metrics") -> DataFrame:
    """Chosen runs with the wanted metrics of their map; a missing metric is 0."""
    return runs.where(F.col("run_id").isin(*run_ids)).select(
        "run_id", "model_name", *[F.coalesce(F.try_element_at(F.col(column), F.lit(m)), F.lit(0.0)).alias(m) for m in metrics])


def retention(runs: DataFrame, keep: int = 10, protected: tuple[str, ...] = ("production", "champion")) -> DataFrame:
    """Runs to delete: beyond the newest ``keep`` of their model and not in a protected stage.

    Age ranks come from bucketed running counts, so a model with most of the runs is not sorted in one task.
    """
    t = runs.withColumn("_age", -F.unix_micros(F.col("created_at").cast("timestamp")).cast("double"))
    per = t.groupBy("model_name", "_age").agg(F.count(F.lit(1)).alias("n"))
    ranks = running_totals(per, "_age", ["n"], ["model_name"]).select("model_name", "_age", "n", "cum_n")
    j = t.join(ranks, ["model_name", "_age"])
    w = Window.partitionBy("model_name", "_age").orderBy(F.desc("run_id"))  # runs of one model in one microsecond
    pos = F.col("cum_n") - F.col("n") + F.row_number().over(w)
    return j.withColumn("_p", pos).where((F.col("_p") > keep) & ~F.col("stage").isin(*protected)).select(*runs.columns)


def registry_stats(runs: DataFrame) -> DataFrame:
    """Counts and sizes by status, stage and type and in total: one pass with grouping sets."""
    spark = runs.sparkSession
    return spark.sql("""
        SELECT case grouping_id() when 3 then 'status' when 5 then 'stage' when 6 then 'model_type' else 'total' end AS kind,
               coalesce(status, stage, model_type, 'all') AS value, count(*) AS runs, sum(size_mb) AS size_mb
        FROM {runs} GROUP BY GROUPING SETS ((status), (stage), (model_type), ())""", runs=runs)


def flatten_history(history: DataFrame, metrics: list[str], column: str = "metrics") -> DataFrame:
    """Nested metric maps to one wide row per run."""
    long = history.select("run_id", "model_name", F.explode(column).alias("metric", "value"))
    return long.groupBy("run_id", "model_name").pivot("metric", metrics).agg(F.first("value"))


def last_steps_mean(log: DataFrame, n: int = 10) -> DataFrame:
    """Mean of the last ``n`` steps per session; tasks keep only ``n`` rows per session before the shuffle."""
    w = Window.partitionBy("session_id").orderBy(F.desc("step"))
    return log.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy("session_id").agg(
        F.avg("value").alias("recent_mean"), F.count(F.lit(1)).alias("steps"))


def session_summary(log: DataFrame) -> DataFrame:
    """Steps, duration and latest value per session."""
    return log.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("steps"), F.min("ts").alias("started"), F.max("ts").alias("ended"),
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("duration_us"),
        F.max_by("value", "step").alias("latest_value"), F.avg("value").alias("mean_value"))


def number_steps(log: DataFrame, order: str, session: str = "session_id") -> DataFrame:
    """Add ``step`` 1, 2, ... per session by a unique numeric order, with bucketed running counts."""
    d = running_totals(log.withColumn("_one", F.lit(1)), order, ["_one"], [session])
    return d.withColumnRenamed("cum__one", "step").drop("_one")


def early_stopping(log: DataFrame, patience: int = 10, min_delta: float = 0.001, mode: str = "min", chunk: int = 10_000) -> DataFrame:
    """First step with ``patience`` steps since the last improvement beyond ``min_delta``, and the best value so far.

    Steps of a session are numbered 1, 2, ... . Only a value below all earlier ones can improve, so each chunk of
    a session first keeps such records; the exact recurrence then streams over them in constant memory, whatever their number.
    """
    x = F.col("value") if mode == "min" else -F.col("value")
    d = log.select("session_id", "step", x.cast("double").alias("x"), F.floor(F.col("step") / chunk).alias("c"))
    mins = d.groupBy("session_id", "c").agg(F.min("x").alias("m"), F.max("step").alias("last"))
    wc = Window.partitionBy("session_id").orderBy("c")  # one row per chunk
    prev = mins.select("session_id", "c", F.min("m").over(wc.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    w = Window.partitionBy("session_id", "c").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rec = d.withColumn("p", F.min("x").over(w)).join(prev, ["session_id", "c"]).where(
        F.col("x") < F.coalesce(F.least("p", "before"), F.lit(float("inf"))))
    last = mins.groupBy("session_id").agg(F.max("last").alias("steps"))
    kind = log.schema["session_id"].dataType.simpleString()
    src = rec.select("session_id", "step", "x").repartition("session_id").sortWithinPartitions("session_id", "step")

    def fold(batches):
        """The recurrence over the records of each session in turn, with three numbers of memory."""
        now, best, at, stop, begun = None, None, 0, None, False
        for b in batches:
            done = []
            for sid, at_step, v in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not begun or sid != now:
                    if begun:
                        done.append((now, best, at, stop))
                    now, best, at, stop, begun = sid, None, 0, None, True
                if stop is None and best is not None and at_step - at > patience:
                    stop = at + patience
                if stop is None and (best is None or v + min_delta < best):
                    best, at = v, at_step
            if done:
                yield _batch(done, b.column(0).type)
            last_type = b.column(0).type
        if begun:
            yield _batch([(now, best, at, stop)], last_type)

    def _batch(rows, session_type):
        cols = list(zip(*rows))
        types = [session_type, pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["session_id", "best", "at", "stop"])
    f = src.mapInArrow(fold, f"session_id {kind}, best double, at bigint, stop bigint").join(last, "session_id").select(
        "session_id", "steps", F.struct("best", "at", "stop").alias("s"))
    stop = F.coalesce(F.col("s.stop"), F.when(F.col("steps") - F.col("s.at") >= patience, F.col("s.at") + patience))
    best = F.col("s.best") if mode == "min" else -F.col("s.best")
    return f.select("session_id", "steps", stop.alias("stop_step"), F.col("s.at").alias("best_step"), best.alias("best_value"))


def thin_steps(log: DataFrame, every: int = 10, above: int = 1000) -> DataFrame:
    """Every tenth step of sessions with more than 1000 steps, all steps of the others (steps numbered from 1)."""
    n = log.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    return log.join(n, "session_id").where((F.col("_n") <= above) | ((F.col("step") - 1) % every == 0)).drop("_n")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint: rows, columns, and the sum of the first 32 bits of each row's md5."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)]))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                  F.coalesce(F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint")), F.lit(0)).alias("fingerprint"))


def trial_history(trials: DataFrame, mode: str = "max") -> DataFrame:
    """Trials with the best value so far; bucketed, so one large study does not run in one task."""
    return running(trials, "trial", ["value"], ["study"], mode).withColumnRenamed("cum_value", "best_so_far")


def trial_states(trials: DataFrame) -> DataFrame:
    return trials.groupBy("study", "state").agg(F.count(F.lit(1)).alias("trials"), F.max("value").alias("best_value"))
