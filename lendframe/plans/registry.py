"""Registry of checked queries: a Spark plan and, where SQL can say it, its SQL twin."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lendframe.sources.loans import LOANS_CTE, loan_applications

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Applications of one task, where there are more of them than two tasks a core would take.
TASK_ROWS = 100_000


class Tables:
    """Lazy access to the input tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def loans(self) -> DataFrame:
        return loan_applications(self.spark, self.dir)

    @property
    def lab(self) -> DataFrame:
        return loan_applications(self.spark, self.dir, copies=False)

    def dealt(self, df: DataFrame) -> DataFrame:
        """The applications of ``df`` dealt to tasks of about ``TASK_ROWS``; few of them stay as they are.

        Scan and join are cut by the bytes of their few columns, so a task there has the more of the wide rows the larger the table is.
        """
        n = math.ceil(self.orders.count() / TASK_ROWS)
        return df.repartition(n, "application_id") if n > 2 * self.spark.sparkContext.defaultParallelism else df

    @property
    def preds(self) -> DataFrame:
        from lendframe.plans.predictions import prediction_table
        return prediction_table(self.lab)


def query(name: str, sql: str | None = None, *, loans: bool = True, preds: bool = False):
    """Register ``fn(tables) -> DataFrame``; ``sql`` is prefixed with the views it needs."""
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            if preds:
                from lendframe.plans.predictions import PREDS_CTE
                SQL[name] = PREDS_CTE + _more(sql)
            elif loans:
                SQL[name] = LOANS_CTE + _more(sql)
            else:
                SQL[name] = sql
        return fn
    return deco


def _more(sql: str) -> str:
    """Append a query to the view list; a query that starts with ``WITH`` adds its own views."""
    s = sql.strip()
    return ",\n" + s[4:].lstrip() if s[:5].upper() == "WITH " else "\n" + s
