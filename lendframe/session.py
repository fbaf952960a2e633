"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lendframe", master: str | None = None, **conf: str) -> SparkSession:
    """Build or get a session. Cluster settings win: only defaults that results depend on are fixed."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder that holds the checkpoints."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or one already set on the context.

    Only a session that runs in one local process may do without: it gets a
    temporary folder. A cluster must name a folder that all machines share.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="lendframe-ckpt-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for workers that don't have it installed."""
    sc = spark.sparkContext
    if sc.master.startswith("local") and "cluster" not in sc.master and _importable():
        return
    if getattr(sc, "_lendframe_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buf = os.path.join(tempfile.mkdtemp(prefix="lendframe-ship-"), "lendframe.zip")
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("lendframe", os.path.relpath(full, root)))
    sc.addPyFile(buf)
    sc._lendframe_shipped = True


def _importable() -> bool:
    """Whether local Python workers, which inherit PYTHONPATH but not sys.path, find the package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    return root in os.environ.get("PYTHONPATH", "").split(os.pathsep)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage on reliable storage, so that a lost executor does not lose the cut.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: a cut of the lineage whose size Spark knows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
