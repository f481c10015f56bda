"""Folders that the driver and all executors share, for files that a job writes and reads again."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
_made: list[tuple[SparkSession, str]] = []


def importable(spark: SparkSession) -> None:
    """Let Python workers that start from now on import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{known}".rstrip(":")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, dropped when the driver ends. Unset, it is a temporary folder on a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gradus-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not _made:
        atexit.register(_drop)
    _made.append((spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"))
    return _made[-1][1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a table to a shared folder and read it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop() -> None:
    for spark, path in _made:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session ended first; a cluster's clean-up of its checkpoint folder has to do
            return
