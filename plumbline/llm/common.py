"""Helpers shared by the training-data operators: the shared folder, table access, written cuts of lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share (``spark.checkpoint.dir``).

    Only where that setting is absent and the master is local (single-machine tests) a temporary folder is chosen.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("plumbline.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("plumbline.shared.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def erase(*frames: DataFrame) -> None:
    """Deletes what ``written`` wrote, for frames that no later plan reads."""
    for df in frames:
        jvm, path = df.sparkSession._jvm, df.written_to
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after setting Arrow batches to ``BATCH_ROWS`` where the session has no size of its own: texts are long rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Lets Python workers of this machine import the package from where the driver did."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, paths) if x)
