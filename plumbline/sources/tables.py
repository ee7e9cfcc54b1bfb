"""Tables in and out: Parquet, ORC, CSV, JSON; reports as JSON."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.columns import canonical


class EmptyTable(ValueError):
    pass


def read(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None, allow_empty: bool = False) -> DataFrame:
    """A table with NaN as null; an empty one raises unless allowed. CSV and JSON want a schema at scale."""
    fmt = fmt or path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        reader = reader.option("header", True) if schema else reader.option("header", True).option("inferSchema", True)
    df = canonical(reader.format(fmt).load(path))
    if not allow_empty and df.isEmpty():
        raise EmptyTable(path)
    return df


def write(df: DataFrame, path: str, fmt: str = "parquet", target: str | None = None) -> None:
    """The table as ``path``; with a target also features and target beside it. A CSV sink has a header."""
    def put(part: DataFrame, to: str) -> None:
        w = part.write.mode("overwrite").format(fmt)
        (w.option("header", True) if fmt == "csv" else w).save(to)

    put(df, path)
    if target:
        put(df.drop(target), f"{path}_features")
        put(df.select(F.col(f"`{target}`")), f"{path}_target")


def write_report(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, indent=2, default=str))


def saved_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``, in any store that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(folder).getLength())
