"""Fitted stages on streams: they are projections with literal parameters, so a stream runs them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.prep import Fitted


def read_stream(spark: SparkSession, path: str, schema, max_files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def replay(stream: DataFrame, stages: list[Fitted]) -> DataFrame:
    for s in stages:
        stream = s.transform(stream)
    return stream


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Processes what is there and stops; restarts go on from the checkpoint."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q
