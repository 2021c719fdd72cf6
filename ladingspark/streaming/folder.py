"""Papers as they come into a folder: the same operators on a stream, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "doc_id bigint, text string"


def papers(spark: SparkSession, folder: str, schema: str = SCHEMA, files_a_batch: int = 1000) -> DataFrame:
    """Parquet files that are dropped into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def process(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, drain: bool = True) -> StreamingQuery:
    """operator over the stream, written as Parquet exactly once; drain: stop when what is there is done."""
    writer = operator(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if drain else writer).start()


def failures_by_window(checks: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """window, status, n from a stream of checks (at, status); what comes later than `late` is left out."""
    return checks.withWatermark("at", late).groupBy(F.window("at", window), "status").agg(F.count("*").alias("n"))
