"""Results kept batch by batch, so that a rerun and a replayed batch give the same table.

An input is known by its key and the digest of its content: the same content is not done again,
changed content is. Two contents of one key in a batch are both done; the greater digest is the current one. Each batch has a folder of its own that is written whole, so that writing it once
more replaces it; what a batch has to do is told from the batches before it alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Work = Callable[[DataFrame], DataFrame]


def batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows of all batches with `batch`; schema names the columns, those that a batch lacks are null. No batch yet: no rows."""
    try:
        return spark.read.schema(f"{schema}, batch bigint").parquet(folder)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, batch bigint")


def pending(inputs: DataFrame, folder: str, batch: int, key: str = "doc_id") -> DataFrame:
    """Inputs (key, sha256, ...) whose latest content no batch before this one has done; equal inputs once."""
    kind = inputs.schema[key].dataType.simpleString()
    before = batches(inputs.sparkSession, folder, f"{key} {kind}, sha256 string").filter(F.col("batch") < batch)
    done = before.groupBy(key).agg(F.max_by("sha256", F.struct("batch", "sha256")).alias("_sha")).withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("sha256").eqNullSafe(F.col("_sha"))
    return inputs.dropDuplicates([key, "sha256"]).join(done, same, "left_anti")


def commit(results: DataFrame, folder: str, batch: int) -> None:
    """The batch's results as its folder, in place of what an earlier attempt has left there."""
    results.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def run(inputs: DataFrame, folder: str, batch: int, work: Work, key: str = "doc_id") -> None:
    """Does what is pending; work keeps the key and sha256."""
    commit(work(pending(inputs, folder, batch, key)), folder, batch)


def current(spark: SparkSession, folder: str, schema: str, key: str = "doc_id") -> DataFrame:
    """The latest result of each key; schema holds the key and sha256."""
    rows = batches(spark, folder, schema)
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("*"), F.struct("batch", "sha256")).alias("_r")).select("_r.*")


def streamed(inputs: DataFrame, folder: str, checkpoint: str, work: Work, key: str = "doc_id") -> StreamingQuery:
    """A stream of inputs into the ledger, what is there now at once; a batch that Spark replays after a failure replaces itself."""
    return inputs.writeStream.foreachBatch(lambda df, batch: run(df, folder, batch, work, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
