"""What a job's stages did, and steps in Python that fail by row."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .tables import kept


class Stages:
    """Stores the table of each stage and observes it in the same pass: rows, failures and seconds.

    A task that is run again after an executor was lost may be counted twice, as Spark's observations
    are; the stored tables are exact.
    """

    SCHEMA = "place int, stage string, rows bigint, failures bigint, seconds double"

    def __init__(self) -> None:
        self.seen: list[tuple[int, str, int, int, float]] = []

    def store(self, stage: str, df: DataFrame, failed: Column) -> DataFrame:
        """df as a stored table; failed says which of its rows count as failures."""
        observation = Observation(f"{stage}-{len(self.seen)}")
        started = time.monotonic()
        out = kept(df.observe(observation, F.count(F.lit(1)).alias("rows"), F.count_if(failed).alias("failures")))
        seen = observation.get
        self.seen.append((len(self.seen), stage, int(seen.get("rows") or 0), int(seen.get("failures") or 0), time.monotonic() - started))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """place, stage, rows, failures, seconds: a row a stage."""
        return spark.createDataFrame(self.seen, self.SCHEMA)


def attempted(function: Callable[[object], object], kind: str = "string") -> Callable[[Column], Column]:
    """A column function that gives a struct of value and error: what the Python function gives for each value, or why it failed.

    A null stays null without being asked for; one row's failure leaves the others alone.
    """
    types = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(values: pa.Array) -> pa.Array:
        found, errors = [], []
        for value in values:
            result = error = None
            if value.is_valid:
                try:
                    result = pa.scalar(function(value.as_py()), types[kind]).as_py()
                except Exception as e:  # noqa: BLE001  the row says what failed
                    result, error = None, f"{type(e).__name__}: {e}"
            found.append(result)
            errors.append(error)
        return pa.StructArray.from_arrays([pa.array(found, types[kind]), pa.array(errors, pa.string())], names=["value", "error"])

    return F.arrow_udf(run, f"value {kind}, error string")
