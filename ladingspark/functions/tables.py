"""Tables between two parts of a job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; one of our own only where none is named and all runs on one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tables-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: worked out once, and planned apart from what reads it."""
    path = f"{folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is hot that more than one of so many rows has; there are fewer hot keys than this, whatever the table's size.
HOT_ONE_OF = 10_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The hot keys of a table, stored, fewer than HOT_ONE_OF rows; None if there are none. Counted before the shuffle; nulls don't count."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    seen = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.max("_n"), F.lit(0)).alias("most")).first()
    # In a small table a key is hot from as many rows on as the bound has keys.
    least = max(seen["n"] / HOT_ONE_OF, HOT_ONE_OF)
    return kept(counts.filter(F.col("_n") > least).select(key)) if seen["most"] > least else None


def join_to_one(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join to a table with at most one (narrow) row a key, where a key of rows may hold any share of them.

    Rows with a hot key meet its row by broadcast, which HOT_ONE_OF bounds; the others by shuffle. Rows are read
    once to count their keys and once or twice to be joined.
    """
    hot = hot_keys(rows, key)
    if hot is None:
        return rows.join(table, key)
    table = kept(table)
    far = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key)
    return far.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key))


def elements(df: DataFrame, keep: Sequence[str], array: Column | str, item: str = "_e") -> DataFrame:
    """A row an element: keep, pos (from 0) and the element. Null and empty arrays give no row.

    For the inner form of the generator Spark tests the array's size below it, where an array that is
    costly to work out is worked out again for each test; the outer form is not tested, and its null rows go here.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("pos", item))
    return rows.filter(F.col("pos").isNotNull())
