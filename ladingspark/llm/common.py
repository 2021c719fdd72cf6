"""Small pieces that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The column as a string, null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def digest_of(df: DataFrame) -> Column:
    """Digest of all columns' digests; a null differs from every text but the character NUL alone."""
    parts = [F.md5(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00"))) for c in df.columns]
    return F.md5(F.concat_ws(":", *parts))


def words_in(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased; bytes.split and bytes.lower treat ASCII alone."""
    return text.lower().split()


#: Bytes of a long text that are cut into words at a time.
PIECE_BYTES = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def pieces_of(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE_BYTES that end at blanks, so that no list of all its words is needed."""
    at = 0
    while at < len(data):
        found = _BLANK.search(data, at + PIECE_BYTES) if len(data) - at > PIECE_BYTES else None
        end = found.end() if found else len(data)
        yield data[at:end]
        at = end


#: Characters of a long text that are encoded at a time, about.
PART_CHARS = 1 << 20
_WORD_THEN_BLANK = re.compile(r"\S ")


def parts_of(text: str) -> Iterator[str]:
    """The text in parts of about PART_CHARS that end between a character that is no white space and a blank.

    There a piece of the byte-level encoders' patterns ends whatever follows, so that the parts can be
    encoded one by one. A text without such a place is one part.
    """
    at = 0
    while at < len(text):
        found = _WORD_THEN_BLANK.search(text, at + PART_CHARS) if len(text) - at > PART_CHARS else None
        end = found.end() - 1 if found else len(text)
        yield text[at:end] if at or end < len(text) else text
        at = end


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only where none is named and all runs on one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a Parquet table beside the checkpoints; smaller than a checkpoint.

    Such tables stay until the folder is cleared.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the sum of each column over all rows that come earlier in `order`.

    Rows are dealt out by range, so that no task holds all of them. Only one row a
    partition is summed in one place, and it is this table that is broadcast: its
    size is the number of shuffle partitions, whatever the data.
    """
    placed = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = checkpointed(placed)
    per_part = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    before_part = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", *[F.coalesce(F.sum(f"_all_{n}").over(before_part), F.lit(0)).alias(f"_off_{n}") for n in sums])
    before_row = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(offsets), "_part")
    out = joined.select("*", *[(F.col(f"_off_{n}") + F.coalesce(F.sum(c).over(before_row), F.lit(0))).alias(n) for n, c in sums.items()])
    return out.drop("_part", *[f"_off_{n}" for n in sums])


def beside(rows: DataFrame, table: DataFrame, on: Sequence[tuple[str, str]], seed: Sequence[str], most: int = 20_000, salts: int = 32, how: str = "inner") -> DataFrame:
    """rows joined null-safely with a table of one row a key (its key columns go), whatever the keys' skew.

    table should be checkpointed: it is counted. Up to `most` rows it is broadcast; beyond, it is
    repeated once for each salt and the rows are salted by the hash of their `seed` columns.
    """
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in on]
    if table.count() <= most:
        out = rows.join(F.broadcast(table), same, how)
    else:
        table = table.withColumn("_table_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("_row_salt", F.pmod(F.xxhash64(*seed), F.lit(salts)).cast("int"))
        out = rows.join(table, [*same, F.col("_row_salt") == F.col("_table_salt")], how).drop("_row_salt", "_table_salt")
    return out.drop(*[b for _, b in on])


#: A key is hot if it holds more than one in so many rows; so there are fewer hot keys than this.
HOT_KEYS = 10_000


def beside_hot(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined by key with a table of one row a key, whose column _n counts the key's rows among `total` (it goes).

    The table's rows of hot keys are broadcast (fewer than HOT_KEYS rows), so that no task is given
    all rows of such a key; the others meet by a shuffle. rows is read twice if a key is hot; it and
    table should be stored, or cheap to read.
    """
    hot = F.col("_n") > total / HOT_KEYS
    if table.filter(hot).isEmpty():
        return rows.join(table.drop("_n"), key, how)
    beside_ = F.broadcast(table.filter(hot).withColumn("_n", F.lit(True)))
    marked = rows.join(beside_, key, "left")
    rest = marked.filter(F.col("_n").isNull()).select(*rows.columns).join(table.filter(~hot).drop("_n"), key, how)
    return marked.filter(F.col("_n").isNotNull()).drop("_n").unionByName(rest)
