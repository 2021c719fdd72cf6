"""Mixing sources to target weights: whole copies plus one seeded Bernoulli copy.

Everything runs as DataFrame expressions. Defined results:

* text null or blank: size 0, never taken (0 words whatever its copies).
* source null: a source of its own, last in order.
* doc_id null: allowed; the draw then depends on the text alone.
* repeated rows (same doc_id and text): the same draw, so the same copies.
* empty table: empty result. A source without words: target 0.
* columns other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, beside, checkpointed, running_sums, text_of


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and the digest that seeds the draw."""
    text = text_of()
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(text).alias("_digest"),
    )


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row a source: source, source_size, target (words).

    Sources in code-point order, null last, take the weights in turn and share the total size by
    them. A target stops at `most` times its source's size; what is over is shared again by weight
    among the others, until none is above. Only sums over all sources come to the driver.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running_sums(per_source, [F.col("source").asc_nulls_last()], {"_place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    placed = checkpointed(placed.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("_cap")))
    total = placed.agg(F.sum("source_size")).first()[0] or 0

    capped, free_words, free_weight, done = F.lit(False), total, None, -1
    while True:
        kept, free_weight, n = placed.agg(
            F.sum(F.when(capped, F.col("_cap"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))
        ).first()
        free_words, free_weight = total - (kept or 0), free_weight or 0
        if n == done or not free_weight:
            break
        done = n
        capped = F.col("_cap") <= (F.col("weight") * F.lit(free_words)).cast("double") / F.lit(float(free_weight))
    share = (F.col("weight") * F.lit(free_words)).cast("double") / F.lit(float(free_weight or 1))
    return placed.select("source", "source_size", F.when(capped, F.col("_cap").cast("double")).otherwise(share).alias("target"))


def drawn(rate: Column, doc_id: str, digest: Column, seed: str) -> Column:
    """floor(rate), and one more if the seeded uniform number is below the fraction."""
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), digest))
    uniform = F.conv(F.substring(mark, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))
    return (F.floor(rate) + F.when(uniform < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def rates(docs: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """_source, source_size, target, _rate: checkpointed, a row a source."""
    goal = targets(sized(docs), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return checkpointed(goal.select(F.col("source").alias("_source"), "source_size", "target", rate.alias("_rate")))


def copies(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and copies, a row for each document.

    rate = target / source_size; a document comes floor(rate) times, and once more with
    probability equal to the fraction.
    """
    joined = beside(sized(docs), rates(docs, weights, most), [("source", "_source")], ["doc_id", "_digest"])
    return joined.select("doc_id", "source", "size", "source_size", "target", drawn(F.col("_rate"), "doc_id", F.col("_digest"), seed).alias("copies"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """The documents as the mix takes them: each row as often as `copies` says, all columns kept.

    The number is worked out beside each row itself, without a join by doc_id, so that repeated
    and null ids do no harm.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.select("_row", F.col("_row.source").cast("string").alias("_by"), F.col("_row.doc_id").alias("_id"), F.md5(F.coalesce(F.col("_row.text").cast("string"), F.lit(""))).alias("_digest"))
    joined = beside(rows, rates(docs, weights, most), [("_by", "_source")], ["_id", "_digest"])
    times = drawn(F.col("_rate"), "_id", F.col("_digest"), seed).cast("int")
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).select("_row.*")
