"""Sharding by extendible hashing, as DataFrame expressions.

A directory maps hash prefixes to shards. A shard over its byte limit splits on one more bit; the
others keep theirs. The hash is that of the whole row, so rows that no bit can part are equal.
Defined results:

* null text counts 0 bytes; nulls hash as a marker of their own.
* equal rows never part by a bit: if they exceed the limit together, their shard is cut into
  pages that hold as many of them as fit (page 0, 1, ...).
* one row over the limit stands alone in its page, and `oversize` is true.
* empty table: empty result. A text of any length is one row. Columns besides those named are
  hashed and kept, none is read by name.

A row finds its shard by its hash alone: the directory is grouped by its first bits, about as many
groups as shards, and a row meets the one or few shards of its group. It is broadcast up to a
bound; beyond, rows are shuffled once by group, with groups of very many rows set apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside_hot, checkpointed, digest_of

#: Bits of the hash: 15 hexadecimal digits, to stay in a positive long.
BITS = 60
#: Bits a round adds below the shards that are still too large.
STEP = 12
#: Shards up to which the directory is broadcast (some 40 bytes a shard).
BROADCAST_SHARDS = 100_000


def directory(hashed: DataFrame, limit: int) -> DataFrame:
    """depth, prefix, shard_bytes, n_rows, paged (true: equal rows over the limit, which no bit can part).

    Each round looks STEP bits deeper below the prefixes that are still too large. It sums bytes
    by the deepest prefix first, at most 2**STEP cells for each, and gets the levels above from
    those cells. A prefix is a shard if it is closed and its parent is not.
    """
    out, over, top = None, None, 0
    while True:
        last = min(top + STEP, BITS)
        rows = hashed
        if over is not None:
            rows = rows.withColumn("_at", F.shiftright("_hash", BITS - top)).join(over, "_at", "left_semi")
        cells = rows.groupBy(F.shiftright("_hash", BITS - last).alias("_cell")).agg(F.sum("_bytes").alias("_b"), F.count("*").alias("_n"), F.min("_hash").alias("_low"), F.max("_hash").alias("_high"))
        first = 0 if over is None else top + 1
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(last))))
        prefixes = levels.groupBy("depth", F.expr(f"shiftright(_cell, {last} - depth)").alias("prefix")).agg(
            F.sum("_b").alias("shard_bytes"), F.sum("_n").alias("n_rows"), F.min("_low").alias("_low"), F.max("_high").alias("_high")
        )
        prefixes = checkpointed(prefixes.withColumn("_closed", (F.col("shard_bytes") <= limit) | (F.col("_low") == F.col("_high"))))
        parent = prefixes.filter(~F.col("_closed")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_parent"))
        below = prefixes.withColumn("_parent", F.shiftright("prefix", 1)).join(parent, ["depth", "_parent"], "left_semi").drop("_parent")
        shards = prefixes.filter(F.col("depth") == first).unionByName(below.filter(F.col("depth") > first)).filter("_closed")
        shards = shards.select("depth", "prefix", "shard_bytes", "n_rows", (F.col("shard_bytes") > limit).alias("paged"))
        out = shards if out is None else out.unionByName(shards)
        over = checkpointed(prefixes.filter((F.col("depth") == last) & ~F.col("_closed")).select(F.col("prefix").alias("_at")))
        top = last
        if over.isEmpty():
            return checkpointed(out)


def shard(df: DataFrame, bytes_of: Column, limit: int = 64 << 20) -> DataFrame:
    """df's columns in the struct `row`, with shard (prefix bits, "*" for none), page, shard_bytes, oversize."""
    digest = digest_of(df)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(bytes_of.cast("long"), F.lit(0)).alias("_bytes"), digest.alias("_digest"))
    rows = rows.withColumn("_hash", F.conv(F.substring("_digest", 1, BITS // 4), 16, 10).cast("long"))
    shards = directory(rows.select("_hash", "_bytes"), limit)
    many, total = shards.agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    bits = max(0, many.bit_length() - 1)
    groups = grouped(shards, bits)
    rows = rows.withColumn("_group", F.shiftright("_hash", BITS - bits))
    if many <= BROADCAST_SHARDS:
        placed = rows.join(F.broadcast(groups.drop("_n")), "_group")
    else:
        placed = beside_hot(rows, checkpointed(groups), "_group", total)
    own = F.element_at(F.expr(f"filter(_shards, s -> shiftright(_hash, {BITS} - s.depth) = s.prefix)"), 1)
    placed = placed.withColumn("_own", own).select("row", "_bytes", "_digest", "_own.*")
    placed = placed.withColumn("shard", F.when(F.col("depth") == 0, F.lit("*")).otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')")))
    whole = placed.filter(~F.col("paged")).select("row", "shard", F.lit(0).cast("long").alias("page"), "shard_bytes", F.lit(False).alias("oversize"))
    return whole.unionByName(pages(placed.filter("paged"), limit))


def grouped(shards: DataFrame, bits: int) -> DataFrame:
    """_group (the hash's first `bits` bits), _shards (those that have rows in it), _n (rows, about); a shard of fewer bits is in several groups."""
    first, last = (f"shiftleft(prefix + {k}, greatest({bits} - depth, 0))" for k in (0, 1))
    covered = f"if(depth >= {bits}, array(shiftright(prefix, depth - {bits})), sequence({first}, {last} - 1))"
    spread = shards.withColumn("_group", F.explode(F.expr(covered))).withColumn("_part", F.ceil(F.col("n_rows") / F.pow(F.lit(2.0), F.greatest(F.lit(bits) - F.col("depth"), F.lit(0)))))
    return spread.groupBy("_group").agg(F.collect_list(F.struct("depth", "prefix", "shard_bytes", "paged")).alias("_shards"), F.sum("_part").alias("_n"))


def pages(equal: DataFrame, limit: int) -> DataFrame:
    """Equal rows over the limit: counted, then dealt to pages of as many as fit, one at least.

    The copies are counted before the shuffle, and each page is spread out by itself.
    """
    kinds = equal.groupBy("_digest").agg(F.first("row").alias("row"), F.first("shard").alias("shard"), F.first("_bytes").alias("_bytes"), F.count("*").alias("_n"))
    kinds = kinds.withColumn("_fit", F.greatest(F.lit(1), F.expr(f"cast({limit} div greatest(_bytes, 1) as long)")))
    paged = kinds.withColumn("page", F.explode(F.expr("sequence(0L, (_n - 1) div _fit)")))
    paged = paged.withColumn("_here", F.least(F.col("_fit"), F.col("_n") - F.col("page") * F.col("_fit"))).repartition("_digest", "page")
    return paged.withColumn("_copy", F.explode(F.expr("sequence(1L, _here)"))).select(
        "row", "shard", "page", (F.col("_bytes") * F.col("_here")).alias("shard_bytes"), (F.col("_bytes") > limit).alias("oversize")
    )
