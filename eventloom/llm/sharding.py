"""Rendezvous hashing of stable record keys over weighted shards.

Each (key, shard) pair has its own hash, and a key goes to the shard of the lowest cost. A shard that is
added or made heavier only takes keys, one that is removed only gives its own away, so few records move
when the number of shards changes. Column functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import cut_lineage

#: Width of a hash, in bits: what a double holds without rounding.
HASH_BITS = 52
#: Hash ranges that the rows of one shard are numbered in; each is one window group.
SLOT_BUCKETS = 1024
#: Copies of one row that are written from a single cell.
RUN_ROWS = 4096


def key_hash(key: Column, tag: str) -> Column:
    """The first 52 bits of md5 over ``key:tag`` as a bigint: any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{tag}"))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def cost(key: Column, shard: int, weight: float) -> Column:
    """``-ln(u) / weight`` with u uniform in (0, 1): the minimum lies on a shard with probability weight / sum."""
    if not weight > 0:
        raise ValueError(f"weight of shard {shard} must be above 0")
    uniform = (key_hash(key, str(shard)) + F.lit(0.5)) / F.lit(float(2**HASH_BITS))
    return -F.log(uniform) / F.lit(float(weight))


def cheapest(key: Column, weights: Sequence[float]) -> Column:
    """struct(cost, shard) of the shard that a key belongs to; equal costs go to the lower number."""
    if not weights:
        raise ValueError("at least one shard is needed")
    return F.array_min(
        F.array(*[F.struct(cost(key, j, w).alias("cost"), F.lit(j).alias("shard")) for j, w in enumerate(weights)])
    )


def assign(
    df: DataFrame, key: str, weights: Sequence[float], added: float | None = None, shard: str = "shard", grown: str = "grown_shard"
) -> DataFrame:
    """Add the shard of each row and, with ``added``, the shard it would have beside one more shard of that weight.

    Equal keys share a shard. A null key counts as the empty text; rows without a key therefore stay together.
    Existing columns of the same names are replaced.
    """
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    out = df.withColumn("_pick", cheapest(text, weights))
    best = out.withColumn(shard, F.col("_pick.shard"))
    new = len(weights)
    if added is None:
        return best.withColumn(grown, F.lit(None).cast("int")).drop("_pick")
    taken = cost(text, new, added) < F.col("_pick.cost")
    return best.withColumn(grown, F.when(taken, F.lit(new)).otherwise(F.col("_pick.shard"))).drop("_pick")


def slots(df: DataFrame, shard: str, key: str, rest: Sequence[str], buckets: int = SLOT_BUCKETS, slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap, by (hash bucket of the key, key, ``rest``).

    ``shard``, ``key`` and ``rest`` are the columns of the result and must be narrow. A shard never meets in
    one task: rows are numbered inside hash buckets, which start where the counts of the buckets before them
    end. Equal rows are counted before they move and written out again in runs, so even a row that fills a
    third of the table is no large group.
    """
    names = [shard, key, *rest]
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    counted = cut_lineage(
        df.groupBy(*[F.col(f"`{c}`") for c in names])
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", F.pmod(key_hash(text, "slot"), F.lit(buckets)))
    )
    sizes = counted.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_rows"))
    ahead = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_bucket", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(key, *rest).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    # at most shards * buckets rows
    placed = placed.join(F.broadcast(starts), [shard, "_bucket"])
    run = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / RUN_ROWS)))
    runs = placed.withColumn("_run", run).withColumn("_first", F.col("_start") + F.col("_before") + F.col("_run") * RUN_ROWS)
    length = F.least(F.lit(RUN_ROWS).cast("bigint"), F.col("_n") - F.col("_run") * RUN_ROWS)
    return runs.withColumn(slot, F.explode(F.sequence(F.col("_first"), F.col("_first") + length - 1))).select(*names, slot)


def shard_documents(docs: DataFrame, weights: Sequence[float], added: float = 1.0, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for documents(doc_id, text).

    Size is the UTF-8 length of the text (null: 0) plus 8. Null ids count as the empty key, null texts have the
    CRC of no bytes. Only these narrow columns are shuffled. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = assign(narrow, "doc_id", weights, added)
    numbered = slots(placed, "shard", "doc_id", ["size", "text_crc32", "grown_shard"], buckets)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
