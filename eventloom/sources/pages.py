"""A history stored in the order of its pages, with counts that lead to the files of a page at any depth."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.operators.ordered import GROUP_ROWS, running

#: Rows of a bucket; a page reads the buckets that it touches.
BUCKET_ROWS = 500_000


def _newest_first():
    return F.desc("created_at"), F.desc("id")


def write_pages(history: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS, limit: int = GROUP_ROWS) -> None:
    """Store a history in ranges of (created_at, id), newest first, and how many rows stand before each range.

    Ranges hold about ``bucket_rows`` rows each. Rows without created_at are the oldest. An empty history is stored
    without ranges. ``history`` must not have a column named ``bucket``.
    """
    spark = history.sparkSession
    total = history.count()
    buckets = max(1, math.ceil(total / bucket_rows))
    ranged = history.repartitionByRange(buckets, *_newest_first()).withColumn("bucket", F.spark_partition_id())
    ranged.write.partitionBy("bucket").parquet(f"{path}/rows")
    # an empty history has no rows to read the columns from
    ranged.limit(0).write.parquet(f"{path}/columns")
    stored = spark.read.schema(ranged.schema).parquet(f"{path}/rows")
    counted = stored.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = running(counted, [], ["bucket"], {"upto": ("sum", F.col("n"))}, limit=limit)
    upto.select("bucket", (F.col("upto") - F.col("n")).alias("first"), "n").write.parquet(f"{path}/counts")


def read_page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """Rows of page ``number`` (from 1) with ``place`` and ``has_next``; both are at least 1.

    The counts name the buckets of the page, and only their files are read. A page beyond the last one is empty.
    """
    number, size = max(number, 1), max(size, 1)
    first = (number - 1) * size
    counts = spark.read.schema("bucket int, first bigint, n bigint").parquet(f"{path}/counts")
    total = counts.agg(F.max(F.col("first") + F.col("n"))).first()[0] or 0
    # stored buckets hold at least one row, so these are fewer than the page has rows, plus one
    touched = counts.filter((F.col("first") < first + size) & (F.col("first") + F.col("n") > first)).collect()
    start = min((r["first"] for r in touched), default=0)
    schema = spark.read.parquet(f"{path}/columns").schema
    rows = spark.read.schema(schema).parquet(f"{path}/rows").filter(F.col("bucket").isin([r["bucket"] for r in touched])).drop("bucket")
    top = rows.orderBy(*_newest_first()).limit(first + size - start)
    # the rows before the page in its first bucket, and the page
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_newest_first())) - 1 + F.lit(start)
    numbered = top.withColumn("place", place.cast("bigint")).filter(F.col("place") >= first)
    return numbered.withColumn("has_next", F.lit(total > first + size))
