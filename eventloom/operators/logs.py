"""From raw lines to parsed, block-tagged lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import UNKNOWN_BLOCK, first_block_id, header_cut, header_fields, header_timestamp, strip
from eventloom.operators.ordered import GROUP_ROWS, broadcast_if_small, running


def parse_lines(lines: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Add header fields, content, block id (searched in the content) and timestamp.

    A field is never blank: a line that could only be read with a blank field counts as one without header.
    """
    cut = lines.withColumn("_text", strip(F.col("line"))).withColumn("_cut", header_cut(F.col("_text")))
    parsed = cut.withColumns(header_fields(F.col("_cut"))).drop("_text", "_cut")
    return parsed.withColumns(
        {
            "block_id": first_block_id(F.col("content"), UNKNOWN_BLOCK if keep_unknown else None),
            "timestamp": header_timestamp(F.col("date"), F.col("time")),
        }
    )


def usable_lines(parsed: DataFrame) -> DataFrame:
    """Drop lines without block or timestamp.

    The test goes through a one-item generator: as a plain filter it would be pushed below the parse and run
    the patterns again, several times per line.
    """
    usable = F.col("block_id").isNotNull() & F.col("timestamp").isNotNull()
    return parsed.withColumn("_usable", F.explode(F.array(usable))).filter("_usable").drop("_usable")


def number_lines(lines: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Add ``line_no``: lines counted from 0 over all files, in file order, without a sort or a shuffle of lines.

    Rows of a split are numbered by the scan from some start (``row_in_split``), so a count of each split and running
    sums over the splits are enough. The lines are scanned twice; should the second scan cut the files otherwise
    than the first, rows do not fit the counts and the job fails instead of giving wrong numbers.
    """
    split_key = ["file", "split_start"]
    counted = lines.groupBy(*split_key).agg(F.min("row_in_split").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = running(counted, [], split_key, {"_upto": ("sum", F.col("_n"))}, limit=limit)
    placed = lines.join(broadcast_if_small(before), split_key, "left")
    inside = F.col("row_in_split") - F.col("_first")
    fits = (inside >= 0) & (inside < F.col("_n"))
    number = F.when(fits, F.col("_upto") - F.col("_n") + inside).otherwise(
        F.raise_error(F.lit("rows of a split are not numbered without gaps, or its files were cut otherwise")).cast("bigint")
    )
    return placed.withColumn("line_no", number).drop("_first", "_n", "_upto")


def first_lines(lines: DataFrame, max_lines: int) -> DataFrame:
    """The first ``max_lines`` lines in file order, left in the partitions where they were read."""
    return number_lines(lines).filter(F.col("line_no") < max_lines).drop("line_no")


def route_lines(lines: DataFrame, split: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Tag lines with the split of the first block id found anywhere in the line; others are dropped.

    ``max_lines`` keeps the first lines in file order before matching.
    """
    if max_lines is not None:
        lines = first_lines(lines, max_lines)
    tagged = lines.withColumn("block_id", first_block_id(F.col("line"))).filter(F.col("block_id").isNotNull())
    return tagged.join(split.select("block_id", "split"), "block_id")
