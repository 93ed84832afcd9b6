"""Ordered event sequences per block, their intervals and their occurrence counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.ordered import CHUNK_EVENTS, GROUP_ROWS, following, positions, spread_chunks

#: Order of events in a block: time, then the place of the line in its source.
ORDER = ("ts", "line_key")


def build_sequences(
    events: DataFrame,
    min_length: int = 2,
    order: Sequence[str] = ORDER,
    size: int = CHUNK_EVENTS,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """One row per block with its ordered events: (block_id, chunk, sequence).

    A block longer than ``size`` events continues in further rows (chunk 1, 2, ...), so no cell grows
    without bound. Blocks with fewer than ``min_length`` events are dropped.
    """
    numbered = positions(events.select("block_id", "event", *order), ["block_id"], order, limit=limit)
    own = spread_chunks(numbered, size, 0)
    pair = F.struct("pos", "event")
    rows = own.groupBy("block_id", "chunk").agg(
        F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["event"]).alias("sequence")
    )
    # a later chunk exists only for blocks that are long enough
    return rows.filter((F.col("chunk") > 0) | (F.size("sequence") >= min_length))


def sequence_lengths(sequences: DataFrame) -> DataFrame:
    """Events per block of a (possibly chunked) sequence table."""
    return sequences.groupBy("block_id").agg(F.sum(F.size("sequence")).cast("bigint").alias("sequence_len"))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000


def intervals(events: DataFrame, order: Sequence[str] = ORDER, limit: int = GROUP_ROWS) -> DataFrame:
    """One row per pair of neighbouring events: (block_id, pos, event, next_event, seconds)."""
    paired = following(
        events.select("block_id", "event", *order),
        ["block_id"],
        order,
        {"next_event": ("event", 1), "_next_ts": (order[0], 1)},
        limit=limit,
    )
    return paired.filter(F.col("_next_ts").isNotNull()).select(
        "block_id", "pos", "event", "next_event", seconds_between(F.col(order[0]), F.col("_next_ts")).alias("seconds")
    )


def interval_features(events: DataFrame, order: Sequence[str] = ORDER, limit: int = GROUP_ROWS) -> DataFrame:
    """Interval statistics, length and latency per block; zeros for a block of one event."""
    paired = following(
        events.select("block_id", *order), ["block_id"], order, {"_next_ts": (order[0], 1)}, limit=limit
    )
    seconds = seconds_between(F.col(order[0]), F.col("_next_ts"))
    return (
        paired.withColumn("_s", seconds)
        .groupBy("block_id")
        .agg(
            F.count(F.lit(1)).alias("sequence_len"),
            F.coalesce(F.sum("_s"), F.lit(0.0)).alias("latency"),
            F.coalesce(F.avg("_s"), F.lit(0.0)).alias("ti_mean"),
            F.coalesce(F.max("_s"), F.lit(0.0)).alias("ti_max"),
            F.coalesce(F.stddev_pop("_s"), F.lit(0.0)).alias("ti_std"),
            F.coalesce(F.avg((F.col("_s") == 0).cast("double")), F.lit(0.0)).alias("ti_zeros"),
        )
    )


def occurrences(events: DataFrame, event: str = "event") -> DataFrame:
    """Long occurrence table: (block_id, event, cnt)."""
    return events.groupBy("block_id", event).agg(F.count(F.lit(1)).alias("cnt"))


def occurrence_matrix(events: DataFrame, vocabulary: Sequence, event: str = "event", prefix: str = "") -> DataFrame:
    """Wide occurrence table: one count column per event of the vocabulary, 0 when absent."""
    counts = [
        F.count(F.when(F.col(event) == F.lit(v), F.lit(1))).alias(f"{prefix}{v}") for v in vocabulary
    ]
    return events.groupBy("block_id").agg(*counts)


def occurrence_long(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A wide occurrence table as (BlockId, event, cnt) rows."""
    return matrix.unpivot(["BlockId"], list(columns), "event", "cnt")


def consistency(traces: DataFrame) -> DataFrame:
    """Counts of blocks whose interval list disagrees with its events or with its latency.

    Expects ``events``, ``intervals`` arrays and ``latency``.
    """
    total = F.aggregate("intervals", F.lit(0.0), lambda acc, x: acc + x)
    return traces.agg(
        F.sum((F.size("intervals") != F.size("events") - 1).cast("bigint")).alias("length_mismatches"),
        F.sum((F.round(total, 6) != F.round("latency", 6)).cast("bigint")).alias("latency_mismatches"),
        F.count(F.lit(1)).alias("blocks"),
    )
