"""Whole-block feature table for the tabular models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.arrays import interval_stats
from eventloom.functions.text import list_items, list_numbers, strict_label
from eventloom.schemas import event_columns

# Feature columns besides the event counts.
EXTRA_FEATURES = ("sequence_len", "Latency", "ti_mean", "ti_max", "ti_std", "ti_zeros")


def trace_features(traces: DataFrame) -> DataFrame:
    """Length, latency and interval statistics per block from list strings."""
    stats = interval_stats(list_numbers(F.col("TimeInterval")))
    return traces.select(
        "BlockId", "Latency", F.size(list_items(F.col("Features"))).alias("sequence_len"), stats.alias("_s")
    ).select("BlockId", "Latency", "sequence_len", "_s.*")


def feature_columns(occurrence: DataFrame) -> list[str]:
    return event_columns(occurrence.columns) + list(EXTRA_FEATURES)


def tabular_features(labels: DataFrame, occurrence: DataFrame, traces: DataFrame) -> DataFrame:
    """BlockId, feature columns (nulls as 0.0) and y. The failure type is never used: it gives away y."""
    columns = feature_columns(occurrence)
    joined = (
        occurrence.select("BlockId", *event_columns(occurrence.columns))
        .join(trace_features(traces), "BlockId")
        .join(labels.select("BlockId", strict_label(F.col("Label")).alias("y")), "BlockId")
    )
    return joined.select("BlockId", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns], "y")


def block_features(
    occurrences_wide: DataFrame, interval_table: DataFrame, labels: DataFrame, events: Sequence[str]
) -> DataFrame:
    """The same table straight from derived counts and intervals, keyed by block_id."""
    joined = occurrences_wide.join(interval_table, "block_id").join(labels.select("block_id", "is_anomaly"), "block_id")
    numbers = [*events, "sequence_len", "latency", "ti_mean", "ti_max", "ti_std", "ti_zeros"]
    return joined.select(
        "block_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numbers], F.col("is_anomaly").alias("y")
    )
