"""Checks and class-conditional statistics of the block tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.ordered import GROUP_ROWS, describe, unpivot

TOP_EVENTS = 10
TOP_COLUMNS = 8


def null_counts(df: DataFrame, top: int = TOP_COLUMNS) -> DataFrame:
    """(column, nulls) of the columns with most nulls, from one pass."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), F.lit(1))).alias(c) for c in df.columns])
    long = counts.unpivot([], df.columns, "column", "nulls")
    return long.orderBy(F.desc("nulls"), "column").limit(top)


def crosstab_null(df: DataFrame, label: str, column: str) -> DataFrame:
    """Rows per label with and without a value in ``column``."""
    missing = F.col(column).isNull()
    return df.groupBy(label).agg(
        F.count(F.when(~missing, F.lit(1))).alias("present"), F.count(F.when(missing, F.lit(1))).alias("missing")
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key, as a one-row table. Counted per key first, so it spreads."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def class_balance(labels: DataFrame) -> DataFrame:
    return labels.agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum(F.col("is_anomaly").cast("bigint")).alias("anomalies"),
        F.round(F.avg("is_anomaly") * 100, 2).alias("anomaly_percent"),
    )


def describe_by_class(
    features: DataFrame, labels: DataFrame, columns: Sequence[str], limit: int = GROUP_ROWS
) -> DataFrame:
    """describe() of several feature columns per class: (is_anomaly, metric, count, mean, ...)."""
    labelled = features.join(labels.select("block_id", "is_anomaly"), "block_id")
    return describe(unpivot(labelled, ["is_anomaly"], columns), ["is_anomaly", "metric"], "value", limit)


def event_presence(occurrences: DataFrame, labels: DataFrame) -> DataFrame:
    """(event, blocks_norm, blocks_anom): blocks of each class that contain the event."""
    labelled = occurrences.filter(F.col("cnt") > 0).join(labels.select("block_id", "is_anomaly"), "block_id")
    return labelled.groupBy("event").agg(
        F.count(F.when(F.col("is_anomaly") == 0, F.lit(1))).alias("blocks_norm"),
        F.count(F.when(F.col("is_anomaly") == 1, F.lit(1))).alias("blocks_anom"),
    )


def event_sets(presence: DataFrame) -> DataFrame:
    """Each event with the classes it occurs in: ``normal``, ``anomaly`` or ``both``."""
    kind = (
        F.when((F.col("blocks_norm") > 0) & (F.col("blocks_anom") > 0), "both")
        .when(F.col("blocks_norm") > 0, "normal")
        .when(F.col("blocks_anom") > 0, "anomaly")
    )
    return presence.select("event", kind.alias("occurs_in")).filter(F.col("occurs_in").isNotNull())


def event_share(occurrences: DataFrame, labels: DataFrame) -> DataFrame:
    """(is_anomaly, event, cnt, share): share of the event among all events of its class."""
    labelled = occurrences.join(labels.select("block_id", "is_anomaly"), "block_id")
    counts = labelled.groupBy("is_anomaly", "event").agg(F.sum("cnt").alias("cnt"))
    return counts.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("is_anomaly")))


def top_events(shares: DataFrame, is_anomaly: int, n: int = TOP_EVENTS) -> DataFrame:
    return shares.filter(F.col("is_anomaly") == is_anomaly).orderBy(F.desc("share"), "event").limit(n)


def share_skew(shares: DataFrame, n: int = TOP_EVENTS) -> DataFrame:
    """Events with a larger share in anomalies than in normal blocks: (event, share_diff)."""
    both = shares.groupBy("event").agg(
        F.coalesce(F.max(F.when(F.col("is_anomaly") == 1, F.col("share"))), F.lit(0.0)).alias("p_anom"),
        F.coalesce(F.max(F.when(F.col("is_anomaly") == 0, F.col("share"))), F.lit(0.0)).alias("p_norm"),
    )
    diff = both.withColumn("share_diff", F.col("p_anom") - F.col("p_norm")).filter(F.col("share_diff") > 0)
    return diff.orderBy(F.desc("share_diff"), "event").limit(n)


def by_event_number(df: DataFrame, column: str = "event") -> DataFrame:
    """Sort E1, E2, ..., E10 by number."""
    return df.orderBy(F.substring(column, 2, 9).cast("int"))
