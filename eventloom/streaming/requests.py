"""Streaming request statistics, rate-limit audit and the history append."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from eventloom.operators.requests import OK
from eventloom.sources.requests import append_outcomes
from eventloom.streaming.blocks import use_rocksdb

AUDIT_DDL = "limit_key STRING, request_id STRING, ts TIMESTAMP, estimate BIGINT, allowed BOOLEAN, remaining BIGINT"


def windowed_stats(history: DataFrame, width: str = "1 hour", accuracy: int = 10_000) -> DataFrame:
    """Request statistics per tumbling window of ``created_at`` (which needs a watermark).

    Quantiles come from mergeable sketches, so a window's state does not grow with its requests.
    """
    grid = F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))
    stats = history.groupBy(F.window("created_at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count(F.when(F.col("status_code") == OK, F.lit(1))).alias("successful_requests"),
        F.count(F.when(F.col("status_code") != OK, F.lit(1))).alias("failed_requests"),
        F.avg("processing_ms").alias("mean_processing_ms"),
        F.percentile_approx("processing_ms", grid, accuracy).alias("_q"),
        F.avg("num_log_lines").alias("mean_num_log_lines"),
        F.min("num_log_lines").alias("min_num_log_lines"),
        F.max("num_log_lines").alias("max_num_log_lines"),
    )
    q = {f"p{p}_processing_ms": F.element_at("_q", i + 1) for i, p in enumerate((50, 95, 99))}
    kept = [c for c in stats.columns if c not in ("w", "_q")]
    return stats.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *kept, *[c.alias(n) for n, c in q.items()]
    )


class LimitCounters(StatefulProcessor):
    """Current and previous window count of each key."""

    def __init__(self, amount: int, seconds: int) -> None:
        self.amount, self.seconds = amount, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "slot BIGINT, current BIGINT, previous BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        at = pd.to_datetime(batch["ts"]).astype("datetime64[ns]").astype("int64").to_numpy() / 1e9
        slots = np.floor(at / self.seconds).astype(int)
        known = {}
        if self.counts.exists():
            slot, current, previous = self.counts.get()
            known = {slot: current, slot - 1: previous}
        per_slot = pd.Series(slots).value_counts().to_dict()
        place = pd.Series(slots).groupby(slots).cumcount().to_numpy() + 1
        here = place + np.array([known.get(s, 0) for s in slots])
        total = {s: known.get(s, 0) + per_slot.get(s, 0) for s in set(known) | set(per_slot)}
        before = np.array([total.get(s - 1, 0) for s in slots])
        estimate = np.floor(before * (1 - (at - slots * self.seconds) / self.seconds)).astype(int) + here
        newest = max(total)
        self.counts.update((int(newest), int(total[newest]), int(total.get(newest - 1, 0))))
        yield pd.DataFrame(
            {
                "limit_key": key[0],
                "request_id": batch["request_id"].to_numpy(),
                "ts": batch["ts"].to_numpy(),
                "estimate": estimate,
                "allowed": estimate <= self.amount,
                "remaining": np.maximum(self.amount - estimate, 0),
            }
        )

    def close(self) -> None:
        pass


def audit_stream(requests: DataFrame, amount: int, seconds: int) -> DataFrame:
    """Sliding-window-counter audit of (limit_key, request_id, ts) rows as they arrive."""
    use_rocksdb(requests)
    keyed = requests.select("limit_key", "request_id", "ts").groupBy("limit_key")
    return keyed.transformWithStateInPandas(LimitCounters(amount, seconds), AUDIT_DDL, "Append", "None")


def append_history(outcomes: DataFrame, path: str, checkpoint: str, late: str = "10 minutes") -> DataStreamWriter:
    """Writer that adds each request outcome once to a history that ``sources.requests`` reads and writes too.

    Requests repeated within ``late`` are dropped by id. Each micro-batch becomes a version of the history, which
    records the checkpoint's name and the number of the batch: a batch that is run again adds nothing, and a stream
    that starts anew with another checkpoint leaves earlier rows alone.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    unique = outcomes.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["request_id"])

    def write(batch: DataFrame, number: int) -> None:
        append_outcomes(batch, path, (stream, number), check_stored=False)

    return unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
