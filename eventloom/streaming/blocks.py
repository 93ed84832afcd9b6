"""Stateful operators over events of open blocks. State per block stays small however long it lives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventloom.operators.nextevent import BROADCAST_CELLS, NextEventModel
from eventloom.operators.ordered import CHUNK_EVENTS
from eventloom.session import STATE_STORE

SCORE_DDL = "block_id STRING, events BIGINT, score DOUBLE, mean_nll DOUBLE, alert BOOLEAN"
SEQUENCE_DDL = "block_id STRING, started TIMESTAMP, chunk BIGINT, sequence ARRAY<INT>, closed BOOLEAN"


def use_rocksdb(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One micro-batch of one block in event order; its size is set by the source's trigger limits."""
    parts = [r for r in rows if len(r)]
    batch = pd.concat(parts) if parts else pd.DataFrame(columns=["ts", "line_key", "event"])
    return batch.sort_values(["ts", "line_key"])


class Surprise:
    """The surprise of a first-order model: its seen cells by key, and one value for all other events after an event."""

    def __init__(self, keys: np.ndarray, nll: np.ndarray, others: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.nll, self.others = keys[order], nll[order], others

    def __call__(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        wanted = before * len(self.others) + after
        if not len(self.keys):
            return self.others[before]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.nll[at], self.others[before])


class BlockScores(StatefulProcessor):
    """Running maximum and mean surprise of each block with a first-order model."""

    def __init__(self, surprise: Surprise, window: int, threshold: float) -> None:
        self.surprise, self.window, self.threshold = surprise, window, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = "last INT, seen BIGINT, top DOUBLE, total DOUBLE, alerted BOOLEAN"
        self.state = handle.getValueState("block", kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = _ordered(rows)["event"].to_numpy(dtype=int)
        last, seen, top, total, alerted = self.state.get() if self.state.exists() else (-1, 0, 0.0, 0.0, False)
        before = np.concatenate([[last], events[:-1]]) if seen else events[:-1]
        after = events if seen else events[1:]
        nll = self.surprise(before, after)
        if len(nll):
            top, total = max(top, float(nll.max())), total + float(nll.sum())
        seen += len(events)
        scored = seen > self.window
        alert = bool(scored and not alerted and top >= self.threshold)
        self.state.update((int(events[-1]), int(seen), float(top), float(total), bool(alerted or alert)))
        yield pd.DataFrame(
            {
                "block_id": [key[0]],
                "events": [seen],
                "score": [top if scored else None],
                "mean_nll": [total / (seen - 1) if scored else None],
                "alert": [alert],
            }
        )

    def close(self) -> None:
        pass


def running_scores(events: DataFrame, model: NextEventModel, window: int, threshold: float) -> DataFrame:
    """Score open blocks as their events arrive: (block_id, events, score, mean_nll, alert).

    A block is scored once it has more than ``window`` events, and raises one alert. With a first-order
    model and stride 1 the score after the last event equals the batch ``nll_max``. Events are ordered
    inside a micro-batch; batches are taken in order of arrival.
    """
    if model.order != 1:
        raise ValueError("the streaming score uses a first-order model")
    use_rocksdb(events)
    v = model.vocab_size
    # at most BROADCAST_CELLS rows leave the cluster, whatever the vocabulary
    seen = model.cells(1).select(F.element_at("context", 1).alias("prev"), "next", "log_prob").limit(BROADCAST_CELLS + 1).toPandas()
    if len(seen) > BROADCAST_CELLS:
        raise ValueError("the model has too many cells to ship with the tasks")
    rest = model.others(1).select(F.element_at("context", 1).alias("prev"), "log_prob").toPandas()
    others = np.full(v, np.log(v))
    others[rest["prev"].to_numpy(dtype=int)] = -rest["log_prob"].to_numpy(dtype=float)
    keys = seen["prev"].to_numpy(dtype=np.int64) * v + seen["next"].to_numpy(dtype=np.int64)
    surprise = Surprise(keys, -seen["log_prob"].to_numpy(dtype=float), others)
    keyed = events.select("block_id", "ts", "line_key", "event").groupBy("block_id")
    return keyed.transformWithStateInPandas(
        BlockScores(surprise, window, threshold), SCORE_DDL, "Update", "None"
    )


class ClosedSequences(StatefulProcessor):
    """Collects a block's events and hands them out in chunks, the last one when the block falls silent."""

    def __init__(self, gap_ms: int, size: int) -> None:
        self.gap_ms, self.size = gap_ms, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.info = handle.getValueState("info", "started BIGINT, latest BIGINT, chunk BIGINT")
        self.open = handle.getListState("open", "event INT")

    def _rows(self, key, started: int, chunk: int, events: list[int], closed: bool) -> tuple[list[dict], int, list[int]]:
        out = []
        while len(events) > self.size or (closed and events):
            part, events = events[: self.size], events[self.size :]
            out.append(
                {
                    "block_id": key[0],
                    "started": pd.Timestamp(started, unit="ms"),
                    "chunk": chunk,
                    "sequence": part,
                    "closed": closed and not events,
                }
            )
            chunk += 1
        return out, chunk, events

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows)
        times = (pd.to_datetime(batch["ts"]).astype("datetime64[ns]").astype("int64") // 1_000_000).to_numpy()
        events = batch["event"].to_numpy(dtype=int)
        if self.info.exists():
            started, latest, chunk = self.info.get()
            pending = [r[0] for r in self.open.get()]
            self.handle.deleteTimer(latest + self.gap_ms)
        else:
            started, latest, chunk, pending = int(times[0]), int(times[0]), 0, []
        gaps = np.diff(times, prepend=latest) > self.gap_ms
        out = []
        for piece, when in zip(np.split(events, np.flatnonzero(gaps)), np.split(times, np.flatnonzero(gaps)), strict=True):
            if not len(piece):
                continue
            if int(when[0]) - latest > self.gap_ms:
                made, chunk, pending = self._rows(key, started, chunk, pending, True)
                out += made
                started, chunk = int(when[0]), 0
            pending += piece.tolist()
            latest = max(latest, int(when[-1]))
            made, chunk, pending = self._rows(key, started, chunk, pending, False)
            out += made
        self.info.update((started, latest, chunk))
        self.open.put([(int(e),) for e in pending])
        self.handle.registerTimer(latest + self.gap_ms)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, latest, chunk = self.info.get()
        out, _, _ = self._rows(key, started, chunk, [r[0] for r in self.open.get()], True)
        self.info.clear()
        self.open.clear()
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def closed_sequences(events: DataFrame, gap_seconds: int, size: int = CHUNK_EVENTS) -> DataFrame:
    """Final sequences of blocks that were silent for ``gap_seconds`` of event time.

    ``events`` needs a watermark on ``ts``. At most ``size`` events per block wait in state: a longer block is
    handed out in chunks, the last of them marked ``closed``.
    """
    use_rocksdb(events)
    keyed = events.select("block_id", "ts", "line_key", "event").groupBy("block_id")
    return keyed.transformWithStateInPandas(
        ClosedSequences(gap_seconds * 1000, size), SEQUENCE_DDL, "Append", "EventTime"
    )


def session_counts(events: DataFrame, gap: str) -> DataFrame:
    """(block_id, started, ended, events) of closed sessions; partial sums only, so any size is fine."""
    return (
        events.groupBy("block_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("block_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")
    )
