"""Scores of open blocks in event-time order, whatever the order of arrival.

Rows wait in state until the watermark has passed them, so a block is scored as the batch operators would score it,
also when its rows are spread over many micro-batches. Rows that the watermark has passed before they arrive come
out beside the scores instead of being lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from eventloom.operators.nextevent import BROADCAST_CELLS, NextEventModel
from eventloom.streaming.blocks import use_rocksdb

ROW_DDL = "block_id STRING, events BIGINT, score DOUBLE, mean_nll DOUBLE, alert BOOLEAN, late BOOLEAN, at BIGINT, line_key BIGINT, event INT"
SCORE_COLUMNS = ["block_id", "events", "score", "mean_nll", "alert"]
LATE_COLUMNS = ["block_id", "ts", "line_key", "event"]
#: Groups of blocks that have their state together; rows of them that go on at once.
BUCKETS, ADVANCED_ROWS = 1024, 200_000


def _packed(matrix: np.ndarray) -> np.ndarray:
    """Each row of integers as one byte string, so that rows can be sorted and searched whatever their length."""
    return np.ascontiguousarray(matrix, dtype=">i4").view(f"S{4 * matrix.shape[1]}").ravel()


class _Table:
    """Values by integer row."""

    def __init__(self, rows: np.ndarray, values: np.ndarray) -> None:
        keys = _packed(rows)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, rows: np.ndarray) -> np.ndarray:
        """The value of each row, NaN where there is none."""
        if not len(self.keys) or not len(rows):
            return np.full(len(rows), np.nan)
        wanted = _packed(rows)
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, self.values[place], np.nan)


class ContextSurprise:
    """The surprise of a next-event model of any order: seen cells and the value of all other events, by context."""

    def __init__(self, model: NextEventModel) -> None:
        # at most BROADCAST_CELLS rows leave the cluster, whatever the vocabulary
        rows = model.table.select("context", "next", "log_prob").limit(BROADCAST_CELLS + 1).toPandas()
        if len(rows) > BROADCAST_CELLS:
            raise ValueError("the model has too many cells to ship with the tasks")
        self.order, self.backoff, self.uniform = model.order, model.backoff, float(np.log(model.vocab_size))
        lengths = rows["context"].map(len)
        self.cells, self.others = {}, {}
        for k in range(1, model.order + 1):
            part = rows[lengths == k]
            contexts = np.array(part["context"].tolist(), dtype=np.int64).reshape(len(part), k)
            value, seen = -part["log_prob"].to_numpy(dtype=float), part["next"].notna().to_numpy()
            following = part["next"].to_numpy(dtype=float)[seen].astype(np.int64)[:, None]
            self.cells[k] = _Table(np.hstack([contexts[seen], following]), value[seen])
            self.others[k] = _Table(contexts[~seen], value[~seen])

    def __call__(self, line: np.ndarray, place: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The surprise of the events at ``place`` of a line, each after up to ``order`` of the ``before`` events that precede
        it there; NaN for an event with none before it."""
        found = np.full(len(place), np.nan)
        known = np.minimum(before, self.order)
        for k in range(self.order, 0, -1):
            open_ = np.isnan(found) & ((known >= k) if self.backoff else (known == k))
            if not open_.any():
                continue
            rows = np.lib.stride_tricks.sliding_window_view(line, k + 1)[place[open_] - k]
            value = self.cells[k].find(rows)
            found[open_] = np.where(np.isnan(value), self.others[k].find(rows[:, :k]), value)
        return np.where(np.isnan(found) & (known > 0), self.uniform, found)


class OrderedScores(StatefulProcessor):
    """Rows of a bucket of blocks wait by time slot; an event-time timer takes the slots that the watermark has passed.

    State is asked for once for each slot and batch, and once for each block that goes on, not once for each slot of a block.
    """

    def __init__(self, surprise: ContextSurprise, window: int, threshold: float, slot_ms: int, silence_ms: int | None) -> None:
        self.surprise, self.window, self.threshold = surprise, window, threshold
        self.slot_ms, self.silence_ms = slot_ms, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = "context ARRAY<INT>, seen BIGINT, top DOUBLE, total DOUBLE, alerted BOOLEAN, latest BIGINT"
        self.blocks = handle.getMapState("blocks", "block_id STRING", kept)
        # the timer that is set, when silent blocks are looked for, how many parts have come
        self.mark = handle.getValueState("mark", "due BIGINT, sweep BIGINT, parts BIGINT")
        # owners are numbers of block_ids; numbers as 64-bit integers
        self.waiting = handle.getMapState("waiting", "slot BIGINT, part BIGINT", "block_ids ARRAY<STRING>, rows BINARY")

    def _set(self, old: int | None, due: int | None, sweep: int | None, parts: int) -> None:
        wanted = min((t for t in (due, sweep) if t is not None), default=None)
        if wanted != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.mark.update((wanted, sweep, parts))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due, sweep, parts = self.mark.get() if self.mark.exists() else (None, None, 0)
        first = None
        for part in rows:
            lost = part[["at", "line_key", "event"]].isna().any(axis=1)
            lost |= part["at"].fillna(0) // 1000 <= passed if passed > 0 else False
            if lost.any():
                yield self._late(part[lost])
            good = part[~lost]
            if not len(good):
                continue
            columns = [good[c].to_numpy(dtype=np.int64) for c in ("at", "line_key", "event")]
            slot = columns[0] // (1000 * self.slot_ms)
            order = np.argsort(slot, kind="stable")
            starts = np.flatnonzero(np.diff(slot[order], prepend=slot[order[0]] - 1))
            blocks = good["block_id"].to_numpy(dtype=object)
            for some in np.split(order, starts[1:]):
                owner, names = pd.factorize(blocks[some], use_na_sentinel=False)
                packed = np.stack([owner.astype(np.int64), *[c[some] for c in columns]])
                self.waiting.updateValue((int(slot[some[0]]), parts), ([None if pd.isna(n) else n for n in names], packed.tobytes()))
            parts += 1
            earliest = int(slot[order[0]])
            first = earliest if first is None else min(first, earliest)
        if first is None:
            return
        # a timer for silent blocks is later than any row that is not late
        end = (first + 1) * self.slot_ms
        self._set(due, end if due is None else min(due, end), sweep, parts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        _, sweep, parts = self.mark.get()
        keys = sorted(tuple(k) for k in self.waiting.keys())
        done = [k for k in keys if (k[0] + 1) * self.slot_ms <= passed]
        left = keys[len(done) :]
        some, size = [], 0
        for i, (slot, part) in enumerate(done):
            names, packed = self.waiting.getValue((slot, part))
            self.waiting.removeKey((slot, part))
            some.append((list(names), np.frombuffer(packed, np.int64).reshape(4, -1), slot))
            size += some[-1][1].shape[1]
            # whole slots, so that a slot's rows are ordered together
            if i + 1 == len(done) or (size >= ADVANCED_ROWS and done[i + 1][0] != slot):
                yield self._advance(some)
                some, size = [], 0
        if self.silence_ms is not None:
            if sweep is not None and sweep <= passed:
                sweep = self._sweep(passed, left[0][0] * self.slot_ms if left else None)
            elif sweep is None and done:
                sweep = passed + self.silence_ms
        self._set(None, (left[0][0] + 1) * self.slot_ms if left else None, sweep, parts)

    def _sweep(self, passed: int, waiting: int | None) -> int | None:
        """Forget the blocks that have been silent for long enough to start anew whatever still comes; when to look again."""
        rest = False
        for name, state in list(self.blocks.iterator()):
            end = state[5] // 1000 + self.silence_ms
            if end <= passed and (waiting is None or waiting > end):
                self.blocks.removeKey(name)
            else:
                rest = True
        return passed + self.silence_ms if rest else None

    def _advance(self, some: list[tuple[list, np.ndarray, int]]) -> pd.DataFrame:
        """Take rows of whole slots in the order of time: a row for each slot of a block, where a silence starts it anew."""
        number: dict = {}
        owner = np.concatenate([np.array([number.setdefault(n, len(number)) for n in names], np.int64)[rows[0]] for names, rows, _ in some])
        at, line_key, events = (np.concatenate([rows[i] for _, rows, _ in some]) for i in (1, 2, 3))
        slot = np.repeat([s for *_, s in some], [rows.shape[1] for _, rows, _ in some])
        order = np.lexsort((line_key, at, owner))
        owner, at, events, slot = owner[order], at[order], events[order], slot[order]
        names = list(number)
        states = [self.blocks.getValue((n,)) or ([], 0, 0.0, 0.0, False, 0) for n in names]
        seen, top, total, alerted, latest = (np.array([s[i] for s in states], t) for i, t in zip(range(1, 6), (np.int64, float, float, bool, np.int64), strict=True))
        # runs of a block without a silence; the first may go on from the state
        opens = np.diff(owner, prepend=-1) != 0
        begins = opens & (seen[owner] == 0)
        if self.silence_ms is not None:
            before = np.where(opens, np.where(seen[owner] > 0, latest[owner], at), np.concatenate([at[:1], at[:-1]]))
            begins |= at - before > self.silence_ms * 1000
        run = np.cumsum(opens | begins) - 1
        start = np.flatnonzero(opens | begins)
        whose, carried = owner[start], ~begins[start]
        contexts = [list(states[b][0]) if c else [] for b, c in zip(whose.tolist(), carried.tolist(), strict=True)]
        ahead = np.fromiter(map(len, contexts), np.int64, len(contexts))
        place = np.arange(len(events)) + np.cumsum(ahead)[run]
        line = np.zeros(len(events) + ahead.sum(), np.int64)
        given = np.ones(len(line), bool)
        given[place] = False
        line[given], line[place] = np.array([e for c in contexts for e in c], np.int64), events
        within = np.arange(len(events)) - start[run]
        nll = np.nan_to_num(self.surprise(line, place, within + ahead[run]), nan=0.0)
        by_run = pd.Series(nll).groupby(run)
        n = within + 1 + np.where(carried, seen[whose], 0)[run]
        highest = np.maximum(by_run.cummax().to_numpy(), np.where(carried, top[whose], 0.0)[run])
        sums = by_run.cumsum().to_numpy() + np.where(carried, total[whose], 0.0)[run]
        # one row for each slot of a run
        ends = np.flatnonzero(np.append((np.diff(run) != 0) | (np.diff(slot) != 0), True))
        scored = n[ends] > self.window
        reached = scored & (highest[ends] >= self.threshold)
        again = np.concatenate([[False], reached[:-1] & (run[ends][1:] == run[ends][:-1])])
        known = (carried & alerted[whose])[run[ends]]
        last = np.flatnonzero(np.append(np.diff(owner) != 0, True))
        at_last = np.searchsorted(ends, last)
        for b, i, e in zip(owner[last].tolist(), last.tolist(), at_last.tolist(), strict=True):
            begin = place[i] - min(int(within[i] + ahead[run[i]]), self.surprise.order - 1)
            context = line[begin : place[i] + 1].tolist()
            self.blocks.updateValue((names[b],), (context, int(n[i]), float(highest[i]), float(sums[i]), bool(reached[e] or known[e]), int(at[i])))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = sums[ends] / (n[ends] - 1)
        made = {
            "block_id": np.array(names, dtype=object)[owner[ends]],
            "events": n[ends],
            "score": np.where(scored, highest[ends], np.nan),
            "mean_nll": np.where(scored, mean, np.nan),
            "alert": reached & ~again & ~known,
            "late": np.zeros(len(ends), bool),
        }
        return self._frame(made, len(ends))

    def _late(self, rows: pd.DataFrame) -> pd.DataFrame:
        found: dict = {n: [None if pd.isna(v) else int(v) for v in rows[n].tolist()] for n in ("at", "line_key", "event")}
        return self._frame({"block_id": rows["block_id"].to_numpy(dtype=object), "late": np.ones(len(rows), bool), **found}, len(rows))

    def _frame(self, made: dict, n: int) -> pd.DataFrame:
        columns = [c.split()[0] for c in ROW_DDL.split(", ")]
        kinds = {c: object for c in ("at", "line_key", "event")}
        return pd.DataFrame({c: pd.Series(made.get(c, [None] * n), dtype=kinds.get(c) if c in made else object) for c in columns})

    def close(self) -> None:
        pass


def ordered_scores(
    events: DataFrame, model: NextEventModel, window: int, threshold: float, slot_seconds: int = 60, silence_seconds: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Running scores of blocks whose rows arrive in any order, and the rows that came too late.

    ``events`` needs a watermark on ``ts``. Rows wait until the watermark has passed the end of their slot of
    ``slot_seconds``; then the block goes on in the order of (ts, line_key) and gives, for each slot, a row of
    (block_id, events, score, mean_nll, alert). A block is scored once it has more than ``window`` events and raises
    one alert; an event is judged after up to ``order`` events before it, so a first-order score equals the batch
    ``nll_max``. After ``silence_seconds`` without events a block is forgotten, and starts anew if it comes back.

    Rows that the watermark had passed when they arrived, and rows without time, key or event, take no part: they have
    ``late`` set and carry their own columns. A row that is delivered twice counts twice. State holds a few numbers for
    a block and the rows that still wait, of which new rows touch none. Blocks are dealt into ``buckets`` by a hash, so that
    state is asked for many blocks at once; a checkpoint keeps to the number it was begun with. An empty stream gives no
    rows, and other columns of ``events`` are not read.
    """
    use_rocksdb(events)
    # as a number, time keeps its meaning in every zone, and late rows are not taken away before they can be told apart
    bucket = F.pmod(F.xxhash64("block_id"), F.lit(buckets)).alias("bucket")
    rows = events.select(bucket, "block_id", F.unix_micros("ts").alias("at"), "line_key", "event")
    silence = None if silence_seconds is None else silence_seconds * 1000
    processor = OrderedScores(ContextSurprise(model), window, threshold, slot_seconds * 1000, silence)
    made = rows.groupBy("bucket").transformWithStateInPandas(processor, ROW_DDL, "Append", "EventTime")
    return made.withColumn("ts", F.timestamp_micros("at")).select(*SCORE_COLUMNS, "late", "ts", "line_key", "event")


def write_scores(rows: DataFrame, scores_path: str, late_path: str, checkpoint: str) -> DataStreamWriter:
    """Writer of ``ordered_scores``: scores to one table, late rows to the other.

    Each micro-batch owns a folder in both, which is replaced when the batch is run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.where(~F.col("late")).select(*SCORE_COLUMNS).write.mode("overwrite").parquet(f"{scores_path.rstrip('/')}/batch={number}")
        kept.where("late").select(*LATE_COLUMNS).write.mode("overwrite").parquet(f"{late_path.rstrip('/')}/batch={number}")
        kept.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
