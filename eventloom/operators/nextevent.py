"""Next-event probabilities and the surprise they assign to each event."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.arrays import log_softmax_nll, topk_miss
from eventloom.functions.checks import check_top_k
from eventloom.operators.ordered import GROUP_ROWS, following
from eventloom.operators.sequences import ORDER

#: Model cells (contexts times vocabulary) up to which the table is broadcast.
BROADCAST_CELLS = 1_000_000


@dataclass(frozen=True)
class NextEventModel:
    """Smoothed next-event probabilities for contexts of 1 to ``order`` events, of which only seen cells are kept.

    ``table`` holds (context, next, log_prob, rank, seen): one row for every event seen after a context in training,
    and for every context a row without ``next`` that speaks for all other events, with their common log_prob, the
    number of seen events as rank, and those events. Its rows are at most twice the training positions of each order,
    whatever the vocabulary. Contexts that are not in it are uniform, or with ``backoff`` stand for their longest
    known ending.
    """

    table: DataFrame
    vocab_size: int
    order: int
    backoff: bool = False

    @property
    def cells_bound(self) -> int:
        return self.order * self.vocab_size ** (self.order + 1)

    def cells(self, length: int) -> DataFrame:
        """(context, next, log_prob, rank) of seen cells with contexts of that length."""
        return self.table.where((F.size("context") == length) & F.col("next").isNotNull()).select("context", "next", "log_prob", "rank")

    def others(self, length: int) -> DataFrame:
        """(context, log_prob, seen) for the events not seen after a context of that length."""
        return self.table.where((F.size("context") == length) & F.col("next").isNull()).select("context", "log_prob", "seen")

    def probabilities(self, length: int) -> DataFrame:
        """(context, next, log_prob, rank) for every event of the vocabulary after every known context: a grid, on demand only."""
        every = F.sequence(F.lit(0), F.lit(self.vocab_size - 1))
        others = self.others(length).withColumn("next", F.explode(F.array_except(every, "seen")))
        return self.cells(length).unionByName(others.select("context", "next", "log_prob", unseen_rank(F.col("seen"), F.col("next")).alias("rank")))


def unseen_rank(seen: Column, event: Column) -> Column:
    """The rank of an event that was not seen: behind all seen ones, by number among the others."""
    return F.size(seen) + 1 + event - F.size(F.filter(seen, lambda x: x < event))


def _context_rows(events: DataFrame, order: int, limit: int) -> DataFrame:
    """Each event with the next ``order`` events (columns next_1, next_2, ...) and its position."""
    leads = {f"next_{k}": ("event", k) for k in range(1, order + 1)}
    return following(events.select("block_id", "event", *ORDER), ["block_id"], ORDER, leads, limit=limit)


def _context(k: int) -> Column:
    return F.array("event", *[F.col(f"next_{i}") for i in range(1, k)])


def fit_next_event(
    events: DataFrame, vocab_size: int, order: int = 1, alpha: float = 1.0, limit: int = GROUP_ROWS, backoff: bool = False
) -> NextEventModel:
    """Count what follows each context in (training) events and smooth with ``alpha`` per event."""
    if order < 1:
        raise ValueError("order must be at least 1")
    if alpha <= 0:
        raise ValueError("alpha must be positive, or unseen events have no probability")
    rows = _context_rows(events, order, limit)
    cases = F.explode(
        F.array(*[F.struct(_context(k).alias("context"), F.col(f"next_{k}").alias("next")) for k in range(1, order + 1)])
    )
    counts = (
        rows.select(cases.alias("c"))
        .select("c.*")
        .filter(F.col("next").isNotNull())
        .groupBy("context", "next")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # per context: at most one entry per event seen after it
    ranked = counts.groupBy("context").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("next").cast("int").alias("next")))).alias("_r"), F.sum("n").alias("_total")
    )
    cells = F.transform("_r", lambda x, i: F.struct(x["next"].alias("next"), (-x["less"]).alias("n"), (i + 1).alias("rank")))
    other = F.array(F.struct(F.lit(None).cast("int").alias("next"), F.lit(0).cast("long").alias("n"), F.size("_r").alias("rank")))
    rows = ranked.select(
        "context", "_total", F.array_sort(F.transform("_r", lambda x: x["next"])).alias("_seen"), F.explode(F.concat(cells, other)).alias("c")
    )
    table = rows.select(
        "context",
        "c.next",
        F.log((F.col("c.n") + alpha) / (F.col("_total") + alpha * vocab_size)).alias("log_prob"),
        "c.rank",
        F.when(F.col("c.next").isNull(), F.col("_seen")).alias("seen"),
    )
    return NextEventModel(table, vocab_size, order, backoff)


def event_surprise(events: DataFrame, model: NextEventModel, top_k: int = 3, limit: int = GROUP_ROWS) -> DataFrame:
    """(block_id, pos, nll, miss): what the model thought of the events after position ``pos``.

    ``nll[k-1]`` and ``miss[k-1]`` belong to the event at ``pos + k`` seen after the ``k`` events from
    ``pos`` on. Each event is looked up once per context length, not once per window that covers it; with
    back-off once more for every shorter ending of the context. Rows without ``order`` following events are left out.
    """
    check_top_k(top_k)
    rows = _context_rows(events, model.order, limit).filter(F.col(f"next_{model.order}").isNotNull())
    uniform = float(np.log(model.vocab_size))
    cap = min(top_k, model.vocab_size)
    fitted = F.broadcast if model.cells_bound <= BROADCAST_CELLS else lambda part: part
    names = ["event", *[f"next_{i}" for i in range(1, model.order + 1)]]
    for k in range(1, model.order + 1):
        target = F.col(names[k])
        known = []
        for length in range(k, 0, -1) if model.backoff else [k]:
            context = F.array(*names[k - length : k])
            cells = model.cells(length).select(F.col("context").alias("_ctx"), F.col("next").alias("_next"), F.struct("log_prob", "rank").alias(f"_cell_{length}"))
            others = model.others(length).select(F.col("context").alias("_ctx"), F.struct("log_prob", "seen").alias(f"_other_{length}"))
            rows = rows.join(fitted(cells), (context == F.col("_ctx")) & (target == F.col("_next")), "left").drop("_ctx", "_next")
            rows = rows.join(fitted(others), context == F.col("_ctx"), "left").drop("_ctx")
            other = F.col(f"_other_{length}")
            unseen = F.when(other.isNotNull(), F.struct(other["log_prob"].alias("log_prob"), unseen_rank(other["seen"], target).alias("rank")))
            known.append(F.coalesce(f"_cell_{length}", unseen))
        rows = rows.withColumn("_found", F.coalesce(*known))
        rows = (
            rows.withColumn(f"nll_{k}", F.coalesce(-F.col("_found.log_prob"), F.lit(uniform)))
            .withColumn(f"miss_{k}", (F.coalesce("_found.rank", target + 1) > cap).cast("int"))
            .select(*[c for c in rows.columns if not c.startswith("_")], f"nll_{k}", f"miss_{k}")
        )
    orders = range(1, model.order + 1)
    return rows.select(
        "block_id",
        "pos",
        F.array(*[f"nll_{k}" for k in orders]).alias("nll"),
        F.array(*[f"miss_{k}" for k in orders]).alias("miss"),
    )


def predict_logits(
    windows: DataFrame, predict: Callable[[np.ndarray], np.ndarray], batch_rows: int = 1024
) -> DataFrame:
    """Add ``logits`` from a model of the caller's: ``predict(int[n, W]) -> float[n, W, V]``.

    The callable is shipped with the tasks and works on Arrow batches of window rows.
    """
    schema = T.StructType(windows.schema.fields + [T.StructField("logits", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                part = batch.iloc[start : start + batch_rows].copy()
                values = predict(np.stack(part["window"].to_numpy()).astype(np.int64))
                part["logits"] = [row.astype(float).tolist() for row in values]
                yield part

    return windows.mapInPandas(run, schema)


def score_logits(windows: DataFrame, top_k: int = 3) -> DataFrame:
    """Add per-position ``nll`` and ``miss`` arrays of many-to-many windows with ``logits``."""
    pairs = F.arrays_zip("logits", "target")
    return windows.withColumns(
        {
            "nll": F.transform(pairs, lambda p: log_softmax_nll(p["logits"], p["target"])),
            "miss": F.transform(pairs, lambda p: topk_miss(p["logits"], p["target"], top_k)),
        }
    )
