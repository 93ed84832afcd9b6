"""From surprise to window scores, block scores and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.arrays import window_scores
from eventloom.functions.checks import STRATEGIES, check_strategies, check_window
from eventloom.operators.nextevent import NextEventModel, event_surprise
from eventloom.operators.ordered import CHUNK_EVENTS, GROUP_ROWS, quantiles, spread_chunks
from eventloom.operators.windows import chunk_arrays, cut_windows, window_starts
from eventloom.session import cut_lineage


def window_surprise(
    events: DataFrame,
    model: NextEventModel,
    window: int,
    stride: int = 1,
    top_k: int = 3,
    size: int = CHUNK_EVENTS,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """(block_id, start, nll, miss): per-position arrays of every many-to-many window.

    Positions near the window start see only the events inside the window, later ones a full context.
    """
    check_window(window, stride)
    order = model.order
    if order > window:
        raise ValueError("the model order must not exceed the window size")
    rows = event_surprise(events, model, top_k, limit)
    chunks = chunk_arrays(rows, ["nll", "miss"], window - order, size)
    # values with full context, which every window position but the first ones uses
    chunks = chunks.withColumns(
        {
            "_nll": F.transform("items", lambda x: F.element_at(x["nll"], order)),
            "_miss": F.transform("items", lambda x: F.element_at(x["miss"], order)),
        }
    )

    def cut(start: Column) -> Column:
        at = (start - F.col("base") + 1).cast("int")

        def positions_of(name: str) -> Column:
            if order == 1:
                return F.slice(f"_{name}", at, window)
            return F.concat(F.element_at("items", at)[name], F.slice(f"_{name}", at + 1, window - order))

        return F.struct(start.alias("start"), positions_of("nll").alias("nll"), positions_of("miss").alias("miss"))

    return cut_windows(chunks, window_starts(stride, window - order + 1, size), cut)


def score_windows(surprise: DataFrame, strategies: Sequence[str] = STRATEGIES) -> DataFrame:
    """One score column per strategy; ``nll_p95`` stays an array of positions."""
    columns = window_scores(F.col("miss"), F.col("nll"), check_strategies(strategies))
    return surprise.select("block_id", "start", *[c.alias(name) for name, c in columns.items()])


def window_table(
    events: DataFrame,
    model: NextEventModel,
    window: int,
    stride: int = 1,
    top_k: int = 3,
    size: int = CHUNK_EVENTS,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """(block_id, start, nll_sum, nll_mean, nll_max, topk_last, topk_all, topk_last3) of every many-to-many window.

    The same numbers as ``score_windows`` of ``window_surprise``, but a window is a frame over the rows of its chunk:
    no arrays are cut, and no position is copied for each window that covers it.
    """
    check_window(window, stride)
    order = model.order
    if order > window:
        raise ValueError("the model order must not exceed the window size")
    span = window - order  # rows a window reads after its first
    short = range(1, order)  # places at the start of a window, which see fewer events
    rows = spread_chunks(event_surprise(events, model, top_k, limit), size, span)
    chunk = Window.partitionBy("block_id", "chunk").orderBy("pos")
    frame = chunk.rowsBetween(0, span)
    nll, miss = F.element_at("nll", order), F.element_at("miss", order)
    last = min(3, window)
    in_frame = min(last, span + 1)
    tail = F.sum(miss).over(chunk.rowsBetween(span + 1 - in_frame, span))
    framed = rows.select(
        "block_id",
        F.col("pos").alias("start"),
        sum((F.element_at("nll", k) for k in short), F.sum(nll).over(frame)).alias("nll_sum"),
        F.greatest(F.max(nll).over(frame), *[F.element_at("nll", k) for k in short]).alias("nll_max")
        if order > 1
        else F.max(nll).over(frame).alias("nll_max"),
        sum((F.element_at("miss", k) for k in short), F.sum(miss).over(frame)).alias("_missed"),
        F.last(miss).over(frame).cast("double").alias("topk_last"),
        (sum((F.element_at("miss", order - i) for i in range(1, last - in_frame + 1)), tail) / last).alias("topk_last3"),
        F.count(F.lit(1)).over(frame).alias("_rows"),
        (F.col("pos") < (F.col("chunk") + 1) * size).alias("_own"),
    )
    # the look-ahead of a chunk starts no window, nor do rows with too few after them
    starts = framed.filter((F.col("_rows") == span + 1) & F.col("_own") & (F.col("start") % stride == 0))
    return starts.select(
        "block_id", "start", "nll_sum", (F.col("nll_sum") / window).alias("nll_mean"), "nll_max",
        "topk_last", (F.col("_missed") / window).alias("topk_all"), "topk_last3",
    )


def position_weights(
    events: DataFrame, model: NextEventModel, window: int, stride: int = 1, top_k: int = 3, limit: int = GROUP_ROWS
) -> DataFrame:
    """(block_id, num_windows, value, n): surprises of a block with the number of window positions that show them."""
    order = model.order
    span = window - order
    rows = event_surprise(events, model, top_k, limit)
    longest = rows.groupBy("block_id").agg(F.max("pos").alias("_r"))
    last = longest.filter(F.col("_r") >= span).select("block_id", (F.floor((F.col("_r") - span) / stride) * stride).alias("_last"))
    placed = rows.join(last, "block_id")
    covering = F.floor(F.least("pos", "_last") / stride) - F.ceil(F.greatest(F.col("pos") - span, F.lit(0)) / stride) + 1
    starts = ((F.col("pos") % stride == 0) & (F.col("pos") <= F.col("_last"))).cast("bigint")
    shown = [F.struct(F.element_at("nll", order).alias("value"), covering.cast("bigint").alias("n"))]
    shown += [F.struct(F.element_at("nll", k).alias("value"), starts.alias("n")) for k in range(1, order)]
    items = placed.select("block_id", "_last", F.explode(F.array(*shown)).alias("s")).filter(F.col("s.n") > 0)
    counted = items.groupBy("block_id", "_last", F.col("s.value").alias("value")).agg(F.sum("s.n").alias("n"))
    return counted.select("block_id", (F.col("_last") / stride + 1).cast("bigint").alias("num_windows"), "value", "n")


def score_events(
    events: DataFrame,
    model: NextEventModel,
    window: int,
    stride: int = 1,
    labels: DataFrame | None = None,
    strategies: Sequence[str] = STRATEGIES,
    top_k: int = 3,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Block scores straight from events, as ``score_blocks`` gives them for ``window_surprise``."""
    strategies = check_strategies(strategies)
    parts = []
    simple = [s for s in strategies if s != "nll_p95"]
    if simple:
        parts.append(_folded(window_table(events, model, window, stride, top_k, limit=limit), simple))
    if "nll_p95" in strategies:
        # read by the quantile and by the totals
        parts.append(_upper(cut_lineage(position_weights(events, model, window, stride, top_k, limit)), limit))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return with_truth(result, labels)


def _folded(scored: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """(block_id, num_windows, strategy, score, window_score_max) from one row per window."""
    folds = []
    for s in strategies:
        fold = F.max if s == "nll_max" else F.avg
        folds += [fold(s).alias(f"{s}_score"), F.max(s).alias(f"{s}_top")]
    per_block = scored.groupBy("block_id").agg(F.count(F.lit(1)).alias("num_windows"), *folds)
    named = [
        F.struct(F.lit(s).alias("strategy"), F.col(f"{s}_score").alias("score"), F.col(f"{s}_top").alias("window_score_max")) for s in strategies
    ]
    return per_block.select("block_id", "num_windows", F.explode(F.array(*named)).alias("r")).select("block_id", "num_windows", "r.*")


def _upper(counted: DataFrame, limit: int) -> DataFrame:
    """The 0.95 quantile of (block_id, num_windows, value, n)."""
    top = counted.groupBy("block_id", "num_windows").agg(F.max("value").alias("window_score_max"))
    p95 = quantiles(counted, ["block_id"], "value", {"score": 0.95}, limit, weight="n")
    return top.join(p95, "block_id").select("block_id", "num_windows", F.lit("nll_p95").alias("strategy"), "score", "window_score_max")


def score_blocks(
    surprise: DataFrame,
    labels: DataFrame | None = None,
    strategies: Sequence[str] = STRATEGIES,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """(block_id, y_true, num_windows, strategy, score, window_score_max) from arrays of positions, as a network gives them.

    ``nll_max`` takes the maximum over windows, ``nll_p95`` the 0.95 quantile over all window positions,
    the others the mean over windows.
    """
    strategies = check_strategies(strategies)
    parts = []
    simple = [s for s in strategies if s != "nll_p95"]
    if simple:
        parts.append(_folded(score_windows(surprise, simple), simple))
    if "nll_p95" in strategies:
        places = surprise.select("block_id", F.size("nll").alias("_w"), F.explode("nll").alias("value"))
        counted = places.groupBy("block_id", "_w", "value").agg(F.count(F.lit(1)).alias("n"))
        total = counted.groupBy("block_id").agg((F.sum("n") / F.max("_w")).cast("bigint").alias("num_windows"))
        parts.append(_upper(cut_lineage(counted.drop("_w").join(total, "block_id")), limit))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return with_truth(result, labels)


def with_truth(scores: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Add ``y_true``; blocks without label count as normal."""
    if labels is None:
        return scores.withColumn("y_true", F.lit(0))
    known = labels.select("block_id", F.col("is_anomaly").alias("y_true"))
    return scores.join(known, "block_id", "left").withColumn("y_true", F.coalesce("y_true", F.lit(0)))


def miss_rate(windows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One-step block score of a window table: share of windows whose next event was not among the likeliest."""
    rates = windows.groupBy("block_id").agg(
        F.avg("topk_last").alias("score"), F.count(F.lit(1)).alias("num_windows"), F.sum(F.col("topk_last").cast("bigint")).alias("num_misses")
    )
    return with_truth(rates, labels).select("block_id", "y_true", "score", "num_windows", "num_misses")


def mean_cross_entropy(windows: DataFrame, window: int) -> DataFrame:
    """Mean negative log-likelihood over all window positions of a window table, as a one-row table."""
    n = F.count(F.lit(1)) * window
    return windows.agg((F.sum("nll_sum") / n).alias("loss"), n.cast("bigint").alias("positions"))


def decide(scores: DataFrame, threshold: float | Column) -> DataFrame:
    """Add ``y_pred``: 1 when the score reaches the threshold."""
    bound = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return scores.withColumn("y_pred", (F.col("score") >= bound).cast("int"))
