"""Block scores that grow: what earlier events have given is stored per block, and only new events are scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.nextevent import NextEventModel, event_surprise
from eventloom.operators.ordered import GROUP_ROWS, _null_safe_join, positions
from eventloom.operators.sequences import ORDER
from eventloom.operators.sketches import SKETCH_ITEMS

_SUMS = ("events", "scored", "nll_sum", "miss_sum")
_TAIL = "array<struct<ts:timestamp,line_key:bigint,event:int>>"


def _last(tail: Column, n: int) -> Column:
    return F.slice(tail, F.greatest(F.size(tail) - n + 1, F.lit(1)), n)


def _tails(rows: DataFrame, order: int, limit: int) -> DataFrame:
    """(block_id, tail): the last ``order`` events of each block, in order."""
    placed = positions(rows, ["block_id"], [F.desc("ts"), F.desc("line_key")], name="_back", limit=limit)
    item = F.struct("ts", "line_key", F.col("event").cast("int").alias("event"))
    # at most ``order`` rows of a block meet
    return placed.where(F.col("_back") < order).groupBy("block_id").agg(F.array_sort(F.collect_list(item)).alias("tail"))


def block_state(events: DataFrame, model: NextEventModel, before: DataFrame | None = None, top_k: int = 3, limit: int = GROUP_ROWS) -> DataFrame:
    """What new events add to their blocks: counts, sums, maximum and sketch of the surprise, and the newest events.

    An event is judged after the ``order`` events before it, which for the first new ones are the ``tail`` of the
    state ``before``; a block's first ``order`` events are not judged. New events must follow the stored ones of
    their block. The result holds the blocks of ``events`` only; ``merge_states`` adds it to what is stored. Any
    number of events in a block is fine. Other columns are ignored, and no events give no rows.
    """
    new = events.select("block_id", F.col("ts").cast("timestamp").alias("ts"), F.col("line_key").cast("bigint").alias("line_key"), "event")
    counted = new.groupBy("block_id").agg(F.count(F.lit(1)).alias("events"))
    whole = new
    if before is not None:
        asked = before.select("block_id", "tail").join(counted.select("block_id"), "block_id", "left_semi")
        whole = asked.select("block_id", F.explode("tail").alias("t")).select("block_id", *[F.col(f"t.{c}").alias(c) for c in (*ORDER, "event")]).unionByName(new)
    judged = event_surprise(whole, model, top_k, limit).select(
        "block_id", F.element_at("nll", model.order).alias("nll"), F.element_at("miss", model.order).alias("miss")
    )
    found = judged.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("scored"),
        F.sum("nll").alias("nll_sum"),
        F.sum("miss").alias("miss_sum"),
        F.max("nll").alias("nll_max"),
        F.kll_sketch_agg_double("nll", F.lit(SKETCH_ITEMS)).alias("nll_sketch"),
    )
    state = _null_safe_join(_null_safe_join(counted, found, ["block_id"]), _tails(whole, model.order, limit), ["block_id"])
    return state.na.fill(0, ["scored", "miss_sum"]).na.fill(0.0, ["nll_sum"])


def merge_states(before: DataFrame, after: DataFrame, order: int) -> DataFrame:
    """Stored states with those of later events: one row for each block of either."""
    newest = F.array_sort(F.array_distinct(F.flatten(F.collect_list("tail")))).cast(_TAIL)
    return (
        before.unionByName(after)
        .groupBy("block_id")
        .agg(
            *[F.sum(c).alias(c) for c in _SUMS],
            F.max("nll_max").alias("nll_max"),
            F.kll_merge_agg_double("nll_sketch").alias("nll_sketch"),
            newest.alias("tail"),
        )
        .withColumn("tail", _last(F.col("tail"), order))
    )


def scores_of_states(states: DataFrame, window: int) -> DataFrame:
    """(block_id, events, nll_max, nll_mean, nll_p95, topk_all) of blocks with more than ``window`` events, null for others.

    With a first-order model ``nll_max`` equals the batch score of the same name; ``nll_p95`` comes from the sketch.
    """
    enough = (F.col("events") > window) & (F.col("scored") > 0)
    return states.select(
        "block_id",
        "events",
        F.when(enough, F.col("nll_max")).alias("nll_max"),
        F.when(enough, F.col("nll_sum") / F.col("scored")).alias("nll_mean"),
        F.when(enough, F.kll_sketch_get_quantile_double("nll_sketch", F.lit(0.95))).alias("nll_p95"),
        F.when(enough, F.col("miss_sum") / F.col("scored")).alias("topk_all"),
    )
