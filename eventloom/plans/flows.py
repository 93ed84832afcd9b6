"""The end-to-end jobs: raw lines to a window data set, events to evaluated scores, lines to a scorer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.checks import STRATEGIES, check_strategies
from eventloom.operators import evaluation, nextevent, scoring, splits, templates, windows
from eventloom.operators.logs import parse_lines, route_lines, usable_lines
from eventloom.operators.requests import Scorer
from eventloom.session import cut_lineage
from eventloom.sources.logs import LINE_ORDER


@dataclass(frozen=True)
class EventTable:
    """Matched events (block_id, ts, line_key, event, split) with the templates of the training lines."""

    templates: DataFrame
    events: DataFrame
    vocab_size: int

    @property
    def unknown_id(self) -> int:
        return self.vocab_size - 1


def worded_lines(lines: DataFrame, split: DataFrame, line_key: str | None = None, max_lines: int | None = None) -> DataFrame:
    """Parsed and masked lines of the blocks in ``split``, written once for the passes that follow.

    A line belongs to the split of the first block id in the whole line, its event to the block named in its content.
    ``max_lines`` takes the first lines of the files only.
    Unless a column is named, lines are in the order of file, split and row: the number of a row alone follows the
    way splits are packed, not the files.
    """
    place = F.col(line_key) if line_key else F.struct(*LINE_ORDER)
    parsed = usable_lines(parse_lines(route_lines(lines, split, max_lines)))
    worded = parsed.select(
        "block_id",
        "split",
        F.col("timestamp").alias("ts"),
        place.alias("line_key"),
        templates.masked_tokens(F.col("content")).alias("tokens"),
    )
    return cut_lineage(worded)


def event_table(
    lines: DataFrame, split: DataFrame, line_key: str | None = None, max_lines: int | None = None
) -> EventTable:
    """Mine templates on training lines only, freeze them, and match the lines of all splits."""
    worded = worded_lines(lines, split, line_key, max_lines)
    train = worded.filter(F.col("split") == "train")
    mined = cut_lineage(templates.mine_templates(train, words="tokens", order=("ts", "line_key")))
    vocab_size = mined.count() + 1
    matched = templates.match_templates(worded, mined)
    events = matched.select(
        "block_id", "ts", "line_key", F.coalesce("cluster_id", F.lit(vocab_size - 1)).alias("event"), "split"
    )
    return EventTable(mined, cut_lineage(events), vocab_size)


def window_dataset(
    table: EventTable, labels: DataFrame, split: DataFrame, window: int = 10, stride: int = 1, mode: str = "many_to_many"
) -> tuple[DataFrame, DataFrame]:
    """(windows with split and label, one-row description)."""
    tagged = windows.make_windows(table.events, window, stride, mode, labels=labels, split=split)
    return tagged, splits.dataset_meta(tagged, split, table.vocab_size, mode, window, stride)


def fit_scorer(lines: DataFrame, split: DataFrame, threshold: float, window: int = 10, **settings) -> Scorer:
    """Templates and model from the training lines, with a decision threshold."""
    table = event_table(lines, split.filter(F.col("split") == "train"))
    fitted = nextevent.fit_next_event(table.events, table.vocab_size)
    model = replace(fitted, table=cut_lineage(fitted.table))
    return Scorer(table.templates, model, threshold, window, **settings)


def score_and_evaluate(
    events: DataFrame,
    labels: DataFrame,
    split: DataFrame,
    vocab_size: int,
    window: int = 10,
    order: int = 1,
    strategies: Sequence[str] = STRATEGIES,
    model_name: str = "context",
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scores, thresholds, metrics, unscored blocks).

    Fits on training blocks, scores validation and test, takes the threshold from validation. Blocks too
    short for a window have no score; they are returned beside the metrics.
    """
    strategies = check_strategies(strategies)
    model = nextevent.fit_next_event(splits.only_split(events, split, "train"), vocab_size, order)
    model = replace(model, table=cut_lineage(model.table))
    held_out = split.filter(F.col("split") != "train")
    judged = events.join(held_out.select("block_id"), "block_id", "left_semi")
    blocks = scoring.score_events(judged, model, window, 1, labels, strategies)
    scores = cut_lineage(splits.tag_split(blocks, held_out).withColumn("model", F.lit(model_name)))
    thresholds, metrics = evaluation.evaluate(scores, ["model", "strategy"])
    lengths = judged.groupBy("block_id").agg(F.count(F.lit(1)).alias("sequence_len"))
    unscored = splits.tag_split(windows.coverage(lengths, scores), held_out)
    return scores, thresholds, metrics, unscored
