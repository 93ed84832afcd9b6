"""Fixed-size sliding windows with one-step or many-to-many targets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.checks import check_target_mode, check_window
from eventloom.operators.ordered import CHUNK_EVENTS, GROUP_ROWS, positions, spread_chunks
from eventloom.operators.sequences import ORDER
from eventloom.operators.splits import tag_split


def chunk_arrays(numbered: DataFrame, columns: Sequence[str], ahead: int, size: int = CHUNK_EVENTS) -> DataFrame:
    """(block_id, chunk, base, items): the ordered rows of each chunk with ``ahead`` rows of look-ahead."""
    spread = spread_chunks(numbered.select("block_id", "pos", *columns), size, ahead)
    items = F.array_sort(F.collect_list(F.struct("pos", *columns)))
    return spread.groupBy("block_id", "chunk").agg(items.alias("items")).withColumn("base", F.col("chunk") * size)


def window_starts(stride: int, span: int, size: int = CHUNK_EVENTS) -> Column:
    """Starts (block positions) owned by a chunk at which ``span`` items are available, as an array."""
    last = F.least(F.col("base") + size - 1, F.col("base") + F.size("items") - span)
    first = F.ceil(F.col("base") / stride) * stride
    return F.when(last >= first, F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(stride).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )


def make_windows(
    events: DataFrame,
    window: int,
    stride: int = 1,
    mode: str = "many_to_many",
    order: Sequence[str] = ORDER,
    size: int = CHUNK_EVENTS,
    limit: int = GROUP_ROWS,
    labels: DataFrame | None = None,
    split: DataFrame | None = None,
) -> DataFrame:
    """(block_id, start, window, target) for every start; blocks of at most ``window`` events give none.

    With ``labels`` there is ``is_anomaly`` too, with ``split`` the split, and blocks without one are dropped. Both are
    joined to the chunks before windows are cut, so that no window is shuffled.
    """
    check_target_mode(mode)
    check_window(window, stride)
    numbered = positions(events.select("block_id", "event", *order), ["block_id"], order, limit=limit)
    chunks = chunk_arrays(numbered, ["event"], window, size)
    chunks = chunks.withColumn("items", F.transform("items", lambda x: x["event"]))
    if labels is not None:
        chunks = label_windows(chunks, labels)
    if split is not None:
        chunks = tag_split(chunks, split)

    def cut(start: Column) -> Column:
        at = (start - F.col("base") + 1).cast("int")
        target = F.element_at("items", at + window) if mode == "one_step" else F.slice("items", at + 1, window)
        return F.struct(start.alias("start"), F.slice("items", at, window).alias("window"), target.alias("target"))

    return cut_windows(chunks, window_starts(stride, window + 1, size), cut)


def cut_windows(chunks: DataFrame, starts: Column, cut: Callable[[Column], Column]) -> DataFrame:
    """One row per start. Windows are cut inside the chunk row, so exploding never copies whole chunks."""
    kept = [c for c in ("is_anomaly", "split") if c in chunks.columns]
    return chunks.select("block_id", *kept, F.explode(F.transform(starts, cut)).alias("_w")).select("block_id", "_w.*", *kept)


def windows_of_sequences(
    sequences: DataFrame, window: int, stride: int = 1, mode: str = "many_to_many", size: int = CHUNK_EVENTS
) -> DataFrame:
    """The same windows from a sequence table that was built in chunks of ``size`` events.

    A chunk borrows the first ``window`` events of the next one, so windows that cross a border are cut too.
    """
    check_target_mode(mode)
    check_window(window, stride)
    if window > size:
        raise ValueError(f"a window of {window} events spans more than two chunks of {size}")
    ahead = sequences.select("block_id", (F.col("chunk") - 1).alias("chunk"), F.slice("sequence", 1, window).alias("_ahead"))
    joined = sequences.join(ahead, ["block_id", "chunk"], "left")
    items = F.when(F.col("_ahead").isNull(), F.col("sequence")).otherwise(F.concat("sequence", "_ahead"))
    chunks = joined.select("block_id", (F.col("chunk") * size).alias("base"), items.alias("items"))

    def cut(start: Column) -> Column:
        at = (start - F.col("base") + 1).cast("int")
        target = F.element_at("items", at + window) if mode == "one_step" else F.slice("items", at + 1, window)
        return F.struct(start.alias("start"), F.slice("items", at, window).alias("window"), target.alias("target"))

    return cut_windows(chunks, window_starts(stride, window + 1, size), cut)


def label_windows(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``is_anomaly`` of the block to windows or chunks; a block without label counts as normal."""
    joined = windows.join(labels.select("block_id", "is_anomaly"), "block_id", "left")
    return joined.withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(0)))


def vocabulary_size(windows: DataFrame) -> DataFrame:
    """Largest event id in windows and targets, plus one, as a one-row table."""
    is_array = dict(windows.dtypes)["target"].startswith("array")
    target = F.array_max("target") if is_array else F.col("target")
    return windows.agg((F.max(F.greatest(F.array_max("window"), target)) + 1).cast("int").alias("vocab_size"))


def coverage(blocks: DataFrame, scored: DataFrame) -> DataFrame:
    """Blocks of ``blocks`` (with their length) that got no window and so no score."""
    return blocks.join(scored.select("block_id").distinct(), "block_id", "left_anti")
