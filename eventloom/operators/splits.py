"""Block-level splits that keep anomalies out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.checks import check_split_ratios
from eventloom.operators.ordered import hash_rank


def _share(ratio: float, total: Column) -> Column:
    return F.floor(total * F.lit(float(ratio)))


def split_blocks(
    labels: DataFrame,
    train_normal: float = 0.8,
    val_normal: float = 0.1,
    val_anomaly: float = 0.3,
    seed: int = 42,
) -> DataFrame:
    """(block_id, is_anomaly, split): train holds normal blocks only; order within a class is by hash."""
    check_split_ratios(train_normal, val_normal, val_anomaly)
    ranked = hash_rank(labels.select("block_id", "is_anomaly"), ["is_anomaly"], "block_id", seed)
    rank, total = F.col("rank"), F.col("rank_total")
    train_end = _share(train_normal, total)
    normal = F.when(rank < train_end, "train").when(rank < train_end + _share(val_normal, total), "val")
    anomaly = F.when(rank < _share(val_anomaly, total), "val")
    split = F.coalesce(F.when(F.col("is_anomaly") == 0, normal).otherwise(anomaly), F.lit("test"))
    return ranked.select("block_id", "is_anomaly", split.alias("split"))


def _allocate(counts: DataFrame, size: str, ratio: float, out: str) -> DataFrame:
    """Add ``out``: each class's part of ceil(ratio * all), by largest remainder. Few rows."""
    everything = Window.partitionBy()
    total = F.sum(size).over(everything)
    exact = F.col(size) * F.ceil(F.round(total * F.lit(float(ratio)), 9)) / total
    sized = counts.withColumns({"_wanted": F.ceil(F.round(total * F.lit(float(ratio)), 9)), "_exact": exact})
    sized = sized.withColumn("_floor", F.floor("_exact"))
    left_over = F.col("_wanted") - F.sum("_floor").over(everything)
    by_rest = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), "is_anomaly"))
    return sized.withColumn("_rest", left_over).withColumn("_place", by_rest).withColumn(
        out, F.col("_floor") + F.when(F.col("_place") <= F.col("_rest"), 1).otherwise(0)
    ).drop("_wanted", "_exact", "_floor", "_rest", "_place")


def split_stratified(labels: DataFrame, test: float = 0.2, val: float = 0.2, seed: int = 42) -> DataFrame:
    """(block_id, is_anomaly, split) with equal class shares: test from all, validation from the rest."""
    if not (0 < test < 1 and 0 < val < 1):
        raise ValueError("split ratios must lie between 0 and 1")
    ranked = hash_rank(labels.select("block_id", "is_anomaly"), ["is_anomaly"], "block_id", seed)
    counts = labels.groupBy("is_anomaly").agg(F.count(F.lit(1)).alias("n"))
    counts = _allocate(counts, "n", test, "n_test").withColumn("n_rest", F.col("n") - F.col("n_test"))
    counts = _allocate(counts, "n_rest", val, "n_val")
    joined = ranked.join(F.broadcast(counts.select("is_anomaly", "n_test", "n_val")), "is_anomaly")
    split = (
        F.when(F.col("rank") < F.col("n_test"), "test")
        .when(F.col("rank") < F.col("n_test") + F.col("n_val"), "val")
        .otherwise("train")
    )
    return joined.select("block_id", "is_anomaly", split.alias("split"))


def tag_split(df: DataFrame, split: DataFrame) -> DataFrame:
    """Attach the split of each row's block; rows of unlisted blocks are dropped."""
    return df.join(split.select("block_id", "split"), "block_id")


def only_split(df: DataFrame, split: DataFrame, name: str) -> DataFrame:
    return df.join(split.filter(F.col("split") == name).select("block_id"), "block_id", "left_semi")


def dataset_meta(windows: DataFrame, split: DataFrame, vocab_size: int, mode: str, window: int, stride: int) -> DataFrame:
    """One-row description of a window data set."""
    per_window = windows.agg(
        *[F.count(F.when(F.col("split") == s, 1)).alias(f"{s}_windows") for s in ("train", "val", "test")]
    )
    blocks = [F.count(F.when(F.col("split") == s, 1)).alias(f"{s}_blocks") for s in ("train", "val", "test")]
    anomalous = [
        F.count(F.when((F.col("split") == s) & (F.col("is_anomaly") == 1), 1)).alias(f"{s}_anomaly_blocks")
        for s in ("val", "test")
    ]
    per_block = split.agg(*blocks, *anomalous)
    fixed = {
        "target_mode": F.lit(mode),
        "window_size": F.lit(window),
        "stride": F.lit(stride),
        "event_vocab_size": F.lit(vocab_size),
        "unknown_event_id": F.lit(vocab_size - 1),
    }
    # two one-row tables side by side
    both = per_window.crossJoin(F.broadcast(per_block))
    return both.withColumns(fixed)
