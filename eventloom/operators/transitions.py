"""Statistics of neighbouring events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.ordered import GROUP_ROWS
from eventloom.operators.sequences import intervals

EPSILON = 1e-12
TOP_TRANSITIONS = 30
MIN_SUPPORT = 100


def transition_pairs(events: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """(block_id, prev, next) for all neighbouring events."""
    return intervals(events, limit=limit).select(
        "block_id", F.col("event").alias("prev"), F.col("next_event").alias("next")
    )


def transition_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("cnt"))


def top_transitions(counts: DataFrame, n: int = TOP_TRANSITIONS) -> DataFrame:
    return counts.orderBy(F.desc("cnt"), "prev", "next").limit(n)


def transition_contrast(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and shares of each transition in both classes and the log ratio of the shares.

    Pairs are counted per block before they meet the labels, and one conditional sum yields both classes.
    """
    per_block = pairs.groupBy("block_id", "prev", "next").agg(F.count(F.lit(1)).alias("c"))
    labelled = per_block.join(labels.select("block_id", "is_anomaly"), "block_id")
    counts = labelled.groupBy("prev", "next").agg(
        F.sum(F.when(F.col("is_anomaly") == 0, F.col("c")).otherwise(0)).alias("cnt_norm"),
        F.sum(F.when(F.col("is_anomaly") == 1, F.col("c")).otherwise(0)).alias("cnt_anom"),
    )
    # at most vocabulary squared rows from here on
    everything = Window.partitionBy()
    total_norm = F.greatest(F.sum("cnt_norm").over(everything), F.lit(1))
    total_anom = F.greatest(F.sum("cnt_anom").over(everything), F.lit(1))
    shares = counts.withColumns(
        {
            "cnt_total": F.col("cnt_norm") + F.col("cnt_anom"),
            "p_norm": F.col("cnt_norm") / total_norm,
            "p_anom": F.col("cnt_anom") / total_anom,
        }
    )
    return shares.withColumn("log_ratio", F.log((F.col("p_anom") + EPSILON) / (F.col("p_norm") + EPSILON)))


def supported(contrast: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    return contrast.filter(F.col("cnt_total") >= min_support)


def skewed_transitions(
    contrast: DataFrame, towards: str, n: int = TOP_TRANSITIONS, min_support: int = MIN_SUPPORT
) -> DataFrame:
    """The transitions that lean most towards ``anomaly`` or ``normal``."""
    if towards not in ("anomaly", "normal"):
        raise ValueError("towards must be anomaly or normal")
    by = F.desc("log_ratio") if towards == "anomaly" else F.asc("log_ratio")
    return supported(contrast, min_support).orderBy(by, "prev", "next").limit(n)


def transition_matrix(contrast: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """P(next | prev) per class and their difference for every pair of the vocabulary (column ``event``).

    The grid comes from exploding the collected vocabulary, which is small by definition.
    """
    grid = vocabulary.agg(F.collect_set("event").alias("_all"))
    grid = grid.select(F.explode("_all").alias("prev"), "_all").select("prev", F.explode("_all").alias("next"))
    cells = grid.join(contrast.select("prev", "next", "cnt_norm", "cnt_anom"), ["prev", "next"], "left").na.fill(0)
    row = Window.partitionBy("prev")

    def share(count: str) -> Column:
        return F.col(count) / (F.sum(count).over(row) + EPSILON)

    return cells.select("prev", "next", share("cnt_norm").alias("p_norm"), share("cnt_anom").alias("p_anom")).withColumn(
        "delta", F.col("p_anom") - F.col("p_norm")
    )


def markov_scores(pairs: DataFrame, train_pairs: DataFrame, vocab_size: int, alpha: float = 1.0) -> DataFrame:
    """Sum and maximum of -log P(next | prev) per block under smoothed transitions of ``train_pairs``."""
    if alpha <= 0:
        raise ValueError("alpha must be positive, or unseen transitions have no probability")
    counts = transition_counts(train_pairs)
    rows = counts.groupBy("prev").agg(F.sum("cnt").alias("total"))
    per_block = pairs.groupBy("block_id", "prev", "next").agg(F.count(F.lit(1)).alias("n"))
    scored = per_block.join(counts, ["prev", "next"], "left").join(rows, "prev", "left")
    nll = -F.log(
        (F.coalesce("cnt", F.lit(0)) + alpha) / (F.coalesce("total", F.lit(0)) + alpha * vocab_size)
    )
    return (
        scored.withColumn("nll", nll)
        .groupBy("block_id")
        .agg(F.sum(F.col("nll") * F.col("n")).alias("nll_sum"), F.max("nll").alias("nll_max"))
    )
