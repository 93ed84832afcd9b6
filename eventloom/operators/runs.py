"""Comparison of training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.ordered import GROUP_ROWS, running


def union_runs(tables: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """Stack tables with a tag column; columns missing in some become null."""
    stacked = None
    for name, table in tables.items():
        tagged = table.withColumn(tag, F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged, allowMissingColumns=True)
    if stacked is None:
        raise ValueError("no tables to stack")
    return stacked


def metrics_pivot(metrics: DataFrame, run: str = "run_name") -> DataFrame:
    """One row per run with F1, AP and FPR of both splits and the F1 gap."""
    wanted = [F.first(m, ignorenulls=True).alias(m) for m in ("f1", "average_precision", "fpr")]
    wide = metrics.groupBy(run).pivot("split", ["val", "test"]).agg(*wanted)
    return wide.withColumn("f1_gap", F.col("val_f1") - F.col("test_f1"))


def rank_runs(metrics: DataFrame) -> DataFrame:
    """Ranks by F1 and AP (high is good) and FPR (low is good); ties share the best rank. One row per run."""
    return metrics.withColumns(
        {
            "rank_by_f1": F.rank().over(Window.orderBy(F.desc("f1"))),
            "rank_by_ap": F.rank().over(Window.orderBy(F.desc("average_precision"))),
            "rank_by_fpr": F.rank().over(Window.orderBy(F.asc("fpr"))),
        }
    )


def order_by_rank(df: DataFrame, ranked: DataFrame, run: str = "run_name") -> DataFrame:
    """Rows in the order of their run's F1 rank."""
    return df.join(ranked.select(run, "rank_by_f1"), run).orderBy("rank_by_f1", run)


def best_epochs(history: DataFrame, patience: int | None = None, min_delta: float = 0.0, limit: int = GROUP_ROWS) -> DataFrame:
    """Best epoch of each run under early stopping: (run_name, best_epoch, best_val_loss, epochs_ran).

    An epoch improves when its loss is below the best so far by more than ``min_delta``; training ends
    after ``patience`` epochs in a row without improvement. Without ``min_delta`` the best so far is a
    running minimum and any number of epochs is fine; otherwise the epochs that set a new minimum, the only
    ones that can improve, are folded per run.
    """
    upto = running(history, ["run_name"], ["epoch"], {"_low": ("min", F.col("val_loss"))}, limit=limit)
    # a row is a new minimum when the running minimum before it was higher
    falls = upto.groupBy("run_name", F.col("_low")).agg(F.min("epoch").alias("epoch"))
    if min_delta == 0.0:
        improving = falls.select("run_name", "epoch", F.col("_low").alias("val_loss"))
    else:
        points = F.array_sort(F.collect_list(F.struct("epoch", F.col("_low").alias("val_loss"))))
        empty = F.array().cast("array<struct<epoch:int,val_loss:double>>")

        def step(kept, x):
            better = (F.size(kept) == 0) | (x["val_loss"] < F.try_element_at(kept, F.lit(-1))["val_loss"] - min_delta)
            item = F.array(F.struct(x["epoch"].cast("int").alias("epoch"), x["val_loss"].alias("val_loss")))
            return F.when(better, F.concat(kept, item)).otherwise(kept)

        kept = falls.groupBy("run_name").agg(F.aggregate(points, empty, step).alias("_k"))
        improving = kept.select("run_name", F.explode("_k").alias("k")).select("run_name", "k.*")
    ends = history.groupBy("run_name").agg(F.max("epoch").alias("_last"))
    by_epoch = Window.partitionBy("run_name").orderBy("epoch")
    gaps = improving.join(ends, "run_name").withColumn(
        "_next", F.coalesce(F.lead("epoch").over(by_epoch), F.col("_last") + 1)
    )
    if patience is None:
        stop = gaps.groupBy("run_name").agg(F.max("_last").alias("epochs_ran"))
    else:
        stalled = F.min(F.when(F.col("_next") - F.col("epoch") > patience, F.col("epoch") + patience))
        stop = gaps.groupBy("run_name").agg(F.least(F.coalesce(stalled, F.max("_last")), F.max("_last")).alias("epochs_ran"))
    reached = improving.join(stop, "run_name").filter(F.col("epoch") <= F.col("epochs_ran"))
    best = F.max_by(F.struct("epoch", "val_loss"), F.col("epoch"))
    return reached.groupBy("run_name").agg(best.alias("_b"), F.first("epochs_ran").alias("epochs_ran")).select(
        "run_name", F.col("_b.epoch").alias("best_epoch"), F.col("_b.val_loss").alias("best_val_loss"), "epochs_ran"
    )
