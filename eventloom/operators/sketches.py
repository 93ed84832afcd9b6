"""Request statistics that are stored by hour and merged to days, profiles or everything, without the requests.

Counts and sums add up, and processing times are kept as KLL sketches: of bounded size, mergeable in any order, with
an error in rank that follows from their size and does not grow by merging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.requests import OK

#: Items of a sketch: ranks within 0.31 % (`rank_error`), some 20 kB once it holds more values than that.
SKETCH_ITEMS = 1500
QUANTILES = {"p50_processing_ms": 0.5, "p95_processing_ms": 0.95, "p99_processing_ms": 0.99}
_SUMS = ("total_requests", "successful_requests", "failed_requests", "_time_sum", "_time_n", "_lines_sum", "_lines_n")


def rank_error(items: int = SKETCH_ITEMS) -> float:
    """How far the rank of a sketched quantile may be from the one asked for, as a share of all values, in 99 % of cases.

    The constants are the published ones of the sketch.
    """
    return 2.296 / items**0.9021


def history_sketches(history: DataFrame, by: list[str] | None = None, width: str = "hour", items: int = SKETCH_ITEMS) -> DataFrame:
    """Partial statistics of requests per ``by`` and ``width`` of ``created_at`` (column ``started``), to be stored.

    Null times and line counts are ignored as in ``request_stats``; requests without ``created_at`` have a null
    ``started``. Partial aggregates run before the shuffle, so a key that holds most rows is one sketch per task there.
    """
    time = F.col("processing_ms").cast("double")
    return history.groupBy(*(by or []), F.date_trunc(width, "created_at").alias("started")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count(F.when(F.col("status_code") == OK, F.lit(1))).alias("successful_requests"),
        F.count(F.when(F.col("status_code") != OK, F.lit(1))).alias("failed_requests"),
        F.sum(time).alias("_time_sum"),
        F.count(time).alias("_time_n"),
        F.sum(F.col("num_log_lines").cast("bigint")).alias("_lines_sum"),
        F.count("num_log_lines").alias("_lines_n"),
        F.min("num_log_lines").alias("min_num_log_lines"),
        F.max("num_log_lines").alias("max_num_log_lines"),
        F.kll_sketch_agg_double(time, F.lit(items)).alias("_times"),
    )


def merge_sketches(parts: DataFrame, by: list[str | Column] | None = None) -> DataFrame:
    """Partial statistics merged per ``by``; the result can be stored and merged again.

    Parts must come from sketches of one size, or the error is that of the smallest. Without parts there is no row.
    """
    merged = parts.groupBy(*(by or [])).agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.min("min_num_log_lines").alias("min_num_log_lines"),
        F.max("max_num_log_lines").alias("max_num_log_lines"),
        F.kll_merge_agg_double("_times").alias("_times"),
    )
    return merged.where(F.col("total_requests") > 0)


def sketched_stats(merged: DataFrame) -> DataFrame:
    """The columns of ``request_stats``, with quantiles from the sketches; null where no request has a time."""
    known = F.col("_time_n") > 0
    quantiles = {n: F.when(known, F.kll_sketch_get_quantile_double("_times", F.lit(q))) for n, q in QUANTILES.items()}
    means = {
        "mean_processing_ms": F.when(known, F.col("_time_sum") / F.col("_time_n")),
        "mean_num_log_lines": F.when(F.col("_lines_n") > 0, F.col("_lines_sum") / F.col("_lines_n")),
    }
    return merged.withColumns(means | quantiles).drop("_times", "_time_sum", "_time_n", "_lines_sum", "_lines_n")
