"""Thresholds, metrics and error analysis of block scores.

Functions take ``by``: the columns (model, strategy, split ...) that separate independent evaluations.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.ordered import (
    GROUP_ROWS,
    _null_safe_join,
    broadcast_if_small,
    describe,
    quantiles,
    running,
)

# Quantile grid and category order of the reports.
SCORE_QUANTILES = {
    "q000": 0.0,
    "q025": 0.25,
    "q050": 0.5,
    "q075": 0.75,
    "q090": 0.9,
    "q095": 0.95,
    "q099": 0.99,
    "q100": 1.0,
}
ERROR_ORDER = ("TN", "FP", "FN", "TP")
TOP_ERRORS = 15
COMPARED = ("f1", "precision", "recall", "fpr", "average_precision")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 when the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / F.nullif(denominator, F.lit(0)))


def curve(scores: DataFrame, by: Sequence[str] = (), limit: int = GROUP_ROWS) -> DataFrame:
    """One row per distinct score as threshold, with counts and rates of "score >= threshold".

    Rows are first counted by distinct score; the running totals then need only those.
    """
    by = list(by)
    points = scores.groupBy(*by, "score").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("y_true").cast("bigint")).alias("_pos")
    )
    cumulated = running(
        points, by, [F.desc("score")], {"predicted": ("sum", F.col("_n")), "tp": ("sum", F.col("_pos"))}, totals=True, limit=limit
    )
    positives, everything = F.col("tp_total"), F.col("predicted_total")
    fp = F.col("predicted") - F.col("tp")
    return cumulated.select(
        *by,
        F.col("score").alias("threshold"),
        "tp",
        fp.alias("fp"),
        (positives - F.col("tp")).alias("fn"),
        (everything - positives - fp).alias("tn"),
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        F.when(positives == 0, 1.0).otherwise(ratio(F.col("tp"), positives)).alias("pr_recall"),
        ratio(F.col("tp"), positives).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + positives).alias("f1"),
        ratio(fp, everything - positives).alias("fpr"),
        ratio(F.col("_pos"), positives).alias("recall_step"),
    )


def pr_curve(curve_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall per threshold."""
    return curve_rows.select(*by, "threshold", "precision", F.col("pr_recall").alias("recall"))


def threshold_sweep(curve_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve_rows.select(*by, "threshold", "precision", "recall", "f1", "fpr")


def average_precision(curve_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of recall steps times precision; null without scores."""
    return curve_rows.groupBy(*by).agg(F.sum(F.col("recall_step") * F.col("precision")).alias("average_precision"))


def best_threshold(curve_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest F1, the highest one on ties; (inf, 0) without scores when ungrouped."""
    best = F.max(F.struct("f1", "threshold"))
    chosen = curve_rows.groupBy(*by).agg(best.alias("_b"))
    return chosen.select(
        *by,
        F.coalesce(F.col("_b.threshold").cast("double"), F.lit(float("inf"))).alias("threshold"),
        F.coalesce("_b.f1", F.lit(0.0)).alias("best_f1"),
    )


def best_row(curve_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sweep row with the largest F1, the lowest threshold on ties."""
    kept = [c for c in ("threshold", "precision", "recall", "f1", "fpr")]
    picked = F.max_by(F.struct(*kept), F.struct(F.col("f1"), -F.col("threshold")))
    return curve_rows.groupBy(*by).agg(picked.alias("_b")).select(*by, "_b.*")


def confusion(predicted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp; all four also when a class is absent."""

    def count(truth: int, guess: int) -> Column:
        return F.count(F.when((F.col("y_true") == truth) & (F.col("y_pred") == guess), F.lit(1)))

    return predicted.groupBy(*by).agg(
        count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(1, 1).alias("tp")
    )


def rates(counts: DataFrame) -> DataFrame:
    """Add precision, recall, f1 and fpr to confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "fpr": ratio(fp, fp + tn),
        }
    )


def summarise(
    predicted: DataFrame, curve_rows: DataFrame | None, by: Sequence[str] = (), model: str | None = None
) -> DataFrame:
    """Full metrics row: rates, confusion counts and average precision (null without scores)."""
    by = list(by)
    table = rates(confusion(predicted, by))
    if curve_rows is None:
        table = table.withColumn("average_precision", F.lit(None).cast("double"))
    else:
        ap = average_precision(curve_rows, by)
        if by:
            table = _null_safe_join(table, ap, by)
        else:
            # one row, or none without scores
            table = table.join(F.broadcast(ap), F.lit(True), "left")
    return table if model is None else table.withColumn("model", F.lit(model))


def evaluate(
    scores: DataFrame, by: Sequence[str] = ("model", "strategy"), limit: int = GROUP_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(thresholds, metrics): thresholds chosen on ``val`` rows and applied to all splits.

    ``scores`` has a ``split`` column and should be a stored table, since it is read several times.
    """
    by = list(by)
    curves = curve(scores, [*by, "split"], limit)
    chosen = best_threshold(curves.filter(F.col("split") == "val"), by)
    thresholds = chosen.select(
        *by,
        F.lit("max_f1").alias("threshold_strategy"),
        "threshold",
        F.col("best_f1").alias("validation_best_f1"),
    )
    cut = broadcast_if_small(chosen.select(*by, "threshold"))
    applied = scores.join(cut, by)
    predicted = applied.withColumn("y_pred", (F.col("score") >= F.col("threshold")).cast("int"))
    metrics = summarise(predicted, curves, [*by, "split"])
    metrics = metrics.join(cut, by)
    return thresholds, metrics


def with_error_type(predicted: DataFrame) -> DataFrame:
    truth, guess = F.col("y_true"), F.col("y_pred")
    kind = (
        F.when((truth == 0) & (guess == 1), "FP")
        .when((truth == 1) & (guess == 0), "FN")
        .when((truth == 1) & (guess == 1), "TP")
        .when((truth == 0) & (guess == 0), "TN")
        .otherwise("unknown")
    )
    return predicted.withColumn("error_type", kind)


def _every_error_type(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All four error types in report order, joined to what ``df`` has for them (in each group ``by``)."""
    order = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(e).alias("error_type")) for i, e in enumerate(ERROR_ORDER)])
    if by:
        kinds = df.select(*by).distinct().select(*by, F.explode(order).alias("k")).select(*by, "k.*")
    else:
        kinds = df.sparkSession.range(1).select(F.explode(order).alias("k")).select("k.*")
    return kinds.join(df, [*by, "error_type"], "left")


def error_counts(typed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = typed.groupBy(*by, "error_type").agg(F.count(F.lit(1)).alias("blocks"))
    return _every_error_type(counts, by).select(*by, "place", "error_type", F.coalesce("blocks", F.lit(0)).alias("blocks"))


def error_summary(typed: DataFrame, limit: int = GROUP_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Blocks, mean and median score, median and p95 of window counts per error type (in each group ``by``)."""
    key = [*by, "error_type"]
    means = typed.groupBy(*key).agg(F.count(F.lit(1)).alias("blocks"), F.avg("score").alias("score_mean"))
    score = quantiles(typed, key, "score", {"score_median": 0.5}, limit)
    sizes = quantiles(typed, key, "num_windows", {"windows_median": 0.5, "windows_p95": 0.95}, limit)
    joined = means.join(score, key, "left").join(sizes, key, "left")
    return _every_error_type(joined, by).select(
        *by, "place", "error_type", F.coalesce("blocks", F.lit(0)).alias("blocks"), "score_mean", "score_median", "windows_median", "windows_p95"
    )


def _first(df: DataFrame, order: Sequence[Column], n: int, by: Sequence[str]) -> DataFrame:
    if not by:
        return df.orderBy(*order).limit(n)
    # the rank limit is applied before rows move
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def top_false_positives(typed: DataFrame, n: int = TOP_ERRORS, by: Sequence[str] = ()) -> DataFrame:
    wrong = typed.filter(F.col("error_type") == "FP")
    return _first(wrong, [F.desc("score"), F.desc("num_windows"), F.asc("block_id")], n, by)


def top_false_negatives(typed: DataFrame, n: int = TOP_ERRORS, by: Sequence[str] = ()) -> DataFrame:
    wrong = typed.filter(F.col("error_type") == "FN")
    return _first(wrong, [F.asc("score"), F.desc("num_windows"), F.asc("block_id")], n, by)



def score_quantiles(
    scores: DataFrame, by: Sequence[str] = ("y_true",), grid: Mapping[str, float] = SCORE_QUANTILES, limit: int = GROUP_ROWS
) -> DataFrame:
    return quantiles(scores, list(by), "score", grid, limit)


def score_quantiles_pivoted(scores: DataFrame, grid: Mapping[str, float] = SCORE_QUANTILES, limit: int = GROUP_ROWS) -> DataFrame:
    """(quantile, normal, anomaly)."""
    wide = score_quantiles(scores, ["y_true"], grid, limit)
    long = wide.unpivot(["y_true"], list(grid), "quantile", "score")
    pivoted = long.groupBy("quantile").pivot("y_true", [0, 1]).agg(F.first("score"))
    return pivoted.withColumnsRenamed({"0": "normal", "1": "anomaly"})


def score_quantiles_approx(scores: DataFrame, by: Sequence[str] = ("y_true",), accuracy: int = 10_000) -> DataFrame:
    """The same grid from mergeable sketches, for when exact values are not needed."""
    probabilities = F.array(*[F.lit(p) for p in SCORE_QUANTILES.values()])
    sketched = scores.groupBy(*by).agg(F.percentile_approx("score", probabilities, accuracy).alias("_q"))
    return sketched.select(*by, *[F.element_at("_q", i + 1).alias(n) for i, n in enumerate(SCORE_QUANTILES)])


def histogram(
    df: DataFrame, value: str, by: Sequence[str], bins: int = 50, clip: float | None = None, limit: int = GROUP_ROWS
) -> DataFrame:
    """Equal-width bins over all groups: (by, bin, low, high, n, density).

    ``clip`` cuts values at that quantile first. The last bin includes its upper edge.
    """
    rows = df.filter(F.col(value).isNotNull()).withColumn("_one", F.lit(1))
    bounds = rows.groupBy("_one").agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    if clip is not None:
        cut = quantiles(rows, ["_one"], value, {"_hi": clip}, limit)
        bounds = bounds.drop("_hi").join(cut, "_one")
    placed = rows.join(F.broadcast(bounds), "_one")
    width = (F.col("_hi") - F.col("_lo")) / bins
    clipped = F.least(F.col(value).cast("double"), F.col("_hi"))
    number = F.when(width > 0, F.least(F.floor((clipped - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counted = placed.withColumn("bin", number.cast("int")).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    whole = F.sum("n").over(Window.partitionBy(*by))
    return counted.select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("low"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"),
        "n",
        F.when(width > 0, F.col("n") / (whole * width)).alias("density"),
    )


def box_numbers(df: DataFrame, value: str, by: Sequence[str], limit: int = GROUP_ROWS) -> DataFrame:
    """Quartiles, whisker ends (last values within 1.5 quartile ranges) and number of outliers per group."""
    by = list(by)
    quarters = describe(df, by, value, limit).select(*by, "p25", "p50", "p75")
    joined = df.filter(F.col(value).isNotNull()).join(broadcast_if_small(quarters), by)
    reach = 1.5 * (F.col("p75") - F.col("p25"))
    inside = (F.col(value) >= F.col("p25") - reach) & (F.col(value) <= F.col("p75") + reach)
    return joined.groupBy(*by, "p25", "p50", "p75").agg(
        F.min(F.when(inside, F.col(value))).cast("double").alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).cast("double").alias("whisker_high"),
        F.count(F.when(~inside, F.lit(1))).alias("outliers"),
    )


def compare_splits(metrics: DataFrame, key: str = "model") -> DataFrame:
    """Validation and test metrics side by side with their differences."""
    val = metrics.filter(F.col("split") == "val").select(key, *[F.col(m).alias(f"{m}_val") for m in COMPARED])
    test = metrics.filter(F.col("split") == "test").select(key, *[F.col(m).alias(f"{m}_test") for m in COMPARED])
    both = val.join(test, key)
    return both.withColumns({f"{m}_diff_test_minus_val": F.col(f"{m}_test") - F.col(f"{m}_val") for m in COMPARED})
