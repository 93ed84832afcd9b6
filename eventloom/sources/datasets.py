"""Readers and writers of the tables that one stage leaves for the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.functions.checks import check_windows, require_columns, require_rows
from eventloom.functions.text import run_name_parts


def save_windows(windows: DataFrame, path: str) -> None:
    """Window table, one folder per split."""
    require_columns(windows, ["block_id", "split", "window", "target", "is_anomaly"])
    windows.write.mode("overwrite").partitionBy("split").parquet(path)


def load_windows(spark: SparkSession, path: str, size: int, mode: str) -> DataFrame:
    target = "INT" if mode == "one_step" else "ARRAY<INT>"
    schema = f"block_id STRING, start BIGINT, window ARRAY<INT>, target {target}, is_anomaly INT, split STRING"
    return check_windows(spark.read.schema(schema).parquet(path), size, mode)


def save_meta(meta: DataFrame, path: str) -> None:
    """One-row data set description as JSON."""
    meta.coalesce(1).write.mode("overwrite").json(path)


def load_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DATASET_META).json(path)


def save_scores(scores: DataFrame, path: str, by: Sequence[str] = ("split", "strategy")) -> None:
    """Block scores, one folder per split and strategy (or model); other folders are left alone."""
    require_columns(scores, ["block_id", "y_true", "score", *by])
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def load_scores(spark: SparkSession, path: str, split: str, strategy: str, by: str = "strategy") -> DataFrame:
    """Scores of one split and strategy, read by partition pruning; an error when there are none."""
    try:
        scores = spark.read.parquet(path)
    except AnalysisException as error:
        raise ValueError(f"no scores at {path}") from error
    chosen = scores.filter((F.col("split") == split) & (F.col(by) == strategy))
    return require_rows(chosen, f"no {strategy} scores for the {split} split")


def save_table(table: DataFrame, path: str, by: str | None = None, fmt: str = "parquet") -> None:
    """Thresholds or metrics, optionally one folder per model."""
    writer = table.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(by) if by else writer).save(path)


def load_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt).schema(schema)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def threshold_of(thresholds: DataFrame, strategy: str, model: str | None = None) -> DataFrame:
    """The one threshold chosen for a strategy (and model); an error when there is none or more than one."""
    chosen = thresholds.filter(F.col("strategy") == strategy)
    if model is not None:
        chosen = chosen.filter(F.col("model") == model)
    found = chosen.select("threshold").limit(2).count()
    if found > 1:
        raise ValueError(f"several thresholds for {strategy}: name the model")
    return require_rows(chosen.select("threshold"), f"no threshold for {strategy}")


def save_importance(importance: DataFrame, path: str) -> None:
    importance.write.mode("overwrite").parquet(path)


def read_runs(spark: SparkSession, root: str, metrics_file: str, history_file: str) -> tuple[DataFrame, DataFrame]:
    """Metrics and training histories of all runs below ``root``, tagged with the run name.

    Expects ``<root>/<run>/tables/<file>``; ``metrics_file`` may be a glob with one match per split.
    """
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/tables/[^/]+$", 1)
    split = F.regexp_extract(F.col("_metadata.file_name"), r"(validation|test)_metrics", 1)
    base = root.rstrip("/")
    metrics = (
        spark.read.schema(schemas.METRICS)
        .csv(f"{base}/*/tables/{metrics_file}", header=True)
        .select("*", run.alias("run_name"), split.alias("split"))
    )
    metrics = metrics.select("*", run_name_parts(F.col("run_name")).alias("_p")).select("*", "_p.*").drop("_p")
    history = (
        spark.read.schema(schemas.RUN_HISTORY)
        .json(f"{base}/*/tables/{history_file}", multiLine=True)
        .select("*", run.alias("run_name"))
    )
    return metrics, history


def history_rows(history: DataFrame) -> DataFrame:
    """One row per epoch of each run."""
    zipped = F.explode(F.arrays_zip("epoch", "train_loss", "val_loss", "is_best"))
    return history.select("run_name", zipped.alias("e")).select("run_name", "e.*")
