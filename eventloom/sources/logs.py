"""Scans of raw log text and of the preprocessed block tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.functions.text import anomaly_flag, drop_undecodable

#: Columns that put lines back into file order.
LINE_ORDER = ("file", "split_start", "row_in_split")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with a key that restores file order; undecodable bytes are left out.

    The key is taken straight at the scan, where rows of a split are still in file order.
    """
    return spark.read.text(path).select(
        drop_undecodable(F.col("value")).alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_in_split"),
    )


def spread(lines: DataFrame) -> DataFrame:
    """Deal rows out to all cores when the scan has fewer splits than there are, as with few gzip files.

    A scan of many splits is returned as it is. Line order is kept by its columns.
    """
    cores = lines.sparkSession.sparkContext.defaultParallelism
    return lines.repartition(cores) if lines.rdd.getNumPartitions() < cores else lines


def read_block_labels(spark: SparkSession, path: str) -> DataFrame:
    """Block labels with ``is_anomaly``."""
    raw = spark.read.schema(schemas.BLOCK_LABEL).csv(path, header=True, enforceSchema=False)
    return raw.select(
        F.col("BlockId").alias("block_id"), F.col("Label").alias("label"), anomaly_flag(F.col("Label")).alias("is_anomaly")
    )


def read_preprocessed(spark: SparkSession, folder: str, events: int = 29) -> dict[str, DataFrame]:
    """The four preprocessed tables: labels, occurrence, traces and templates."""

    def csv(name: str, schema) -> DataFrame:
        return spark.read.schema(schema).csv(f"{folder.rstrip('/')}/{name}", header=True, escape='"')

    # File names of the published data set.
    return {
        "labels": csv("anomaly_label.csv", schemas.BLOCK_LABEL),
        "occurrence": csv("Event_occurrence_matrix.csv", schemas.occurrence_schema(events)),
        "traces": csv("Event_traces.csv", schemas.EVENT_TRACES),
        "templates": csv("HDFS.log_templates.csv", schemas.TEMPLATES),
    }


def block_lines(lines: DataFrame, block_id: str, max_lines: int) -> DataFrame:
    """The first ``max_lines`` lines that mention a block, in file order; an error when there are none."""
    found = (
        lines.filter(F.col("line").contains(block_id)).orderBy(*LINE_ORDER).limit(max_lines)
    )
    if found.isEmpty():
        raise ValueError(f"no log lines mention {block_id}")
    return found
