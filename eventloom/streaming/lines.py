"""Streaming scan, parse and lateness."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from eventloom.functions.text import drop_undecodable
from eventloom.operators.logs import parse_lines, usable_lines


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of text files as they arrive in a folder."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(
        drop_undecodable(F.col("value")).alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
    )


def stream_parsed(lines: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Parsed, usable lines with a watermark; the columns are those of the batch parse."""
    return usable_lines(parse_lines(lines)).withWatermark("timestamp", late)


def with_watermark(events: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    """Event time for any input; timestamps without zone are taken as session time."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks drop, from every progress report of the queries that run while it is added.

        counter = LateRows()
        spark.streams.addListener(counter)
        ...
        counter.dropped[str(query.id)]

    A query itself keeps its last hundred reports only.
    """

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        late = sum(int(operator.numRowsDroppedByWatermark) for operator in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] += late

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
