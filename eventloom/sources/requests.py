"""Files of scoring requests, request logs and request history."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.operators.requests import check_requests
from eventloom.session import cut_lineage
from eventloom.sources import versions


def read_requests(spark: SparkSession, path: str, one_per_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid requests, rejected requests) from JSON, stripped; flags default to false.

    ``request_id`` is made of the file and the place in it.
    """
    raw = spark.read.schema(schemas.PREDICT_REQUEST).json(path, multiLine=one_per_file)
    checked = check_requests(
        raw.select(
            F.concat_ws("#", F.col("_metadata.file_name"), F.monotonically_increasing_id().cast("string")).alias("request_id"), "*"
        )
    ).na.fill(False, ["return_event_ids", "return_window_scores"])
    return checked.filter("valid").drop("valid"), checked.filter("not valid").drop("valid")


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of the request log with the declared schema."""
    return spark.read.schema(schemas.REQUEST_LOG).json(path)


def append_outcomes(outcomes: DataFrame, path: str, stream: tuple[str, int] | None = None, check_stored: bool = True) -> int:
    """Add complete request outcomes to the stored history; gives the number of the version that holds them.

    Requests that the same days of the history hold already are not added again (unless ``check_stored`` is off, for
    callers that know them to be new), and of a request that occurs several times in one call one row is added (rows
    without request id are all added), so a job that is run twice stores each request once. A job that breaks off adds
    nothing. ``stream`` names the micro-batch that the rows come from; one that is stored already is left out.
    """
    spark = outcomes.sparkSession
    dated = outcomes.withColumn("day", F.to_date("created_at"))
    named = "request_id" in dated.columns
    if named:
        once = dated.where(F.col("request_id").isNotNull()).dropDuplicates(["request_id", "day"])
        dated = once.unionByName(dated.where(F.col("request_id").isNull()))
    # read for its days and for its rows; one row for each day comes to the driver
    dated = cut_lineage(dated)
    days = {versions.NO_DAY if r["day"] is None else str(r["day"]) for r in dated.select("day").distinct().collect()}

    def change(base: versions.Version) -> tuple[DataFrame, set[str]] | None:
        fresh = dated
        if named and check_stored and base.number:
            stored = versions.read(spark, path, base, days)
            if "request_id" in stored.columns:
                known = stored.select(F.col("request_id").alias("_id"), F.col("day").alias("_day"))
                fresh = dated.join(known, (F.col("request_id") == F.col("_id")) & F.col("day").eqNullSafe(F.col("_day")), "left_anti")
        # a batch without rows is recorded too
        return (fresh, set()) if stream is not None or not fresh.isEmpty() else None

    return versions.commit(spark, path, change, stream).number


def read_history(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored history in its newest version or an older one; an error when there is none."""
    return versions.read(spark, path, version)


def purge_history(spark: SparkSession, path: str, doomed: Column) -> int:
    """Take the rows that meet the condition out of the history; gives how many.

    Only the days that lose a row are written anew, and the new version appears at once. A null condition keeps the
    row. Older versions still hold the rows until ``versions.drop_versions`` deletes them.
    """
    gone, lost = F.coalesce(doomed, F.lit(False)), 0

    def change(base: versions.Version) -> tuple[DataFrame, set[str]] | None:
        nonlocal lost
        if not base.number:
            raise AnalysisException(f"{path} holds no history")
        # one row for each day comes to the driver
        touched = versions.read(spark, path, base).where(gone).groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()
        lost = sum(r["n"] for r in touched)
        days = {versions.NO_DAY if r["day"] is None else str(r["day"]) for r in touched}
        return (versions.read(spark, path, base, days).where(~gone), days) if touched else None

    versions.commit(spark, path, change)
    return lost
