"""Request history, profiles, and batch scoring of requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.text import strip
from eventloom.operators.logs import parse_lines, usable_lines
from eventloom.operators.nextevent import NextEventModel
from eventloom.operators.ordered import GROUP_ROWS, _null_safe_join, positions, quantiles
from eventloom.operators.scoring import score_blocks, score_windows, window_surprise
from eventloom.operators.templates import masked_tokens, match_templates
from eventloom.session import cut_lineage

# Outcome codes and the text stored for requests that could not be scored.
OK, UNPROCESSABLE = 200, 422
FAILURE_MESSAGE = "model couldn't process data"
#: Why a request could not be scored.
NO_SEQUENCE, NOT_FOUND, TOO_SHORT = "no_sequence", "block_not_found", "too_short"
MIN_SEQUENCE = 2
#: Offset up to which a page is taken by sort and skip.
SKIP_ROWS = 100_000


def history_of(history: DataFrame, profile_id: int) -> DataFrame:
    return history.filter(F.col("profile_id") == profile_id)


def newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("created_at"), F.desc("id"))


def page(df: DataFrame, order: list[Column], number: int, size: int, skip_rows: int = SKIP_ROWS) -> DataFrame:
    """Rows of page ``number`` (from 1) with ``has_next``; both are at least 1.

    Up to ``skip_rows`` one row more than the page is taken from the top of the sort. Deeper pages are
    found by row position, which does not bring the skipped rows to one place. One row more than the page tells
    whether there is a next one.
    """
    number, size = max(number, 1), max(size, 1)
    first = (number - 1) * size
    near = df.orderBy(*order).limit(first + size + 1) if first + size <= skip_rows else df
    numbered = positions(near, [], order, name="place")
    wanted = numbered.filter((F.col("place") >= first) & (F.col("place") <= first + size))
    # size + 1 rows at most
    more = F.max("place").over(Window.partitionBy(F.lit(0))) == first + size
    return wanted.withColumn("has_next", more).filter(F.col("place") < first + size)


def page_after(history: DataFrame, created_at, last_id: int, size: int) -> DataFrame:
    """The next page after a row already seen; needs no offset at any depth."""
    older = (F.col("created_at") < F.lit(created_at)) | (
        (F.col("created_at") == F.lit(created_at)) & (F.col("id") < last_id)
    )
    return newest_first(history.filter(older)).limit(max(size, 1) + 1)


def request_stats(history: DataFrame, by: list[str] | None = None, limit: int = GROUP_ROWS) -> DataFrame:
    """Counts, processing time and line statistics, overall or per ``by``; nulls are ignored."""
    by = by or []
    counts = history.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count(F.when(F.col("status_code") == OK, F.lit(1))).alias("successful_requests"),
        F.count(F.when(F.col("status_code") != OK, F.lit(1))).alias("failed_requests"),
        F.avg("processing_ms").alias("mean_processing_ms"),
        F.avg("num_log_lines").alias("mean_num_log_lines"),
        F.min("num_log_lines").alias("min_num_log_lines"),
        F.max("num_log_lines").alias("max_num_log_lines"),
    )
    times = quantiles(
        history,
        by,
        "processing_ms",
        {"p50_processing_ms": 0.5, "p95_processing_ms": 0.95, "p99_processing_ms": 0.99},
        limit,
    )
    if by:
        return _null_safe_join(counts, times, by)
    # one row, or none without history
    return counts.join(F.broadcast(times), F.lit(True), "left")


def request_stats_rollup(history: DataFrame, limit: int = GROUP_ROWS) -> DataFrame:
    """Statistics per profile plus one row over all (``profile_id`` null)."""
    both = history.withColumn("profile_id", F.explode(F.array(F.col("profile_id"), F.lit(None).cast("bigint"))))
    return request_stats(both, ["profile_id"], limit)


def purge(history: DataFrame, doomed: Column) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one-row count of deleted rows). A null condition keeps the row."""
    gone = F.coalesce(doomed, F.lit(False))
    return history.filter(~gone), history.filter(gone).agg(F.count(F.lit(1)).alias("deleted"))


def search_profiles(
    profiles: DataFrame, email_prefix: str | None = None, role: str | None = None, status: str | None = None
) -> DataFrame:
    """Profiles by email prefix (any case, taken literally), role and status, by id."""
    if email_prefix:
        profiles = profiles.filter(F.lower("email").startswith(email_prefix.lower()))
    if role is not None:
        profiles = profiles.filter(F.col("role") == role)
    if status is not None:
        profiles = profiles.filter(F.col("status") == status)
    return profiles.orderBy("id")


def with_profile(history: DataFrame, profiles: DataFrame) -> DataFrame:
    owners = profiles.select(F.col("id").alias("profile_id"), "email", "role", "status")
    return history.join(owners, "profile_id")


def orphans(history: DataFrame, profiles: DataFrame) -> DataFrame:
    return history.join(profiles.select(F.col("id").alias("profile_id")), "profile_id", "left_anti")


def check_requests(requests: DataFrame) -> DataFrame:
    """Strip block id and lines and add ``valid``: a block id, at least one line, no empty line."""
    stripped = requests.withColumns(
        {"block_id": strip(F.col("block_id")), "log_lines": F.transform("log_lines", strip)}
    )
    valid = (
        F.coalesce(F.length("block_id") > 0, F.lit(False))
        & (F.coalesce(F.size("log_lines"), F.lit(0)) > 0)
        & F.coalesce(F.forall("log_lines", lambda x: F.coalesce(F.length(x) > 0, F.lit(False))), F.lit(False))
    )
    return stripped.withColumn("valid", valid)


@dataclass(frozen=True)
class Scorer:
    """What is needed to score raw lines: templates, model and decision rule."""

    templates: DataFrame
    model: NextEventModel
    threshold: float
    window: int = 10
    stride: int = 1
    strategy: str = "nll_max"
    top_k: int = 3

    def events(self, lines: DataFrame) -> DataFrame:
        """Lines as (…, event): matched template, or the unknown id that closes the vocabulary."""
        worded = lines.withColumn("tokens", masked_tokens(F.col("content")))
        matched = match_templates(worded, self.templates)
        return matched.withColumn("event", F.coalesce("cluster_id", F.lit(self.model.vocab_size - 1))).drop("tokens")


def score_requests(requests: DataFrame, scorer: Scorer, limit: int = GROUP_ROWS) -> DataFrame:
    """Score every request (request_id, block_id, log_lines, return_event_ids, return_window_scores).

    Failures become rows with ``reason`` instead of exceptions. ``event_ids`` and ``window_scores`` are
    filled only when asked for.
    """
    lines = requests.select(
        "request_id", F.col("block_id").alias("wanted"), F.posexplode("log_lines").alias("line_key", "line")
    )
    parsed = usable_lines(parse_lines(lines)).withColumn("ts", F.col("timestamp"))
    # parsed and matched once; counts, scores and lists below all start from it
    events = cut_lineage(scorer.events(parsed).select("request_id", "wanted", "block_id", "ts", "line_key", "event"))
    lengths = events.groupBy("request_id", "block_id", "wanted").agg(F.count(F.lit(1)).alias("n"))
    found = (
        lengths.filter(F.col("n") >= MIN_SEQUENCE)
        .groupBy("request_id")
        .agg(F.max(F.when(F.col("block_id") == F.col("wanted"), F.col("n"))).alias("num_events"))
    )
    wanted = events.filter(F.col("block_id") == F.col("wanted")).withColumn("block_id", F.col("request_id"))
    surprise = cut_lineage(window_surprise(wanted, scorer.model, scorer.window, scorer.stride, scorer.top_k, limit=limit))
    blocks = score_blocks(surprise, None, [scorer.strategy], limit).select(
        F.col("block_id").alias("request_id"), "num_windows", "score"
    )
    value = score_windows(surprise, [scorer.strategy]).select(
        F.col("block_id").alias("request_id"), "start", F.col(scorer.strategy).alias("window_score")
    )
    flags = requests.select("request_id", "return_event_ids", "return_window_scores")
    # only requests that ask for the lists pay for them; a request's lines came in one cell already
    listed = wanted.drop("block_id").join(flags.filter("return_event_ids").select("request_id"), "request_id", "left_semi")
    ids = listed.groupBy("request_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "line_key", "event"))), lambda x: x["event"]).alias("event_ids")
    )
    asked = value.join(flags.filter("return_window_scores").select("request_id"), "request_id", "left_semi")
    window_lists = asked.groupBy("request_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("start", "window_score"))), lambda x: x["window_score"]).alias("window_scores")
    )
    joined = (
        requests.select("request_id", "block_id", F.size("log_lines").alias("num_log_lines"))
        .join(found.withColumn("_parsed", F.lit(True)), "request_id", "left")
        .join(blocks, "request_id", "left")
        .join(ids, "request_id", "left")
        .join(window_lists, "request_id", "left")
    )
    scored = F.col("score").isNotNull()
    reason = (
        F.when(F.col("_parsed").isNull(), F.lit(NO_SEQUENCE))
        .when(F.col("num_events").isNull(), F.lit(NOT_FOUND))
        .when(~scored, F.lit(TOO_SHORT))
    )
    return joined.select(
        "request_id",
        "block_id",
        "score",
        F.lit(float(scorer.threshold)).alias("threshold"),
        F.when(scored, F.col("score") >= scorer.threshold).alias("is_anomaly"),
        F.lit(scorer.strategy).alias("scoring_strategy"),
        "num_log_lines",
        "num_events",
        "num_windows",
        F.when(scored, F.col("event_ids")).alias("event_ids"),
        "window_scores",
        F.when(scored, F.lit(OK)).otherwise(F.lit(UNPROCESSABLE)).alias("status_code"),
        reason.alias("reason"),
    )


def outcomes(scored: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """History columns of scored requests: counts and score only for those that succeeded.

    With ``requests`` (request_id, profile_id, created_at, processing_ms) the rows are complete: ``id`` is a number made
    of the request id, so the same request always has the same one.
    """
    ok = F.col("status_code") == OK

    def when_ok(name: str) -> Column:
        return F.when(ok, F.col(name)).alias(name)

    rows = scored.select(
        "request_id",
        "block_id",
        "status_code",
        "num_log_lines",
        when_ok("num_events"),
        when_ok("num_windows"),
        when_ok("score"),
        when_ok("threshold"),
        when_ok("is_anomaly"),
        F.when(~ok, F.lit(FAILURE_MESSAGE)).alias("error_message"),
    )
    if requests is None:
        return rows
    facts = requests.select("request_id", "profile_id", "created_at", "processing_ms")
    number = F.shiftrightunsigned(F.xxhash64("request_id"), 1)
    return rows.join(facts, "request_id").select(number.alias("id"), *rows.columns, "profile_id", "created_at", "processing_ms")
