"""Rate-limit audit of request logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.functions.text import limit_amount, limit_seconds
from eventloom.operators.ordered import GROUP_ROWS, _null_safe_join, running

# The limits of the service.
RULES = (
    ("login_account", "5 per minute", "open"),
    ("login_global", "60 per minute", "open"),
    ("register_identifier", "3 per hour", "open"),
    ("register_global", "30 per hour", "open"),
    ("profile_read", "120 per minute", "open"),
    ("profile_write", "30 per minute", "open"),
    ("history_read", "120 per minute", "open"),
    ("history_write", "30 per minute", "open"),
    ("model_info", "60 per minute", "open"),
    ("model_predict", "30 per minute", "open"),
    ("admin_read", "120 per minute", "open"),
    ("admin_write", "30 per minute", "open"),
)


def rules(spark: SparkSession) -> DataFrame:
    """(scope, amount, seconds, failure_mode)."""
    table = spark.createDataFrame(list(RULES), schemas.RATE_RULE)
    return table.select(
        "scope", limit_amount(F.col("limit")).alias("amount"), limit_seconds(F.col("limit")).alias("seconds"), "failure_mode"
    )


def window_estimate(previous: Column, current: Column, elapsed: Column, seconds: Column) -> Column:
    """Requests in the sliding window: the previous window's count, weighted by what is left of it, plus current."""
    return F.floor(previous * (1 - elapsed / seconds)) + current


def audit(
    requests: DataFrame, key: str, ts: str, order: Sequence[str], amount: Column, seconds: Column, limit: int = GROUP_ROWS
) -> DataFrame:
    """For each request: whether the sliding-window counter would have let it pass, and what was left.

    All requests count towards the load, also those beyond the limit. Adds ``estimate`` (the load with
    this request), ``allowed``, ``remaining``, ``reset_at`` and ``retry_after`` in seconds.
    """
    at = F.unix_micros(F.col(ts)) / 1_000_000
    timed = requests.withColumns({"_at": at, "_amount": amount, "_seconds": seconds})
    timed = timed.withColumn("_slot", F.floor(F.col("_at") / F.col("_seconds")))
    slot = [key, "_seconds", "_slot"]
    numbered = running(timed, slot, [ts, *order], {"_current": ("sum", F.lit(1).cast("bigint"))}, limit=limit)
    earlier = timed.groupBy(*slot).agg(F.count(F.lit(1)).alias("_previous")).withColumn("_slot", F.col("_slot") + 1)
    joined = _null_safe_join(numbered, earlier, slot).withColumn("_previous", F.coalesce("_previous", F.lit(0)))
    elapsed = F.col("_at") - F.col("_slot") * F.col("_seconds")
    estimate = window_estimate(F.col("_previous"), F.col("_current"), elapsed, F.col("_seconds"))
    reset_at = ((F.col("_slot") + 1) * F.col("_seconds")).cast("bigint")
    return (
        joined.withColumn("estimate", estimate.cast("bigint"))
        .withColumns(
            {
                "allowed": F.col("estimate") <= F.col("_amount"),
                "remaining": F.greatest(F.col("_amount") - F.col("estimate"), F.lit(0)),
                "reset_at": reset_at,
                "retry_after": F.greatest(reset_at - F.ceil("_at"), F.lit(0)),
            }
        )
        .drop("_at", "_amount", "_seconds", "_slot", "_current", "_previous")
    )


#: Scopes whose load is counted per hashed identifier and the kind of that identifier; ``*_global`` scopes
#: count everyone together, all others count per user.
IDENTIFIER_SCOPES = {"login_account": "account", "register_identifier": "identifier"}


def limit_keys(requests: DataFrame, secret: str) -> DataFrame:
    """Add ``limit_key`` by scope from ``user_id`` and ``identifier``.

    The account scope only counts failed logins (``failed``), so other rows of it are dropped.
    """
    from eventloom.functions.privacy import global_key, identifier_key, user_key

    scope = F.col("scope")
    key = user_key(scope, F.col("user_id"))
    key = F.when(scope.endswith("_global"), global_key(scope)).otherwise(key)
    for name, kind in IDENTIFIER_SCOPES.items():
        key = F.when(scope == name, identifier_key(scope, kind, F.col("identifier"), secret)).otherwise(key)
    counted = (scope != "login_account") | F.coalesce(F.col("failed"), F.lit(False))
    return requests.filter(counted).withColumn("limit_key", key)


def audit_by_rule(requests: DataFrame, ts: str = "ts", order: Sequence[str] = ("line_key",), limit: int = GROUP_ROWS) -> DataFrame:
    """Audit requests that carry ``scope`` and ``limit_key`` against the fixed rules; a scope without rule has no verdict."""
    known = F.broadcast(rules(requests.sparkSession))  # one row for each rule
    ruled = requests.join(known, "scope", "left")
    return audit(ruled, "limit_key", ts, order, F.col("amount"), F.col("seconds"), limit)
