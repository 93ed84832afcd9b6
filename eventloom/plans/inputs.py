"""The given tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators.ordered import positions
from eventloom.sources.logs import spread

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
VOCAB = len(EVENT_TYPES)
WINDOW = 10
REQUEST_LINES = 50
#: Rows that count as too many for one task in the queries that show the plan for large groups.
SMALL_LIMIT = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _event_id(event_type: Column) -> Column:
    number = F.lit(None).cast("int")
    for i, name in enumerate(EVENT_TYPES):
        number = F.when(event_type == name, F.lit(i)).otherwise(number)
    return number


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Users as blocks, event types as events: (block_id, ts, line_key, event)."""
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("block_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("line_key"),
        _event_id(F.col("event_type")).alias("event"),
    )


def large_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Event types as blocks, so that every block holds about a fifth of all rows."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("block_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("line_key"),
        (F.col("user_id") % VOCAB).cast("int").alias("event"),
    )


def labels(events_table: DataFrame) -> DataFrame:
    """A block is anomalous when more than a quarter of its events are errors."""
    errors = F.count(F.when(F.col("event") == 1, F.lit(1)))
    return events_table.groupBy("block_id").agg((4 * errors > F.count(F.lit(1))).cast("int").alias("is_anomaly"))


def event_names(column: str) -> Column:
    """0, 1, ... as E1, E2, ..."""
    return F.concat(F.lit("E"), (F.col(column) + 1).cast("string"))


def _props(df: DataFrame) -> Column:
    return F.from_json(F.col("props"), T.StructType.fromDDL("k INT"))["k"]


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as raw log lines: (line, file, split_start, row_in_split, event_id, user_id)."""
    raw = spread(table(spark, folder, "events"))
    block, k = F.concat(F.lit("blk_"), F.col("user_id").cast("string")), _props(raw).cast("string")
    size = (F.col("event_id") * 7 % 65536).cast("string")
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("Receiving block "), block, F.lit(" src: /10.250."), k, F.lit(".1:50010")))
        .when(F.col("event_type") == "error", F.concat(F.lit("Exception in block "), block, F.lit(" mirror 10.250."), k, F.lit(".2:50010 failed")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Received block "), block, F.lit(" of size "), size, F.lit(" from /10.250."), k, F.lit(".3")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("Updated map: 10.250."), k, F.lit(".4 is added to "), block, F.lit(" size "), size))
        .otherwise(F.concat(F.lit("Served block "), block, F.lit(" to /10.250."), k, F.lit(".5")))
    )
    header = F.concat_ws(
        " ", F.date_format("ts", "yyMMdd HHmmss"), (F.col("event_id") % 500).cast("string"), F.lit("INFO dfs.DataNode:"), text
    )
    return raw.select(
        header.alias("line"),
        F.lit("events").alias("file"),
        F.lit(0).cast("bigint").alias("split_start"),
        F.col("event_id").alias("row_in_split"),
        "event_id",
        "user_id",
    )


def traces(events_table: DataFrame) -> DataFrame:
    """Blocks as list strings: (BlockId, Label, Type, Features, TimeInterval, Latency)."""
    numbered = positions(events_table, ["block_id"], ["ts", "line_key"])
    cut = numbered.select(F.col("block_id").alias("BlockId"), "pos", F.unix_micros("ts").alias("at"), event_names("event").alias("name"), "event")
    rows = cut.groupBy("BlockId").agg(
        F.array_sort(F.collect_list(F.struct("pos", "at", "name"))).alias("_e"),
        (4 * F.count(F.when(F.col("event") == 1, F.lit(1))) > F.count(F.lit(1))).alias("_bad"),
    )
    gaps = F.transform(
        F.sequence(F.lit(2), F.size("_e")), lambda i: ((F.element_at("_e", i)["at"] - F.element_at("_e", i - 1)["at"]) / 1_000_000).cast("string")
    )
    gaps = F.when(F.size("_e") > 1, gaps).otherwise(F.array().cast("array<string>"))
    latency = (F.element_at("_e", -1)["at"] - F.element_at("_e", 1)["at"]) / 1_000_000

    def listed(items: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))

    return rows.select(
        "BlockId",
        F.when(F.col("_bad"), "Fail").otherwise("Success").alias("Label"),
        F.when(F.col("_bad"), "1").alias("Type"),
        listed(F.transform("_e", lambda x: x["name"])).alias("Features"),
        listed(gaps).alias("TimeInterval"),
        latency.alias("Latency"),
    )


def trace_labels(traces_table: DataFrame) -> DataFrame:
    return traces_table.select("BlockId", F.when(F.col("Label") == "Fail", "Anomaly").otherwise("Normal").alias("Label"))


def template_texts(spark: SparkSession) -> DataFrame:
    """Texts of four of the five events; the last is left out so that a lookup can miss."""
    texts = [(i, f"template of {name}") for i, name in enumerate(EVENT_TYPES[:-1])]
    return spark.createDataFrame(texts, "event_id INT, template_text STRING")


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Events as request history."""
    raw = table(spark, folder, "events")
    ok = F.col("event_type") != "error"
    return raw.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("profile_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.concat(F.lit("blk_"), F.col("user_id").cast("string")).alias("block_id"),
        F.when(ok, 200).otherwise(422).alias("status_code"),
        F.col("value").alias("processing_ms"),
        _props(raw).alias("num_log_lines"),
        F.when(ok, F.col("value") / 100).alias("score"),
    )


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as profiles."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_acctbal") >= 0, "ACTIVE").otherwise("INACTIVE").alias("status"),
        F.when(F.col("c_mktsegment") == "BUILDING", "ADMIN").otherwise("USER").alias("role"),
    )


def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as scored blocks of three models, half validation and half test."""
    multipliers = F.explode(F.array(*[F.lit(m) for m in (37, 53, 71)]))
    rows = table(spark, folder, "labels").select("doc_id", "toxic", multipliers.alias("m"))
    return rows.select(
        F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"),
        F.when(F.col("doc_id") % 2 == 0, "val").otherwise("test").alias("split"),
        F.col("doc_id").cast("string").alias("block_id"),
        F.col("toxic").cast("int").alias("y_true"),
        (F.col("doc_id") * F.col("m") % 101 / 100.0).alias("score"),
        (F.col("doc_id") % 17 + 1).alias("num_windows"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines of a user in requests of at most ``REQUEST_LINES`` lines; some ask for a block that is absent."""
    numbered = positions(log_lines(spark, folder), ["user_id"], ["row_in_split"])
    part = F.floor(F.col("pos") / REQUEST_LINES)
    rows = numbered.groupBy("user_id", part.alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("log_lines")
    )
    wanted = F.when((F.col("user_id") % 10 == 0), F.lit("blk_absent")).otherwise(F.concat(F.lit("blk_"), F.col("user_id").cast("string")))
    return rows.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("part").cast("string")).alias("request_id"),
        wanted.alias("block_id"),
        "log_lines",
        (F.col("user_id") % 2 == 0).alias("return_event_ids"),
        (F.col("user_id") % 3 == 0).alias("return_window_scores"),
    )


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as API request log rows with a limit scope."""
    raw = table(spark, folder, "events")
    scopes = F.array(*[F.lit(s) for s in ("model_predict", "history_read", "login_account", "login_global", "admin_write")])
    return raw.select(
        F.col("event_id").cast("string").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("line_key"),
        "user_id",
        F.concat(F.lit(" User"), F.col("user_id").cast("string"), F.lit("@Mail.COM ")).alias("identifier"),
        F.element_at(scopes, (F.col("event_id") % 5 + 1).cast("int")).alias("scope"),
        (F.col("event_type") == "error").alias("failed"),
        "value",
    )
