"""Queries over ordered sequences, intervals, occurrences, transitions, splits and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.text import anomaly_flag, list_items, list_numbers, strict_label
from eventloom.operators import evaluation, features, nextevent, profile, sequences, splits, templates, transitions, windows
from eventloom.operators.ordered import describe
from eventloom.plans import inputs
from eventloom.plans.inputs import SMALL_LIMIT, VOCAB, WINDOW
from eventloom.plans.registry import EV, LAB, MODEL, PAIR, SPLIT, joined, query, rounded

QUARTERS = """count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
  round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75,
  round(max(v), 6) AS max"""

FEAT = LAB + ", " + PAIR + """, it AS (
  SELECT block_id, CAST(count(*) AS DOUBLE) AS sequence_len, sum(coalesce(seconds, 0)) AS latency, coalesce(avg(seconds), 0) AS ti_mean,
         coalesce(max(seconds), 0) AS ti_max, coalesce(stddev_pop(seconds), 0) AS ti_std,
         coalesce(avg(CASE WHEN seconds = 0 THEN 1.0 WHEN seconds IS NOT NULL THEN 0.0 END), 0) AS ti_zeros
  FROM ev LEFT JOIN pr USING (block_id, pos) GROUP BY block_id)"""

# Blocks as list strings, in pieces of 50 events.
TRACE = EV + """, pc AS (
  SELECT block_id AS BlockId, pos, event, ts FROM ev),
  pg AS (
  SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY BlockId ORDER BY pos))) / 1e6 AS gap FROM pc),
  tc AS (
  SELECT BlockId, count(*) AS sequence_len, coalesce(sum(gap), 0) AS latency, coalesce(avg(gap), 0) AS ti_mean,
         coalesce(max(gap), 0) AS ti_max, coalesce(stddev_pop(gap), 0) AS ti_std,
         coalesce(avg(CASE WHEN gap = 0 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END), 0) AS ti_zeros,
         CASE WHEN 4 * count(*) FILTER (event = 1) > count(*) THEN 1 ELSE 0 END AS y,
         count(*) FILTER (event = 0) AS E1, count(*) FILTER (event = 1) AS E2, count(*) FILTER (event = 2) AS E3,
         count(*) FILTER (event = 3) AS E4, count(*) FILTER (event = 4) AS E5
  FROM pg GROUP BY BlockId)"""


@query(
    "sequences",
    f"WITH {EV} SELECT block_id, CAST(0 AS BIGINT) AS chunk, string_agg(CAST(event AS VARCHAR), ',' ORDER BY pos) AS sequence FROM ev GROUP BY block_id HAVING count(*) >= 2",
)
def build_sequences(spark, folder):
    built = sequences.build_sequences(inputs.events(spark, folder))
    return built.select("block_id", "chunk", joined("sequence").alias("sequence"))


LARGE = """lb AS (
  SELECT event_type AS block_id, user_id % 5 AS event, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events)"""


@query(
    "sequences_chunked",
    f"""WITH {LARGE} SELECT block_id, CAST(floor(pos / 256) AS BIGINT) AS chunk, string_agg(CAST(event AS VARCHAR), ',' ORDER BY pos) AS sequence
  FROM lb GROUP BY ALL""",
)
def sequences_chunked(spark, folder):
    """Blocks too large for one task or one cell."""
    built = sequences.build_sequences(inputs.large_blocks(spark, folder), size=256, limit=SMALL_LIMIT)
    return built.select("block_id", "chunk", joined("sequence").alias("sequence"))


@query(
    "sequence_len_describe",
    f"WITH {EV}, n AS (SELECT count(*) AS v FROM ev GROUP BY block_id) SELECT {QUARTERS} FROM n".replace("round(min(v), 6)", "CAST(min(v) AS DOUBLE)").replace("round(max(v), 6)", "CAST(max(v) AS DOUBLE)"),
)
def sequence_len_describe(spark, folder):
    lengths = sequences.sequence_lengths(sequences.build_sequences(inputs.events(spark, folder), 1))
    return rounded(describe(lengths, [], "sequence_len"))


@query("intervals", f"WITH {EV}, {PAIR} SELECT block_id, pos, round(seconds, 6) AS seconds FROM pr")
def interval_rows(spark, folder):
    return rounded(sequences.intervals(inputs.events(spark, folder)).select("block_id", "pos", "seconds"))


@query(
    "interval_stats",
    f"""WITH {FEAT} SELECT block_id, CAST(sequence_len AS BIGINT) AS sequence_len, round(latency, 6) AS latency, round(ti_mean, 6) AS ti_mean,
  round(ti_max, 6) AS ti_max, round(ti_std, 4) AS ti_std, round(ti_zeros, 6) AS ti_zeros FROM it""",
)
def interval_stats(spark, folder):
    stats = sequences.interval_features(inputs.events(spark, folder))
    return rounded(stats.withColumn("ti_std", F.round("ti_std", 4)))


@query(
    "interval_describe_by_class",
    f"""WITH {FEAT}, u AS (SELECT is_anomaly, u.metric, u.v FROM (
    SELECT is_anomaly, unnest([{{'metric': 'latency', 'v': latency}}, {{'metric': 'ti_mean', 'v': ti_mean}}, {{'metric': 'ti_max', 'v': ti_max}},
      {{'metric': 'ti_zeros', 'v': ti_zeros}}, {{'metric': 'sequence_len', 'v': sequence_len}}]) AS u FROM it JOIN lab USING (block_id)))
  SELECT is_anomaly, metric, count(v) AS count, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS std, round(min(v), 3) AS min,
    round(quantile_cont(v, 0.25), 3) AS p25, round(quantile_cont(v, 0.5), 3) AS p50, round(quantile_cont(v, 0.75), 3) AS p75, round(max(v), 3) AS max
  FROM u GROUP BY ALL""",
)
def interval_describe_by_class(spark, folder):
    events = inputs.events(spark, folder)
    table = profile.describe_by_class(
        sequences.interval_features(events), inputs.labels(events), ["latency", "ti_mean", "ti_max", "ti_zeros", "sequence_len"]
    )
    return table.withColumns({c: F.round(c, 3) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")})


@query(
    "occurrence_matrix",
    f"WITH {EV} SELECT block_id, " + ", ".join(f"count(*) FILTER (event = {i}) AS E{i + 1}" for i in range(5)) + " FROM ev GROUP BY block_id",
)
def occurrence_matrix(spark, folder):
    named = inputs.events(spark, folder).withColumn("event", F.col("event") + 1)
    return sequences.occurrence_matrix(named, range(1, VOCAB + 1), prefix="E")


OCC = LAB + ", oc AS (SELECT block_id, event, is_anomaly, count(*) AS cnt FROM ev JOIN lab USING (block_id) GROUP BY ALL)"
SHARE = OCC + """, sh AS (
  SELECT is_anomaly, event, CAST(sum(cnt) AS BIGINT) AS cnt, sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY is_anomaly) AS share FROM oc GROUP BY 1, 2)"""


def _occurrences(spark, folder):
    events = inputs.events(spark, folder)
    return sequences.occurrences(events), inputs.labels(events)


@query(
    "event_presence_by_class",
    f"WITH {OCC} SELECT event, count(*) FILTER (is_anomaly = 0) AS blocks_norm, count(*) FILTER (is_anomaly = 1) AS blocks_anom FROM oc GROUP BY event",
)
def event_presence_by_class(spark, folder):
    return profile.event_presence(*_occurrences(spark, folder))


@query("event_share_by_class", f"WITH {SHARE} SELECT is_anomaly, event, cnt, round(share, 6) AS share FROM sh")
def event_share_by_class(spark, folder):
    return rounded(profile.event_share(*_occurrences(spark, folder)))


@query(
    "event_share_top",
    f"WITH {SHARE} SELECT event, round(share, 6) AS share FROM sh WHERE is_anomaly = 1 ORDER BY sh.share DESC, event LIMIT 3",
)
def event_share_top(spark, folder):
    return rounded(profile.top_events(profile.event_share(*_occurrences(spark, folder)), 1, 3).select("event", "share"))


@query(
    "event_share_skew",
    f"""WITH {SHARE} SELECT event, round(d, 6) AS share_diff FROM (
    SELECT event, coalesce(max(share) FILTER (is_anomaly = 1), 0) - coalesce(max(share) FILTER (is_anomaly = 0), 0) AS d FROM sh GROUP BY event)
  WHERE d > 0 ORDER BY d DESC, event LIMIT 10""",
)
def event_share_skew(spark, folder):
    return rounded(profile.share_skew(profile.event_share(*_occurrences(spark, folder))).select("event", "share_diff"))


@query(
    "event_sets",
    """WITH p AS (SELECT role, count(*) FILTER (turn > 0) AS late, count(*) FILTER (turn = 0) AS first FROM conversations GROUP BY role)
  SELECT role AS event, CASE WHEN first > 0 AND late > 0 THEN 'both' WHEN first > 0 THEN 'normal' ELSE 'anomaly' END AS occurs_in
  FROM p WHERE first > 0 OR late > 0""",
)
def event_sets(spark, folder):
    """Roles that occur only in opening turns, only in later turns, or in both."""
    turns = inputs.table(spark, folder, "conversations")
    presence = turns.groupBy(F.col("role").alias("event")).agg(
        F.count(F.when(F.col("turn") == 0, 1)).alias("blocks_norm"), F.count(F.when(F.col("turn") > 0, 1)).alias("blocks_anom")
    )
    return profile.event_sets(presence)


TRANS = LAB + ", " + PAIR + """, tk AS (
  SELECT prev, next, count(*) FILTER (is_anomaly = 0) AS cnt_norm, count(*) FILTER (is_anomaly = 1) AS cnt_anom, count(*) AS cnt_total
  FROM pr JOIN lab USING (block_id) GROUP BY ALL),
  tz AS (SELECT *, cnt_norm / greatest(sum(cnt_norm) OVER (), 1) AS p_norm, cnt_anom / greatest(sum(cnt_anom) OVER (), 1) AS p_anom FROM tk),
  tl AS (SELECT *, ln((p_anom + 1e-12) / (p_norm + 1e-12)) AS log_ratio FROM tz)"""


def _contrast(spark, folder):
    events = inputs.events(spark, folder)
    return transitions.transition_contrast(transitions.transition_pairs(events), inputs.labels(events))


@query("transition_counts", f"WITH {EV}, {PAIR} SELECT prev, next, count(*) AS cnt FROM pr GROUP BY ALL")
def transition_counts(spark, folder):
    return transitions.transition_counts(transitions.transition_pairs(inputs.events(spark, folder)))


@query(
    "transition_counts_large",
    f"""WITH {LARGE} SELECT CAST(event AS INTEGER) AS prev, CAST(nxt AS INTEGER) AS next, count(*) AS cnt FROM (
    SELECT event, lead(event) OVER (PARTITION BY block_id ORDER BY pos) AS nxt FROM lb) WHERE nxt IS NOT NULL GROUP BY ALL""",
)
def transition_counts_large(spark, folder):
    """Transitions inside blocks too large for one task."""
    return transitions.transition_counts(transitions.transition_pairs(inputs.large_blocks(spark, folder), limit=SMALL_LIMIT))


@query("transition_top30", f"WITH {EV}, {PAIR} SELECT prev, next, count(*) AS cnt FROM pr GROUP BY ALL ORDER BY cnt DESC, prev, next LIMIT 30")
def transition_top30(spark, folder):
    return transitions.top_transitions(transition_counts(spark, folder))


@query(
    "transition_contrast",
    f"WITH {TRANS} SELECT prev, next, cnt_norm, cnt_anom, cnt_total, round(p_norm, 6) AS p_norm, round(p_anom, 6) AS p_anom, round(log_ratio, 6) AS log_ratio FROM tl",
)
def transition_contrast(spark, folder):
    return rounded(_contrast(spark, folder))


@query(
    "transition_skew_anomaly",
    f"WITH {TRANS} SELECT prev, next, round(log_ratio, 6) AS log_ratio FROM tl WHERE cnt_total >= 100 ORDER BY tl.log_ratio DESC, prev, next LIMIT 10",
)
def transition_skew_anomaly(spark, folder):
    return rounded(transitions.skewed_transitions(_contrast(spark, folder), "anomaly", 10).select("prev", "next", "log_ratio"))


@query(
    "transition_skew_normal",
    f"WITH {TRANS} SELECT prev, next, round(log_ratio, 6) AS log_ratio FROM tl WHERE cnt_total >= 100 ORDER BY tl.log_ratio, prev, next LIMIT 10",
)
def transition_skew_normal(spark, folder):
    return rounded(transitions.skewed_transitions(_contrast(spark, folder), "normal", 10).select("prev", "next", "log_ratio"))


MATRIX = TRANS + """, gr AS (
  SELECT a.event AS prev, b.event AS next, coalesce(cnt_norm, 0) AS cn, coalesce(cnt_anom, 0) AS ca
  FROM (SELECT DISTINCT event FROM ev) a CROSS JOIN (SELECT DISTINCT event FROM ev) b LEFT JOIN tk ON tk.prev = a.event AND tk.next = b.event),
  pm AS (SELECT prev, next, cn / (sum(cn) OVER (PARTITION BY prev) + 1e-12) AS p_norm, ca / (sum(ca) OVER (PARTITION BY prev) + 1e-12) AS p_anom FROM gr)"""


def _matrix(spark, folder):
    return transitions.transition_matrix(_contrast(spark, folder), inputs.events(spark, folder).select("event").distinct())


@query("transition_matrix", f"WITH {MATRIX} SELECT prev, next, round(p_norm, 6) AS p_norm, round(p_anom, 6) AS p_anom FROM pm")
def transition_matrix(spark, folder):
    return rounded(_matrix(spark, folder).select("prev", "next", "p_norm", "p_anom"))


@query("transition_matrix_delta", f"WITH {MATRIX} SELECT prev, next, round(p_anom - p_norm, 6) AS delta FROM pm")
def transition_matrix_delta(spark, folder):
    return rounded(_matrix(spark, folder).select("prev", "next", "delta"))


@query(
    "label_encode",
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS loose, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS strict FROM labels""",
)
def label_encode(spark, folder):
    raw = inputs.table(spark, folder, "labels")
    loose = F.when(F.col("toxic") == 1, F.lit(" ANOMALY\t")).otherwise(F.lit("Normal"))
    strict = F.when(F.col("quality") == 1, F.lit("Normal")).otherwise(F.lit("Anomaly"))
    return raw.select("doc_id", anomaly_flag(loose).alias("loose"), strict_label(strict).alias("strict"))


@query("block_labels", f"WITH {LAB} SELECT block_id, is_anomaly FROM lab")
def block_labels(spark, folder):
    return inputs.labels(inputs.events(spark, folder))


@query(
    "class_balance",
    f"WITH {LAB} SELECT count(*) AS blocks, CAST(sum(is_anomaly) AS BIGINT) AS anomalies, round(avg(is_anomaly) * 100, 2) AS anomaly_percent FROM lab",
)
def class_balance(spark, folder):
    return profile.class_balance(inputs.labels(inputs.events(spark, folder)))


@query(
    "null_counts",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls FROM documents LEFT JOIN labels USING (doc_id)"""
        for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
    )
    + ")",
)
def null_counts(spark, folder):
    docs, known = inputs.table(spark, folder, "documents"), inputs.table(spark, folder, "labels")
    return profile.null_counts(docs.join(known, "doc_id", "left"))


@query(
    "crosstab_label_type",
    f"""WITH {TRACE} SELECT CASE WHEN y = 1 THEN 'Fail' ELSE 'Success' END AS "Label", count(*) FILTER (y = 1) AS present, count(*) FILTER (y = 0) AS missing
  FROM tc GROUP BY 1""",
)
def crosstab_label_type(spark, folder):
    return profile.crosstab_null(inputs.traces(inputs.events(spark, folder)), "Label", "Type")


@query("duplicate_keys", "SELECT count(*) - count(DISTINCT conv_id) AS duplicates FROM conversations")
def duplicate_keys(spark, folder):
    return profile.duplicate_keys(inputs.table(spark, folder, "conversations"), "conv_id")


@query(
    "consistency_checks",
    f"""WITH {TRACE} SELECT count(*) FILTER (CAST(BlockId AS BIGINT) % 7 = 0) AS length_mismatches,
  count(*) FILTER (CAST(BlockId AS BIGINT) % 5 = 0) AS latency_mismatches, count(*) AS blocks FROM tc""",
)
def consistency_checks(spark, folder):
    """Blocks of which every seventh has an interval too many and every fifth a wrong latency."""
    rows = inputs.traces(inputs.events(spark, folder))
    number = F.col("BlockId").cast("bigint")
    longer = F.when(F.col("TimeInterval") == "[]", "[0.0]").otherwise(F.regexp_replace("TimeInterval", "]$", ", 0.0]"))
    rows = rows.withColumns(
        {
            "TimeInterval": F.when(number % 7 == 0, longer).otherwise(F.col("TimeInterval")),
            "Latency": F.when(number % 5 == 0, F.col("Latency") + 1).otherwise(F.col("Latency")),
        }
    )
    return sequences.consistency(
        rows.select(
            list_items(F.col("Features")).alias("events"), list_numbers(F.col("TimeInterval")).alias("intervals"), F.col("Latency").alias("latency")
        )
    )


@query(
    "trace_features",
    f"""WITH {TRACE} SELECT BlockId, round(latency, 6) AS Latency, CAST(sequence_len AS INTEGER) AS sequence_len, round(ti_mean, 6) AS ti_mean,
  round(ti_max, 6) AS ti_max, round(ti_std, 4) AS ti_std, round(ti_zeros, 6) AS ti_zeros, round(latency, 6) AS ti_sum FROM tc""",
)
def trace_features(spark, folder):
    stats = features.trace_features(inputs.traces(inputs.events(spark, folder)))
    return rounded(stats.withColumn("ti_std", F.round("ti_std", 4)))


@query(
    "tabular_features",
    f"""WITH {TRACE} SELECT BlockId, CAST(E1 AS DOUBLE) AS E1, CAST(E2 AS DOUBLE) AS E2, CAST(E3 AS DOUBLE) AS E3, CAST(E4 AS DOUBLE) AS E4, CAST(E5 AS DOUBLE) AS E5,
  CAST(sequence_len AS DOUBLE) AS sequence_len, round(latency, 6) AS Latency, round(ti_mean, 6) AS ti_mean, round(ti_max, 6) AS ti_max,
  round(ti_std, 4) AS ti_std, round(ti_zeros, 6) AS ti_zeros, y FROM tc""",
)
def tabular_features(spark, folder):
    """Occurrence counts, trace features and labels joined, all from list strings as in the published files."""
    rows = inputs.traces(inputs.events(spark, folder))
    exploded = rows.select(F.col("BlockId").alias("block_id"), F.explode(list_items(F.col("Features"))).alias("event"))
    wide = sequences.occurrence_matrix(exploded, [f"E{i}" for i in range(1, VOCAB + 1)]).withColumnRenamed("block_id", "BlockId")
    table = features.tabular_features(inputs.trace_labels(rows), wide, rows)
    return rounded(table.withColumn("ti_std", F.round("ti_std", 4)))


@query("template_text_lookup", """SELECT event_id AS line_id, CASE WHEN event_type <> 'view' THEN 'template of ' || event_type END AS template_text FROM events""")
def template_text_lookup(spark, folder):
    events = inputs.events(spark, folder).select(F.col("line_key").alias("line_id"), F.col("event").alias("event_id"))
    return templates.with_template_text(events, inputs.template_texts(spark)).select("line_id", "template_text")


# --- splits and windows -----------------------------------------------------------------------------


def _split(spark, folder):
    return splits.split_blocks(inputs.labels(inputs.events(spark, folder)))


@query("split_blocks", f"WITH {SPLIT} SELECT block_id, is_anomaly, split FROM sp")
def split_blocks(spark, folder):
    return _split(spark, folder)


@query(
    "split_stratified",
    f"""WITH {LAB}, rk AS (
    SELECT block_id, is_anomaly, row_number() OVER (PARTITION BY is_anomaly ORDER BY md5('42:' || block_id), block_id) - 1 AS r FROM lab),
  c0 AS (SELECT is_anomaly, count(*) AS n FROM lab GROUP BY 1),
  c1 AS (SELECT *, n * ceil(round(sum(n) OVER () * 0.2, 9)) / sum(n) OVER () AS x, ceil(round(sum(n) OVER () * 0.2, 9)) AS w FROM c0),
  c2 AS (SELECT *, floor(x) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, is_anomaly) <= w - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS n_test FROM c1),
  c3 AS (SELECT *, n - n_test AS m, sum(n - n_test) OVER () AS mm FROM c2),
  c4 AS (SELECT *, m * ceil(round(mm * 0.2, 9)) / mm AS y, ceil(round(mm * 0.2, 9)) AS v FROM c3),
  c5 AS (SELECT *, floor(y) + CASE WHEN row_number() OVER (ORDER BY round(y - floor(y), 9) DESC, is_anomaly) <= v - sum(floor(y)) OVER () THEN 1 ELSE 0 END AS n_val FROM c4)
  SELECT block_id, is_anomaly, CASE WHEN r < n_test THEN 'test' WHEN r < n_test + n_val THEN 'val' ELSE 'train' END AS split FROM rk JOIN c5 USING (is_anomaly)""",
)
def split_stratified(spark, folder):
    return splits.split_stratified(inputs.labels(inputs.events(spark, folder)))


WINDOWED = SPLIT + """, wd AS (
  SELECT * FROM (
    SELECT block_id, pos AS start, string_agg(CAST(event AS VARCHAR), ',') OVER (PARTITION BY block_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS "window",
      string_agg(CAST(event AS VARCHAR), ',') OVER (PARTITION BY block_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS target,
      lead(event, 10) OVER (PARTITION BY block_id ORDER BY pos) AS nxt FROM ev) WHERE nxt IS NOT NULL)"""


@query("windows_one_step", f'WITH {WINDOWED} SELECT block_id, start, "window", nxt AS target FROM wd WHERE start % 2 = 0')
def windows_one_step(spark, folder):
    made = windows.make_windows(inputs.events(spark, folder), WINDOW, 2, "one_step")
    return made.select("block_id", "start", joined("window").alias("window"), "target")


@query("windows_many_to_many", f'WITH {WINDOWED} SELECT block_id, start, "window", target FROM wd')
def windows_many_to_many(spark, folder):
    made = windows.make_windows(inputs.events(spark, folder), WINDOW)
    return made.select("block_id", "start", joined("window").alias("window"), joined("target").alias("target"))


@query(
    "windows_large_blocks",
    f"""WITH {LARGE} SELECT block_id, start, "window", target FROM (
    SELECT block_id, pos AS start, string_agg(CAST(event AS VARCHAR), ',') OVER (PARTITION BY block_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS "window",
      string_agg(CAST(event AS VARCHAR), ',') OVER (PARTITION BY block_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS target,
      lead(event, 10) OVER (PARTITION BY block_id ORDER BY pos) AS nxt FROM lb) WHERE nxt IS NOT NULL AND start % 3 = 0""",
)
def windows_large_blocks(spark, folder):
    """Windows across chunk borders of blocks too large for one task."""
    made = windows.make_windows(inputs.large_blocks(spark, folder), WINDOW, 3, size=256, limit=SMALL_LIMIT)
    return made.select("block_id", "start", joined("window").alias("window"), joined("target").alias("target"))


@query("vocab_size", f"WITH {EV} SELECT CAST(max(event) + 1 AS INTEGER) AS vocab_size FROM ev")
def vocab_size(spark, folder):
    return windows.vocabulary_size(windows.make_windows(inputs.events(spark, folder), WINDOW))


@query("window_labels", f"WITH {WINDOWED} SELECT block_id, start, is_anomaly FROM wd JOIN lab USING (block_id)")
def window_labels(spark, folder):
    events = inputs.events(spark, folder)
    made = windows.make_windows(events, WINDOW, labels=inputs.labels(events))
    return made.select("block_id", "start", "is_anomaly")


@query(
    "split_meta",
    f"""WITH {WINDOWED}, a AS (SELECT split, count(*) AS n FROM wd JOIN sp USING (block_id) GROUP BY split), b AS (SELECT split, count(*) AS n, sum(is_anomaly) AS k FROM sp GROUP BY split)
  SELECT 'many_to_many' AS target_mode, 10 AS window_size, 1 AS stride, 5 AS event_vocab_size, 4 AS unknown_event_id,
    max(a.n) FILTER (split = 'train') AS train_windows, max(a.n) FILTER (split = 'val') AS val_windows, max(a.n) FILTER (split = 'test') AS test_windows,
    max(b.n) FILTER (split = 'train') AS train_blocks, max(b.n) FILTER (split = 'val') AS val_blocks, max(b.n) FILTER (split = 'test') AS test_blocks,
    CAST(max(k) FILTER (split = 'val') AS BIGINT) AS val_anomaly_blocks, CAST(max(k) FILTER (split = 'test') AS BIGINT) AS test_anomaly_blocks
  FROM a JOIN b USING (split)""",
)
def split_meta(spark, folder):
    split = _split(spark, folder)
    made = windows.make_windows(inputs.events(spark, folder), WINDOW, split=split)
    return splits.dataset_meta(made, split, VOCAB, "many_to_many", WINDOW, 1)


@query(
    "coverage_unscored",
    """WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS block_id, count(*) AS sequence_len FROM conversations GROUP BY 1)
  SELECT block_id, sequence_len FROM c WHERE sequence_len <= 3""",
)
def coverage_unscored(spark, folder):
    """Conversations too short for a window of three turns."""
    turns = inputs.table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("block_id"),
        F.timestamp_seconds("turn").alias("ts"),
        F.col("turn").alias("line_key"),
        F.length("role").alias("event"),
    )
    lengths = turns.groupBy("block_id").agg(F.count(F.lit(1)).alias("sequence_len"))
    return windows.coverage(lengths, windows.make_windows(turns, 3))


@query(
    "sequence_len_histogram",
    f"""WITH {LAB}, v AS (SELECT block_id, is_anomaly, count(*) AS v FROM ev JOIN lab USING (block_id) GROUP BY ALL),
  b AS (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi, (max(v) - min(v)) / 50.0 AS w FROM v)
  SELECT is_anomaly, bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high, count(*) AS n,
    round(count(*) / (sum(count(*)) OVER (PARTITION BY is_anomaly) * w), 6) AS density
  FROM (SELECT is_anomaly, CAST(least(floor((v - lo) / w), 49) AS INTEGER) AS bin, lo, w FROM v, b) GROUP BY is_anomaly, bin, lo, w""",
)
def sequence_len_histogram(spark, folder):
    events = inputs.events(spark, folder)
    lengths = events.groupBy("block_id").agg(F.count(F.lit(1)).alias("sequence_len")).join(inputs.labels(events), "block_id")
    return rounded(evaluation.histogram(lengths, "sequence_len", ["is_anomaly"], 50))


@query(
    "interval_box",
    f"""WITH {FEAT}, q AS (SELECT is_anomaly, ti_mean AS v, quantile_cont(ti_mean, 0.25) OVER w AS a, quantile_cont(ti_mean, 0.5) OVER w AS m, quantile_cont(ti_mean, 0.75) OVER w AS b
    FROM it JOIN lab USING (block_id) WINDOW w AS (PARTITION BY is_anomaly))
  SELECT is_anomaly, round(a, 6) AS p25, round(m, 6) AS p50, round(b, 6) AS p75,
    round(min(v) FILTER (v BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)), 6) AS whisker_low,
    round(max(v) FILTER (v BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)), 6) AS whisker_high,
    count(*) FILTER (NOT v BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS outliers FROM q GROUP BY is_anomaly, a, m, b""",
)
def interval_box(spark, folder):
    events = inputs.events(spark, folder)
    rows = sequences.interval_features(events).join(inputs.labels(events), "block_id")
    return rounded(evaluation.box_numbers(rows, "ti_mean", ["is_anomaly"]))


@query(
    "nextevent_probs",
    f"WITH {MODEL} SELECT CAST(prev AS INTEGER) AS prev, CAST(next AS INTEGER) AS next, round(-nll, 6) AS log_prob, CAST(rank AS INTEGER) AS rank FROM md",
)
def nextevent_probs(spark, folder):
    train = splits.only_split(inputs.events(spark, folder), _split(spark, folder), "train")
    model = nextevent.fit_next_event(train, VOCAB)
    return rounded(model.probabilities(1).select(F.element_at("context", 1).alias("prev"), "next", "log_prob", "rank"))


@query(
    "markov_trace_score",
    f"""WITH {MODEL} SELECT block_id, round(sum(nll), 6) AS nll_sum, round(max(nll), 6) AS nll_max FROM tr GROUP BY block_id""",
)
def markov_trace_score(spark, folder):
    events, split = inputs.events(spark, folder), _split(spark, folder)
    pairs = transitions.transition_pairs(events)
    train = transitions.transition_pairs(splits.only_split(events, split, "train"))
    return rounded(transitions.markov_scores(pairs, train, VOCAB))


