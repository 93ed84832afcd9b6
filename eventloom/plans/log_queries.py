"""Queries over raw log lines, templates and requests made of them."""

from __future__ import annotations


from pyspark.sql import functions as F

from eventloom.functions.text import mask, run_name_parts
from eventloom.operators import logs, requests, sequences, splits, templates
from eventloom.plans import flows, inputs
from eventloom.plans.registry import LINE, SPLIT, as_double, joined, query, rounded
from eventloom.session import cut_lineage, fresh_dir
from eventloom.sources import requests as stored_requests
from eventloom.sources.logs import block_lines, read_log_lines


@query(
    "log_parse_fields",
    f"""WITH {LINE} SELECT event_id, d AS date, t AS time, pid, 'INFO' AS level, 'dfs.DataNode' AS component, content FROM ll""",
)
def log_parse_fields(spark, folder):
    parsed = logs.parse_lines(inputs.log_lines(spark, folder))
    return parsed.select("event_id", "date", "time", "pid", "level", "component", "content")


@query("log_content_fallback", """SELECT doc_id,
  CASE WHEN regexp_matches(t, p) THEN regexp_extract(t, p, 6) ELSE t END AS content
  FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t,
    '^(.+?)\\s+(.+?)\\s+(.+?)\\s+(.+?)\\s+(.+?):\\s+(.+?)$' AS p FROM documents) ORDER BY doc_id""")
def log_content_fallback(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", F.col("text").alias("line"))
    return logs.parse_lines(docs).select("doc_id", "content")


@query("log_block_id", f"""WITH {LINE} SELECT event_id, regexp_extract(content, '(blk_[A-Za-z0-9_-]+)', 1) AS block_id FROM ll""")
def log_block_id(spark, folder):
    return logs.parse_lines(inputs.log_lines(spark, folder)).select("event_id", "block_id")


@query("log_timestamp", f"""WITH {LINE} SELECT event_id, CAST(epoch_us(date_trunc('second', ts)) / 1000000 AS BIGINT) AS epoch FROM ll""")
def log_timestamp(spark, folder):
    parsed = logs.usable_lines(logs.parse_lines(inputs.log_lines(spark, folder)))
    return parsed.select("event_id", F.unix_timestamp("timestamp").alias("epoch"))


@query(
    "log_mask",
    f"""WITH {LINE}, m1 AS (
  SELECT event_id, regexp_replace(regexp_replace(content, '(^|[^A-Za-z0-9])([0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}})($|[^A-Za-z0-9])', '\\1<:IP:>\\3', 'g'),
     '(^|[^A-Za-z0-9])([-+]?[0-9]+)($|[^A-Za-z0-9])', '\\1<:NUM:>\\3', 'g') AS masked FROM ll)
  SELECT event_id, masked FROM m1""",
)
def log_mask(spark, folder):
    parsed = logs.parse_lines(inputs.log_lines(spark, folder))
    return parsed.select("event_id", mask(F.col("content")).alias("masked"))


@query("block_lines_topn", f"""WITH {LINE} SELECT event_id, line FROM ll WHERE contains(line, 'blk_7') ORDER BY event_id LIMIT 20""")
def block_lines_topn(spark, folder):
    lines = inputs.log_lines(spark, folder)
    return block_lines(lines, "blk_7", 20).select("event_id", "line")


@query(
    "route_lines",
    f"""WITH {SPLIT}, {LINE} SELECT event_id, 'blk_' || block_id AS block_id, split FROM ll JOIN sp ON sp.block_id = CAST(ll.user_id AS VARCHAR)""",
)
def route_lines(spark, folder):
    split = splits.split_blocks(inputs.labels(inputs.events(spark, folder)))
    split = split.withColumn("block_id", F.concat(F.lit("blk_"), F.col("block_id")))
    return logs.route_lines(inputs.log_lines(spark, folder), split).select("event_id", "block_id", "split")


def _written_lines(spark, folder):
    """The log lines as text files in the shared folder, their order being that of the files' names."""
    lines = inputs.log_lines(spark, folder)
    path = fresh_dir(spark, "lines")
    files = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines.repartitionByRange(files, "row_in_split").sortWithinPartitions("row_in_split").select("line").write.text(path)
    return read_log_lines(spark, path)


@query("line_numbers", f"WITH {LINE} SELECT row_number() OVER (ORDER BY event_id) - 1 AS line_no, line FROM ll")
def line_numbers(spark, folder):
    """Numbers over several text files; no line is sorted for them."""
    return logs.number_lines(_written_lines(spark, folder)).select("line_no", "line")


@query(
    "route_first_lines",
    f"""WITH {SPLIT}, {LINE}, f AS (SELECT * FROM ll QUALIFY row_number() OVER (ORDER BY event_id) <= (SELECT count(*) // 2 FROM events))
  SELECT split, blk AS block_id, count(*) AS n_lines, min(line) AS least, max(line) AS most
  FROM f JOIN sp ON sp.block_id = CAST(f.user_id AS VARCHAR) GROUP BY ALL""",
)
def route_first_lines(spark, folder):
    """The first half of the lines of several files, routed to the splits."""
    split = splits.split_blocks(inputs.labels(inputs.events(spark, folder)))
    split = split.withColumn("block_id", F.concat(F.lit("blk_"), F.col("block_id")))
    lines = _written_lines(spark, folder)
    routed = logs.route_lines(lines, split, max_lines=lines.count() // 2)
    return routed.groupBy("split", "block_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line").alias("least"), F.max("line").alias("most"))


@query(
    "run_name_parse",
    """SELECT event_id, CASE WHEN event_id % 10 > 0 THEN CAST(32 * (1 + event_id % 4) AS DOUBLE) END AS embedding_dim,
  CASE WHEN event_id % 10 > 0 THEN CAST(64 * (1 + event_id % 3) AS DOUBLE) END AS hidden_size,
  CASE WHEN event_id % 10 > 0 THEN CAST(1 + event_id % 2 AS DOUBLE) END AS num_layers,
  CASE WHEN event_id % 10 > 0 THEN round((event_id % 3) / 10.0, 6) END AS dropout FROM events""",
)
def run_name_parse(spark, folder):
    n = F.col("event_id")
    name = F.concat(
        F.lit("token_e"), (32 * (1 + n % 4)).cast("string"), F.lit("_h"), (64 * (1 + n % 3)).cast("string"),
        F.lit("_l"), (1 + n % 2).cast("string"), F.lit("_d0"), (n % 3).cast("string"),
    )
    named = inputs.table(spark, folder, "events").select(
        "event_id", F.when(n % 10 > 0, name).otherwise(F.concat(F.lit("other_"), name)).alias("run_name")
    )
    parts = named.select("event_id", run_name_parts(F.col("run_name")).alias("p")).select("event_id", "p.*")
    return rounded(as_double(parts, "embedding_dim", "hidden_size", "num_layers"))


# Masked form of each line kind; mined templates must come out the same.
_KINDS = """kd AS (SELECT * FROM (VALUES
  ('click', 'Receiving block blk_<:NUM:> src: /<:IP:>:<:NUM:>'),
  ('error', 'Exception in block blk_<:NUM:> mirror <:IP:>:<:NUM:> failed'),
  ('purchase', 'Received block blk_<:NUM:> of size <:NUM:> from /<:IP:>'),
  ('signup', 'Updated map: <:IP:> is added to blk_<:NUM:> size <:NUM:>'),
  ('view', 'Served block blk_<:NUM:> to /<:IP:>')) v(event_type, template)),
  ti AS (SELECT event_type, template, count(*) AS messages, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS INTEGER) AS id
  FROM events JOIN kd USING (event_type) GROUP BY ALL)"""


def _parsed(spark, folder):
    parsed = logs.usable_lines(logs.parse_lines(inputs.log_lines(spark, folder)))
    return parsed.withColumn("line_key", F.col("row_in_split"))


@query("template_mining", f"WITH {_KINDS} SELECT id AS event_id, template, messages FROM ti")
def template_mining(spark, folder):
    mined = templates.mine_templates(_parsed(spark, folder))
    return mined.select("event_id", F.array_join("template", " ").alias("template"), "messages")


@query(
    "template_match",
    f"""WITH {_KINDS} SELECT event_id AS line_id, CASE WHEN id < 4 THEN CAST(id AS DOUBLE) END AS cluster_id,
  CASE WHEN id < 4 THEN id ELSE 4 END AS event FROM events JOIN ti USING (event_type)""",
)
def template_match(spark, folder):
    """One mined template is left out, so that its lines find no match and become unknown."""
    # parsed and masked once, then mined and matched
    worded = cut_lineage(
        _parsed(spark, folder).select(
            F.col("event_id").alias("line_id"), "timestamp", "line_key", templates.masked_tokens(F.col("content")).alias("tokens")
        )
    )
    mined = cut_lineage(templates.mine_templates(worded, words="tokens"))
    kept = mined.filter(F.col("event_id") < 4)
    matched = templates.match_templates(worded, kept)
    vocabulary = kept.select(F.col("event_id").cast("string").alias("label"), "event_id").unionByName(
        kept.agg(F.lit("unknown").alias("label"), F.count(F.lit(1)).cast("int").alias("event_id"))
    )
    known = templates.to_event_ids(matched, vocabulary)
    return as_double(known.select("line_id", "cluster_id", F.col("event_id").alias("event")), "cluster_id")


@query(
    "template_match_many",
    """SELECT l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line,
  CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_orderkey * 10 AS DOUBLE) WHEN bool_or(l_returnflag <> 'A') OVER (PARTITION BY l_orderkey, l_linenumber) THEN CAST(l_orderkey * 10 + l_linenumber AS DOUBLE) END AS cluster_id
  FROM lineitem""",
)
def template_match_many(spark, folder):
    """A template for almost every order line, and a wider one for every fourth order, which goes first."""
    lines = inputs.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("bigint").alias("order_key"), F.col("l_linenumber").cast("bigint").alias("line"), "l_returnflag"
    )
    order, line = F.concat(F.lit("o"), F.col("order_key").cast("string")), F.concat(F.lit("l"), F.col("line").cast("string"))
    wild, words = F.lit(templates.WILDCARD), [F.lit(w) for w in ("order", "line", "shipped", "by")]
    narrow = lines.where("l_returnflag <> 'A'").select(
        (F.col("order_key") * 10 + F.col("line")).alias("event_id"), F.array(words[0], order, words[1], line, words[2], words[3], wild).alias("template")
    ).distinct()
    wide = lines.where("order_key % 4 = 0").select("order_key").distinct().select(
        (F.col("order_key") * 10).alias("event_id"), F.array(words[0], order, words[1], wild, words[2], words[3], wild).alias("template")
    )
    messages = lines.select("order_key", "line", F.array(words[0], order, words[1], line, words[2], words[3], F.col("l_returnflag")).alias("tokens"))
    matched = templates.match_templates(messages, narrow.unionByName(wide))
    return as_double(matched.select("order_key", "line", "cluster_id"), "cluster_id")


@query(
    "dense_event_ids",
    """WITH f AS (SELECT event_type AS label, min(event_id) AS k FROM events GROUP BY 1),
  r AS (SELECT label, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS event_id FROM f)
  SELECT * FROM r UNION ALL SELECT 'unknown', CAST(count(*) AS INTEGER) FROM f""",
)
def dense_event_ids(spark, folder):
    return templates.dense_ids(inputs.table(spark, folder, "events"), "event_type", "event_id")


@query(
    "template_mining_wildcards",
    """WITH w AS (
  SELECT event_type || ' by user u' || user_id || ' with code c' || event_id % 7 || ' done' AS content, event_type, event_id FROM events),
  t AS (SELECT event_type, count(*) AS messages, min(event_id) AS k, count(DISTINCT content) AS n FROM w GROUP BY 1)
  SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS event_id, event_type || ' by user <*> with code <*> done' AS template, messages
  FROM t""",
)
def template_mining_wildcards(spark, folder):
    """Messages with two variable words, over all events: the words give way to wildcards."""
    raw = inputs.table(spark, folder, "events")
    content = F.concat(
        "event_type", F.lit(" by user u"), F.col("user_id").cast("string"), F.lit(" with code c"), (F.col("event_id") % 7).cast("string"), F.lit(" done")
    )
    mined = templates.mine_templates(raw.select(F.split(content, " ").alias("tokens"), "event_id"), words="tokens", order=["event_id"])
    return mined.select("event_id", F.array_join("template", " ").alias("template"), "messages")


_LEADS = "translate(CAST(user_id AS VARCHAR), '0123456789', 'abcdefghij')"


@query(
    "template_mining_many_children",
    f"""WITH w AS (SELECT {_LEADS} AS lead, event_type, event_id FROM events),
  f AS (SELECT lead, row_number() OVER (ORDER BY min(event_id)) AS place FROM w GROUP BY lead),
  r AS (SELECT w.*, CASE WHEN place < 20 THEN lead END AS own FROM w JOIN f USING (lead)),
  t AS (
  SELECT own, min(event_id) AS k, count(*) AS messages, CASE WHEN count(DISTINCT lead) > 1 THEN '<*>' ELSE min(lead) END AS lead,
    CASE WHEN count(DISTINCT event_type) > 1 THEN '<*>' ELSE min(event_type) END AS type FROM r GROUP BY own)
  SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS event_id, lead || ' did task ' || type || ' fine' AS template, messages FROM t""",
)
def template_mining_many_children(spark, folder):
    """More leading words than a node has branches: the first ones keep their own, the rest share the wildcard's."""
    raw = inputs.table(spark, folder, "events")
    lead = F.translate(F.col("user_id").cast("string"), "0123456789", "abcdefghij")
    words = F.array(lead, F.lit("did"), F.lit("task"), F.col("event_type"), F.lit("fine"))
    mined = templates.mine_templates(raw.select(words.alias("tokens"), "event_id"), words="tokens", order=["event_id"], children=20)
    return mined.select("event_id", F.array_join("template", " ").alias("template"), "messages")


@query(
    "template_leaf_sizes",
    f"""WITH {_KINDS} SELECT CAST(len(string_split(template, ' ')) AS VARCHAR) || ' ' || string_split(template, ' ')[1] AS leaf,
  CAST(sum(messages) AS BIGINT) AS messages, count(*) AS distinct_messages FROM ti GROUP BY 1""",
)
def template_leaf_sizes(spark, folder):
    return templates.leaf_sizes(_parsed(spark, folder))


# --- requests made of log lines ---------------------------------------------------------------------

REQUEST_THRESHOLD = 1.8


def request_scorer(spark, folder):
    """Templates and model fitted on the lines of training blocks, as a user would before scoring."""
    split = splits.split_blocks(inputs.labels(inputs.events(spark, folder)))
    split = split.withColumn("block_id", F.concat(F.lit("blk_"), F.col("block_id")))
    return flows.fit_scorer(inputs.log_lines(spark, folder), split, REQUEST_THRESHOLD)


_SCORED = f"""WITH {SPLIT}, rq AS (
  SELECT block_id, pos, event, CAST(floor(pos / 50) AS BIGINT) AS part FROM ev),
  tp AS (
  SELECT block_id, e AS prev, lead(e) OVER (PARTITION BY block_id ORDER BY pos) AS next FROM (
    SELECT block_id, pos, event AS e FROM ev JOIN sp USING (block_id) WHERE split = 'train')),
  cn AS (SELECT prev, next, count(*) AS c FROM tp WHERE next IS NOT NULL GROUP BY ALL),
  tt AS (SELECT prev, sum(c) AS t FROM cn GROUP BY prev),
  sr AS (
  SELECT block_id, part, pos, event AS prev, lead(event) OVER (PARTITION BY block_id, part ORDER BY pos) AS next,
         count(*) OVER (PARTITION BY block_id, part) AS n FROM rq),
  nl AS (
  SELECT block_id, part, n, max(-ln((coalesce(c, 0) + 1.0) / (coalesce(t, 0) + 6.0))) AS top
  FROM sr LEFT JOIN cn USING (prev, next) LEFT JOIN tt USING (prev) WHERE sr.next IS NOT NULL OR n = 1 GROUP BY ALL),
  re AS (
  SELECT block_id || '-' || part AS request_id, CAST(n AS INTEGER) AS num_log_lines,
         CASE WHEN CAST(block_id AS BIGINT) % 10 = 0 THEN 'blk_absent' ELSE 'blk_' || block_id END AS wanted,
         CAST(block_id AS BIGINT) AS u, n, greatest(n - 10, 0) AS w, top FROM nl)"""


@query(
    "request_outcomes",
    _SCORED + f""" SELECT request_id, wanted AS block_id, CASE WHEN ok THEN 200 ELSE 422 END AS status_code, num_log_lines,
  CASE WHEN ok THEN CAST(n AS DOUBLE) END AS num_events, CASE WHEN ok THEN CAST(w AS DOUBLE) END AS num_windows, CASE WHEN ok THEN round(top, 6) END AS score,
  CASE WHEN ok THEN {REQUEST_THRESHOLD} END AS threshold, CASE WHEN ok THEN CAST(top >= {REQUEST_THRESHOLD} AS DOUBLE) END AS is_anomaly,
  CASE WHEN NOT ok THEN 'model couldn''t process data' END AS error_message
  FROM (SELECT *, wanted <> 'blk_absent' AND w > 0 AS ok FROM re)""",
)
def request_outcomes(spark, folder):
    scored = requests.score_requests(inputs.requests(spark, folder), request_scorer(spark, folder))
    return rounded(as_double(requests.outcomes(scored), "num_events", "num_windows", "is_anomaly"))


@query(
    "request_scores",
    _SCORED + """ SELECT request_id, round(CASE WHEN ok THEN top END, 6) AS score,
  CASE WHEN n < 2 THEN 'no_sequence' WHEN wanted = 'blk_absent' THEN 'block_not_found' WHEN NOT ok THEN 'too_short' END AS reason,
  CASE WHEN ok AND u % 2 = 0 THEN CAST(n AS DOUBLE) END AS event_ids, CASE WHEN ok AND u % 3 = 0 THEN CAST(w AS DOUBLE) END AS window_scores
  FROM (SELECT *, wanted <> 'blk_absent' AND w > 0 AS ok FROM re)""",
)
def request_scores(spark, folder):
    scored = requests.score_requests(inputs.requests(spark, folder), request_scorer(spark, folder))
    return rounded(
        scored.select(
            "request_id",
            "score",
            "reason",
            F.when(F.col("event_ids").isNotNull(), F.size("event_ids").cast("double")).alias("event_ids"),
            F.when(F.col("window_scores").isNotNull(), F.size("window_scores").cast("double")).alias("window_scores"),
        )
    )




@query(
    "line_sequences",
    f"""WITH {SPLIT}, {_KINDS}, q AS (SELECT * FROM ev JOIN ti USING (event_type)),
  f AS (SELECT event_type, CAST(row_number() OVER (ORDER BY min(pos_ts), min(line_key)) - 1 AS INTEGER) AS e FROM (
    SELECT event_type, date_trunc('second', ts) AS pos_ts, line_key, block_id FROM ev) JOIN sp USING (block_id) WHERE split = 'train' GROUP BY 1)
  SELECT 'blk_' || block_id AS block_id, split, string_agg(CAST(e AS VARCHAR), ',' ORDER BY pos) AS sequence
  FROM ev JOIN f USING (event_type) JOIN sp USING (block_id) GROUP BY ALL HAVING count(*) >= 2""",
)
def line_sequences(spark, folder):
    """From raw lines to labelled sequences: split, mine on training lines, match, order."""
    split = splits.split_blocks(inputs.labels(inputs.events(spark, folder)))
    split = split.withColumn("block_id", F.concat(F.lit("blk_"), F.col("block_id")))
    table = flows.event_table(inputs.log_lines(spark, folder), split)
    built = splits.tag_split(sequences.build_sequences(table.events), split)
    return built.select("block_id", "split", joined("sequence").alias("sequence"))


@query(
    "line_sequences_many_files",
    f"""WITH {SPLIT}, {_KINDS},
  pl AS (SELECT block_id, event_type, date_trunc('second', ts) AS s, 2 - line_key % 3 AS file, line_key FROM ev),
  f AS (SELECT event_type, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS e FROM (
    SELECT event_type, min((s, file, line_key)) AS k FROM pl JOIN sp USING (block_id) WHERE split = 'train' GROUP BY 1))
  SELECT 'blk_' || block_id AS block_id, split, string_agg(CAST(e AS VARCHAR), ',' ORDER BY s, file, line_key) AS sequence
  FROM pl JOIN f USING (event_type) JOIN sp USING (block_id) GROUP BY ALL HAVING count(*) >= 2""",
)
def line_sequences_many_files(spark, folder):
    """The same over three files that lie interleaved in the order of rows: file order decides among lines of one second."""
    split = splits.split_blocks(inputs.labels(inputs.events(spark, folder)))
    split = split.withColumn("block_id", F.concat(F.lit("blk_"), F.col("block_id")))
    lines = inputs.log_lines(spark, folder)
    dealt = lines.withColumn("file", F.concat(F.lit("file-"), (2 - F.col("row_in_split") % 3).cast("string")))
    table = flows.event_table(dealt, split)
    built = splits.tag_split(sequences.build_sequences(table.events), split)
    return built.select("block_id", "split", joined("sequence").alias("sequence"))


@query(
    "outcomes_round_trip",
    _SCORED + f""" SELECT request_id, wanted AS block_id, CASE WHEN ok THEN 200 ELSE 422 END AS status_code, num_log_lines, u AS profile_id,
  1704067200 + 3600 * (u % 100) AS created_at, u / 2.0 AS processing_ms,
  CASE WHEN ok THEN CAST(n AS DOUBLE) END AS num_events, CASE WHEN ok THEN round(top, 6) END AS score
  FROM (SELECT *, wanted <> 'blk_absent' AND w > 0 AS ok FROM re)""",
)
def outcomes_round_trip(spark, folder):
    """Scored requests, stored as history and read back. Storing them twice changes nothing."""
    asked = inputs.requests(spark, folder)
    user = F.split("request_id", "-")[0].cast("bigint")
    hour = F.timestamp_seconds(F.lit(1704067200) + (user % 100) * 3600)
    facts = asked.select("request_id", user.alias("profile_id"), hour.alias("created_at"), (user / 2).alias("processing_ms"))
    rows = requests.outcomes(requests.score_requests(asked, request_scorer(spark, folder)), facts)
    path = fresh_dir(spark, "history")
    for _ in range(2):
        stored_requests.append_outcomes(rows, path)
    back = stored_requests.read_history(spark, path)
    shown = back.select("request_id", "block_id", "status_code", "num_log_lines", "profile_id", F.unix_timestamp("created_at").alias("created_at"), "processing_ms", "num_events", "score")
    return rounded(as_double(shown, "num_events"))
