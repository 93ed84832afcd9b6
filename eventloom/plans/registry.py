"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places``, as on the SQL side."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    """Integers that may be null as doubles, the type both sides hand out alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def joined(column: str) -> F.Column:
    """An array as text."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


# Common table expressions of the SQL side.
EV = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS block_id, ts, event_id AS line_key, event_type, value,
         CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS event,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
  FROM events)"""
LAB = EV + """, lab AS (
  SELECT block_id, CASE WHEN 4 * count(*) FILTER (event = 1) > count(*) THEN 1 ELSE 0 END AS is_anomaly
  FROM ev GROUP BY block_id)"""
PAIR = """pr AS (
  SELECT * FROM (
    SELECT block_id, pos, event AS prev, lead(event) OVER w AS next,
           (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS seconds
    FROM ev WINDOW w AS (PARTITION BY block_id ORDER BY ts, line_key)) WHERE next IS NOT NULL)"""
SPLIT = LAB + """, rk AS (
  SELECT block_id, is_anomaly,
         row_number() OVER (PARTITION BY is_anomaly ORDER BY md5('42:' || block_id), block_id) - 1 AS r,
         count(*) OVER (PARTITION BY is_anomaly) AS n FROM lab),
  sp AS (
  SELECT block_id, is_anomaly,
         CASE WHEN is_anomaly = 0 AND r < floor(n * 0.8) THEN 'train'
              WHEN is_anomaly = 0 AND r < floor(n * 0.8) + floor(n * 0.1) THEN 'val'
              WHEN is_anomaly = 1 AND r < floor(n * 0.3) THEN 'val' ELSE 'test' END AS split
  FROM rk)"""
MODEL = SPLIT + ", " + PAIR + """, cn AS (
  SELECT prev, next, count(*) AS c FROM pr JOIN sp USING (block_id) WHERE split = 'train' GROUP BY ALL),
  md AS (
  SELECT p.range AS prev, n.range AS next, coalesce(c, 0) AS c,
         -ln((coalesce(c, 0) + 1.0) / (coalesce(sum(c) OVER (PARTITION BY p.range), 0) + 5.0)) AS nll,
         row_number() OVER (PARTITION BY p.range ORDER BY coalesce(c, 0) DESC, n.range) AS rank
  FROM range(5) p CROSS JOIN range(5) n LEFT JOIN cn ON cn.prev = p.range AND cn.next = n.range),
  tr AS (
  SELECT block_id, pos, nll, CASE WHEN rank > 3 THEN 1 ELSE 0 END AS miss FROM pr JOIN md USING (prev, next))"""
WINS = MODEL + """, wn AS (
  SELECT a.block_id, a.pos AS start, b.pos - a.pos AS j, b.nll, b.miss
  FROM tr a JOIN tr b ON a.block_id = b.block_id AND b.pos BETWEEN a.pos AND a.pos + 9
  QUALIFY count(*) OVER (PARTITION BY a.block_id, a.pos) = 10)"""
WSCORE = WINS + """, ws AS (
  SELECT block_id, start, CAST(max(miss) FILTER (j = 9) AS DOUBLE) AS topk_last, avg(miss) AS topk_all,
         avg(miss) FILTER (j >= 7) AS topk_last3, avg(nll) AS nll_mean, max(nll) AS nll_max
  FROM wn GROUP BY block_id, start)"""
SCORES = """sc AS (
  SELECT 'm' || m AS model, CASE WHEN doc_id % 2 = 0 THEN 'val' ELSE 'test' END AS split,
         CAST(doc_id AS VARCHAR) AS block_id, toxic AS y_true, (doc_id * m % 101) / 100.0 AS score,
         doc_id % 17 + 1 AS num_windows
  FROM labels, (VALUES (37), (53), (71)) v(m))"""
CURVE = SCORES + """, pt AS (
  SELECT model, split, score, count(*) AS n, sum(y_true) AS pos FROM sc GROUP BY ALL),
  cv AS (
  SELECT model, split, score AS threshold, pos,
         sum(n) OVER w AS predicted, sum(pos) OVER w AS tp,
         sum(n) OVER (PARTITION BY model, split) AS n_all, sum(pos) OVER (PARTITION BY model, split) AS p_all
  FROM pt WINDOW w AS (PARTITION BY model, split ORDER BY score DESC)),
  sw AS (
  SELECT model, split, threshold, pos, p_all, tp / predicted AS precision, tp / p_all AS recall,
         2.0 * tp / (predicted + p_all) AS f1, (predicted - tp) / (n_all - p_all) AS fpr
  FROM cv)"""
CHOSEN = CURVE + """, th AS (
  SELECT model, max(threshold) AS threshold, max(best) AS best_f1 FROM (
    SELECT *, max(f1) OVER (PARTITION BY model) AS best FROM sw WHERE split = 'val') WHERE f1 = best GROUP BY model),
  ty AS (
  SELECT sc.*, th.threshold, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS y_pred,
         CASE WHEN y_true = 0 AND score >= threshold THEN 'FP' WHEN y_true = 1 AND score < threshold THEN 'FN'
              WHEN y_true = 1 THEN 'TP' ELSE 'TN' END AS error_type
  FROM sc JOIN th USING (model)),
  cf AS (
  SELECT model, split, threshold, count(*) FILTER (error_type = 'TN') AS tn, count(*) FILTER (error_type = 'FP') AS fp,
         count(*) FILTER (error_type = 'FN') AS fn, count(*) FILTER (error_type = 'TP') AS tp
  FROM ty GROUP BY ALL),
  mt AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
         2.0 * tp / (2 * tp + fp + fn) AS f1, fp / (fp + tn) AS fpr
  FROM cf),
  ap AS (SELECT model, split, sum(pos / p_all * precision) AS average_precision FROM sw GROUP BY ALL),
  mx AS (SELECT mt.*, average_precision FROM mt JOIN ap USING (model, split))"""
HIST = """hi AS (
  SELECT event_id AS id, user_id AS profile_id, ts AS created_at, value AS processing_ms,
         CASE WHEN event_type = 'error' THEN 422 ELSE 200 END AS status_code,
         CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS num_log_lines
  FROM events)"""
PROF = """pf AS (
  SELECT c_custkey AS id, lower(c_name) || '@example.com' AS email,
         CASE WHEN c_acctbal >= 0 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'ADMIN' ELSE 'USER' END AS role FROM customer)"""
LINE = """ln AS (
  SELECT event_id, user_id, event_type, ts,
         strftime(ts, '%y%m%d') AS d, strftime(ts, '%H%M%S') AS t, CAST(event_id % 500 AS VARCHAR) AS pid,
         regexp_extract(props, '"k": ([0-9]+)', 1) AS k, CAST(event_id * 7 % 65536 AS VARCHAR) AS sz,
         'blk_' || user_id AS blk FROM events),
  lc AS (
  SELECT *, CASE event_type
      WHEN 'click' THEN 'Receiving block ' || blk || ' src: /10.250.' || k || '.1:50010'
      WHEN 'error' THEN 'Exception in block ' || blk || ' mirror 10.250.' || k || '.2:50010 failed'
      WHEN 'purchase' THEN 'Received block ' || blk || ' of size ' || sz || ' from /10.250.' || k || '.3'
      WHEN 'signup' THEN 'Updated map: 10.250.' || k || '.4 is added to ' || blk || ' size ' || sz
      ELSE 'Served block ' || blk || ' to /10.250.' || k || '.5' END AS content FROM ln),
  ll AS (SELECT *, d || ' ' || t || ' ' || pid || ' INFO dfs.DataNode: ' || content AS line FROM lc)"""
