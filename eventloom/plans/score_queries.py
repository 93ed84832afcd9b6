"""Queries over surprise, block scores, thresholds, metrics and runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from eventloom.operators import evaluation, incremental, learners, nextevent, runs, scoring, sequences, splits, windows
from eventloom.operators.features import block_features
from eventloom.plans import flows, inputs
from eventloom.plans.inputs import VOCAB, WINDOW
from eventloom.plans.registry import CHOSEN, CURVE, EV, MODEL, SCORES, SPLIT, WINS, WSCORE, joined, query, rounded
from eventloom.session import cut_lineage


def fitted(spark, folder, order: int = 1):
    """(events, labels, split, model): the model knows training blocks only."""
    events = inputs.events(spark, folder)
    labels = inputs.labels(events)
    split = splits.split_blocks(labels)
    model = nextevent.fit_next_event(splits.only_split(events, split, "train"), VOCAB, order)
    # read for seen cells and for the rest
    return events, labels, split, replace(model, table=cut_lineage(model.table))


def scored_windows(spark, folder, order: int = 1):
    events, labels, _, model = fitted(spark, folder, order)
    return scoring.window_table(events, model, WINDOW), labels


@query("position_nll", f"WITH {MODEL} SELECT block_id, pos, round(nll, 6) AS nll, miss FROM tr")
def position_nll(spark, folder):
    events, _, _, model = fitted(spark, folder)
    rows = nextevent.event_surprise(events, model)
    return rounded(rows.select("block_id", "pos", F.element_at("nll", 1).alias("nll"), F.element_at("miss", 1).alias("miss")))


@query(
    "nextevent_backoff",
    f"""WITH {SPLIT}, p AS (
    SELECT block_id, pos, e AS a, lead(e) OVER w AS b, lead(e, 2) OVER w AS c, lead(e, 3) OVER w AS y
    FROM (SELECT block_id, pos, event + {VOCAB} * (line_key % 7) AS e FROM ev) WINDOW w AS (PARTITION BY block_id ORDER BY pos)),
  tr AS (SELECT * FROM p JOIN sp USING (block_id) WHERE split = 'train'),
  c1 AS (SELECT a AS x, b AS y, count(*) AS n FROM tr WHERE b IS NOT NULL GROUP BY ALL),
  c2 AS (SELECT a AS w, b AS x, c AS y, count(*) AS n FROM tr WHERE c IS NOT NULL GROUP BY ALL),
  c3 AS (SELECT a AS v, b AS w, c AS x, y, count(*) AS n FROM tr WHERE y IS NOT NULL GROUP BY ALL),
  t1 AS (SELECT x, sum(n) AS t FROM c1 GROUP BY ALL), t2 AS (SELECT w, x, sum(n) AS t FROM c2 GROUP BY ALL), t3 AS (SELECT v, w, x, sum(n) AS t FROM c3 GROUP BY ALL),
  e AS (SELECT range AS y FROM range({7 * VOCAB})),
  g AS (
    SELECT p.block_id, p.pos, p.y AS hit, e.y, coalesce(t3.t, t2.t, t1.t, 0) AS t,
      CASE WHEN t3.t IS NOT NULL THEN coalesce(c3.n, 0) WHEN t2.t IS NOT NULL THEN coalesce(c2.n, 0) WHEN t1.t IS NOT NULL THEN coalesce(c1.n, 0) ELSE 0 END AS n
    FROM p CROSS JOIN e
    LEFT JOIN t1 ON t1.x = p.c LEFT JOIN t2 ON t2.w = p.b AND t2.x = p.c LEFT JOIN t3 ON t3.v = p.a AND t3.w = p.b AND t3.x = p.c
    LEFT JOIN c1 ON c1.x = p.c AND c1.y = e.y LEFT JOIN c2 ON c2.w = p.b AND c2.x = p.c AND c2.y = e.y
    LEFT JOIN c3 ON c3.v = p.a AND c3.w = p.b AND c3.x = p.c AND c3.y = e.y
    WHERE p.y IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY block_id, pos ORDER BY n DESC, y) AS rank FROM g)
  SELECT block_id, pos, round(-ln((n + 1.0) / (t + {7 * VOCAB}.0)), 6) AS nll, CASE WHEN rank > 3 THEN 1 ELSE 0 END AS miss FROM r WHERE y = hit""",
)
def nextevent_backoff(spark, folder):
    """Contexts of three events out of a vocabulary in which most of them never occur in training: these fall back to their endings."""
    events, _, split, _ = fitted(spark, folder)
    wide = events.withColumn("event", (F.col("event") + VOCAB * (F.col("line_key") % 7)).cast("int"))
    model = nextevent.fit_next_event(splits.only_split(wide, split, "train"), 7 * VOCAB, 3, backoff=True)
    model = replace(model, table=cut_lineage(model.table))
    rows = nextevent.event_surprise(wide, model)
    return rounded(rows.select("block_id", "pos", F.element_at("nll", 3).alias("nll"), F.element_at("miss", 3).alias("miss")))


@query(
    "block_scores_incremental",
    f"""WITH {MODEL}, l AS (SELECT block_id, count(*) AS events FROM ev GROUP BY 1)
  SELECT block_id, events, round(CASE WHEN events > 10 THEN top END, 6) AS nll_max, round(CASE WHEN events > 10 THEN mean END, 6) AS nll_mean,
    round(CASE WHEN events > 10 THEN p95 END, 6) AS nll_p95, round(CASE WHEN events > 10 THEN missed END, 6) AS topk_all
  FROM l LEFT JOIN (SELECT block_id, max(nll) AS top, avg(nll) AS mean, quantile_disc(nll, 0.95) AS p95, avg(miss) AS missed FROM tr GROUP BY block_id) USING (block_id)""",
)
def block_scores_incremental(spark, folder):
    """Blocks scored in three goes, each with the stored state of the one before: the same as all events at once."""
    events, _, _, model = fitted(spark, folder)
    day = F.dayofmonth("ts")
    state = None
    for now in (day <= 8, (day > 8) & (day <= 21), day > 21):
        added = incremental.block_state(events.where(now), model, state)
        state = cut_lineage(added if state is None else incremental.merge_states(state, added, model.order))
    return rounded(incremental.scores_of_states(state, WINDOW))


@query(
    "window_scores",
    f"""WITH {WSCORE} SELECT block_id, start, topk_last, round(topk_all, 6) AS topk_all, round(topk_last3, 6) AS topk_last3,
  round(nll_mean, 6) AS nll_mean, round(nll_max, 6) AS nll_max FROM ws""",
)
def window_scores(spark, folder):
    rows, _ = scored_windows(spark, folder)
    return rounded(rows.select("block_id", "start", "topk_last", "topk_all", "topk_last3", "nll_mean", "nll_max"))


@query(
    "window_scores_order2",
    f"""WITH {SPLIT}, e3 AS (
    SELECT block_id, pos, event AS a, lead(event) OVER w AS b, lead(event, 2) OVER w AS c FROM ev WINDOW w AS (PARTITION BY block_id ORDER BY pos)),
  t1 AS (SELECT a, b, count(*) AS n FROM e3 JOIN sp USING (block_id) WHERE split = 'train' AND b IS NOT NULL GROUP BY ALL),
  t2 AS (SELECT a, b, c, count(*) AS n FROM e3 JOIN sp USING (block_id) WHERE split = 'train' AND c IS NOT NULL GROUP BY ALL),
  s1 AS (SELECT a, sum(n) AS t FROM t1 GROUP BY a), s2 AS (SELECT a, b, sum(n) AS t FROM t2 GROUP BY a, b),
  x AS (
    SELECT block_id, pos, c, -ln((coalesce(t1.n, 0) + 1.0) / (coalesce(s1.t, 0) + 5.0)) AS n1, -ln((coalesce(t2.n, 0) + 1.0) / (coalesce(s2.t, 0) + 5.0)) AS n2
    FROM e3 LEFT JOIN t1 USING (a, b) LEFT JOIN s1 USING (a) LEFT JOIN t2 USING (a, b, c) LEFT JOIN s2 USING (a, b))
  SELECT p.block_id, p.pos AS start, round((max(n1) FILTER (q.pos = p.pos) + sum(n2)) / 10, 6) AS nll_mean,
    round(greatest(max(n1) FILTER (q.pos = p.pos), max(n2)), 6) AS nll_max
  FROM e3 p JOIN x q ON p.block_id = q.block_id AND q.pos BETWEEN p.pos AND p.pos + 8
  WHERE q.c IS NOT NULL GROUP BY p.block_id, p.pos HAVING count(*) = 9""",
)
def window_scores_order2(spark, folder):
    """Two events of context, one at the start of a window."""
    rows, _ = scored_windows(spark, folder, 2)
    return rounded(rows.select("block_id", "start", "nll_mean", "nll_max"))


@query("topk_miss", f"WITH {WINS} SELECT block_id, start, string_agg(CAST(miss AS VARCHAR), ',' ORDER BY j) AS miss FROM wn GROUP BY ALL")
def topk_miss(spark, folder):
    events, _, _, model = fitted(spark, folder)
    rows = scoring.window_surprise(events, model, WINDOW)
    return rows.select("block_id", "start", joined("miss").alias("miss"))


@query(
    "block_miss_rate",
    f"""WITH {WSCORE} SELECT block_id, is_anomaly AS y_true, round(avg(topk_last), 6) AS score, count(*) AS num_windows,
  CAST(sum(topk_last) AS BIGINT) AS num_misses FROM ws JOIN lab USING (block_id) GROUP BY ALL""",
)
def block_miss_rate(spark, folder):
    return rounded(scoring.miss_rate(*scored_windows(spark, folder)))


#: Shares of windows are decimal fractions that often end in a 5 at the seventh place.
PLACES = {"topk_last": 10, "topk_all": 10, "topk_last3": 10}


def _register_strategy(strategy: str) -> None:
    if strategy == "nll_p95":
        sql = f"""WITH {WINS} SELECT block_id, is_anomaly AS y_true, CAST(count(*) / 10 AS BIGINT) AS num_windows, 'nll_p95' AS strategy,
  round(quantile_cont(nll, 0.95), 6) AS score, round(max(nll), 6) AS window_score_max FROM wn JOIN lab USING (block_id) GROUP BY ALL"""
    else:
        fold = "max" if strategy == "nll_max" else "avg"
        places = PLACES.get(strategy, 6)
        sql = f"""WITH {WSCORE} SELECT block_id, is_anomaly AS y_true, count(*) AS num_windows, '{strategy}' AS strategy,
  round({fold}({strategy}), {places}) AS score, round(max({strategy}), {places}) AS window_score_max FROM ws JOIN lab USING (block_id) GROUP BY ALL"""

    @query(f"block_scores_{strategy}", sql)
    def build(spark, folder):
        events, labels, _, model = fitted(spark, folder)
        return rounded(scoring.score_events(events, model, WINDOW, 1, labels, [strategy]), PLACES.get(strategy, 6))


for _strategy in ("nll_max", "nll_mean", "nll_p95", "topk_last", "topk_all", "topk_last3"):
    _register_strategy(_strategy)


@query("mean_cross_entropy", f"WITH {WINS} SELECT round(avg(nll), 6) AS loss, count(*) AS positions FROM wn")
def mean_cross_entropy(spark, folder):
    rows, _ = scored_windows(spark, folder)
    return rounded(scoring.mean_cross_entropy(rows, WINDOW))


_RANKED = WSCORE + """, bs AS (SELECT block_id, is_anomaly AS y, split, max(nll_max) AS score, count(*) AS n FROM ws JOIN sp USING (block_id) GROUP BY ALL),
  v AS (SELECT score, sum(count(*)) OVER w AS p, sum(sum(y)) OVER w AS t, sum(sum(y)) OVER () AS a FROM bs WHERE split = 'val' GROUP BY score WINDOW w AS (ORDER BY score DESC)),
  th AS (SELECT score AS threshold FROM v ORDER BY round(2.0 * t / (p + a), 12) DESC, score DESC LIMIT 1)"""


@query(
    "anomalous_blocks",
    f"""WITH {_RANKED} SELECT block_id, y AS y_true, n AS num_windows, round(score, 6) AS score, round(threshold, 6) AS threshold FROM bs, th
  WHERE split = 'test' AND score >= threshold""",
)
def anomalous_blocks(spark, folder):
    """From events to a decision: fit on normal blocks, score, choose the threshold on validation, apply to test."""
    events, labels, split, model = fitted(spark, folder)
    # scored once, read twice
    scored = cut_lineage(splits.tag_split(scoring.score_events(events, model, WINDOW, 1, labels, ["nll_max"]), split))
    chosen = evaluation.best_threshold(evaluation.curve(scored.filter(F.col("split") == "val")))
    # one row on the right
    decided = scored.filter(F.col("split") == "test").crossJoin(F.broadcast(chosen.select("threshold")))
    flagged = decided.filter(F.col("score") >= F.col("threshold"))
    return rounded(flagged.select("block_id", "y_true", "num_windows", "score", "threshold").orderBy(F.desc("score"), "block_id"))


# --- metrics over scored tables ---------------------------------------------------------------------

BY = ["model", "split"]


def _curve(spark, folder):
    return evaluation.curve(inputs.model_scores(spark, folder), BY)


def _chosen(spark, folder):
    """(scores with prediction and error type, metrics, thresholds)."""
    scores = inputs.model_scores(spark, folder)
    thresholds, metrics = evaluation.evaluate(scores, ["model"])
    cut = F.broadcast(thresholds.select("model", "threshold"))  # one row per model
    typed = evaluation.with_error_type(scoring.decide(scores.join(cut, "model"), F.col("threshold")))
    return typed, metrics, thresholds


@query(
    "confusion",
    f"""WITH {SCORES} SELECT model, split, count(*) FILTER (y_true = 0 AND score < 0.5) AS tn, count(*) FILTER (y_true = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (y_true = 1 AND score < 0.5) AS fn, count(*) FILTER (y_true = 1 AND score >= 0.5) AS tp FROM sc GROUP BY ALL""",
)
def confusion(spark, folder):
    return evaluation.confusion(scoring.decide(inputs.model_scores(spark, folder), 0.5), BY)


_METRICS = """round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr"""


@query(
    "classification_summary",
    f"WITH {CHOSEN} SELECT model, split, round(threshold, 6) AS threshold, tn, fp, fn, tp, {_METRICS}, round(average_precision, 6) AS average_precision FROM mx",
)
def classification_summary(spark, folder):
    return rounded(_chosen(spark, folder)[1])


@query("average_precision", f"WITH {CHOSEN} SELECT model, split, round(average_precision, 6) AS average_precision FROM ap")
def average_precision(spark, folder):
    return rounded(evaluation.average_precision(_curve(spark, folder), BY))


@query("pr_curve", f"WITH {CURVE} SELECT model, split, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sw")
def pr_curve(spark, folder):
    return rounded(evaluation.pr_curve(_curve(spark, folder), BY))


@query("pr_curve_large", f"WITH {CURVE} SELECT model, split, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sw")
def pr_curve_large(spark, folder):
    """The curve with the plan for more distinct scores than one task should sort."""
    return rounded(evaluation.pr_curve(evaluation.curve(inputs.model_scores(spark, folder), BY, limit=32), BY))


@query(
    "threshold_max_f1",
    f"WITH {CHOSEN} SELECT model, 'max_f1' AS threshold_strategy, threshold, round(best_f1, 6) AS validation_best_f1 FROM th",
)
def threshold_max_f1(spark, folder):
    return rounded(_chosen(spark, folder)[2])


@query("threshold_sweep", f"WITH {CURVE} SELECT model, split, threshold, {_METRICS} FROM sw")
def threshold_sweep(spark, folder):
    return rounded(evaluation.threshold_sweep(_curve(spark, folder), BY))


@query(
    "threshold_best_row",
    f"""WITH {CURVE} SELECT model, split, threshold, {_METRICS} FROM (
    SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY f1 DESC, threshold) AS r FROM sw) WHERE r = 1""",
)
def threshold_best_row(spark, folder):
    return rounded(evaluation.best_row(_curve(spark, folder), BY))


@query(
    "score_quantiles",
    f"WITH {SCORES} SELECT model, y_true, "
    + ", ".join(f"round(quantile_cont(score, {p}), 6) AS {n}" for n, p in evaluation.SCORE_QUANTILES.items())
    + " FROM sc GROUP BY ALL",
)
def score_quantiles(spark, folder):
    return rounded(evaluation.score_quantiles(inputs.model_scores(spark, folder), ["model", "y_true"]))


@query(
    "score_quantiles_pivot",
    f"WITH {SCORES} "
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS quantile, round(quantile_cont(score, {p}) FILTER (y_true = 0), 6) AS normal, round(quantile_cont(score, {p}) FILTER (y_true = 1), 6) AS anomaly
  FROM sc WHERE model = 'm37'"""
        for n, p in evaluation.SCORE_QUANTILES.items()
    ),
)
def score_quantiles_pivot(spark, folder):
    scores = inputs.model_scores(spark, folder).filter(F.col("model") == "m37")
    return rounded(evaluation.score_quantiles_pivoted(scores))


@query(
    "score_histogram",
    f"""WITH {SCORES}, b AS (SELECT min(score) AS lo, quantile_cont(score, 0.995) AS hi, (quantile_cont(score, 0.995) - min(score)) / 49 AS w FROM sc)
  SELECT y_true, bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high, count(*) AS n,
    round(count(*) / (sum(count(*)) OVER (PARTITION BY y_true) * w), 6) AS density
  FROM (SELECT y_true, CAST(least(floor((least(score, hi) - lo) / w), 48) AS INTEGER) AS bin, lo, w FROM sc, b) GROUP BY y_true, bin, lo, w""",
)
def score_histogram(spark, folder):
    return rounded(evaluation.histogram(inputs.model_scores(spark, folder), "score", ["y_true"], 49, 0.995))


@query(
    "error_types",
    f"""WITH {CHOSEN} SELECT model, place, k.error_type, count(ty.block_id) AS blocks
  FROM (SELECT DISTINCT model FROM ty) m CROSS JOIN (VALUES (0, 'TN'), (1, 'FP'), (2, 'FN'), (3, 'TP')) k(place, error_type)
  LEFT JOIN (SELECT * FROM ty WHERE split = 'test') ty USING (model, error_type) GROUP BY ALL""",
)
def error_types(spark, folder):
    return evaluation.error_counts(_test_errors(spark, folder), ["model"])


def _test_errors(spark, folder):
    typed, _, _ = _chosen(spark, folder)
    return typed.filter(F.col("split") == "test")


@query(
    "error_summary",
    f"""WITH {CHOSEN} SELECT model, place, k.error_type, count(ty.block_id) AS blocks, round(avg(score), 6) AS score_mean, round(quantile_cont(score, 0.5), 6) AS score_median,
    round(quantile_cont(CAST(num_windows AS DOUBLE), 0.5), 6) AS windows_median, round(quantile_cont(CAST(num_windows AS DOUBLE), 0.95), 6) AS windows_p95
  FROM (SELECT DISTINCT model FROM ty) m CROSS JOIN (VALUES (0, 'TN'), (1, 'FP'), (2, 'FN'), (3, 'TP')) k(place, error_type)
  LEFT JOIN (SELECT * FROM ty WHERE split = 'test') ty USING (model, error_type) GROUP BY ALL""",
)
def error_summary(spark, folder):
    return rounded(evaluation.error_summary(_test_errors(spark, folder), by=["model"]))


@query(
    "top_fp",
    f"""WITH {CHOSEN} SELECT model, block_id, score, num_windows FROM ty WHERE split = 'test' AND error_type = 'FP'
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY score DESC, num_windows DESC, block_id) <= 15""",
)
def top_fp(spark, folder):
    return evaluation.top_false_positives(_test_errors(spark, folder), by=["model"]).select("model", "block_id", "score", "num_windows")


@query(
    "top_fn",
    f"""WITH {CHOSEN} SELECT model, block_id, score, num_windows FROM ty WHERE split = 'test' AND error_type = 'FN'
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY score, num_windows DESC, block_id) <= 15""",
)
def top_fn(spark, folder):
    return evaluation.top_false_negatives(_test_errors(spark, folder), by=["model"]).select("model", "block_id", "score", "num_windows")


@query(
    "metrics_val_vs_test",
    f"WITH {CHOSEN} SELECT v.model, "
    + ", ".join(
        f"round(v.{m}, 6) AS {m}_val, round(t.{m}, 6) AS {m}_test, round(t.{m} - v.{m}, 6) AS {m}_diff_test_minus_val" for m in evaluation.COMPARED
    )
    + " FROM mx v JOIN mx t ON v.model = t.model AND v.split = 'val' AND t.split = 'test'",
)
def metrics_val_vs_test(spark, folder):
    return rounded(evaluation.compare_splits(_chosen(spark, folder)[1]))


@query(
    "metrics_pivot",
    f"""WITH {CHOSEN} SELECT model AS run_name, round(max(f1) FILTER (split = 'val'), 6) AS val_f1, round(max(average_precision) FILTER (split = 'val'), 6) AS val_average_precision,
    round(max(fpr) FILTER (split = 'val'), 6) AS val_fpr, round(max(f1) FILTER (split = 'test'), 6) AS test_f1,
    round(max(average_precision) FILTER (split = 'test'), 6) AS test_average_precision, round(max(fpr) FILTER (split = 'test'), 6) AS test_fpr,
    round(max(f1) FILTER (split = 'val') - max(f1) FILTER (split = 'test'), 6) AS f1_gap FROM mx GROUP BY model""",
)
def metrics_pivot(spark, folder):
    return rounded(runs.metrics_pivot(_chosen(spark, folder)[1].withColumnRenamed("model", "run_name")))


@query(
    "run_ranking",
    f"""WITH {CHOSEN} SELECT model, CAST(rank() OVER (ORDER BY f1 DESC) AS INTEGER) AS rank_by_f1, CAST(rank() OVER (ORDER BY average_precision DESC) AS INTEGER) AS rank_by_ap,
    CAST(rank() OVER (ORDER BY fpr) AS INTEGER) AS rank_by_fpr FROM mx WHERE split = 'test'""",
)
def run_ranking(spark, folder):
    test = _chosen(spark, folder)[1].filter(F.col("split") == "test")
    return runs.rank_runs(test).select("model", "rank_by_f1", "rank_by_ap", "rank_by_fpr")


@query(
    "metrics_union",
    f"""WITH {SCORES} SELECT split, model, count(*) AS blocks, CASE WHEN split = 'test' THEN round(avg(score), 6) END AS score_mean FROM sc GROUP BY split, model""",
)
def metrics_union(spark, folder):
    scores = inputs.model_scores(spark, folder)
    count = F.count(F.lit(1)).alias("blocks")
    val = scores.filter(F.col("split") == "val").groupBy("model").agg(count)
    test = scores.filter(F.col("split") == "test").groupBy("model").agg(count, F.avg("score").alias("score_mean"))
    return rounded(runs.union_runs({"val": val, "test": test}))


_HISTORY = EV + """, h AS (SELECT block_id AS run_name, pos + 1 AS epoch, value AS val_loss FROM ev),
  m AS (SELECT *, min(val_loss) OVER (PARTITION BY run_name ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low, max(epoch) OVER (PARTITION BY run_name) AS last FROM h),
  b AS (SELECT *, coalesce(lead(epoch) OVER (PARTITION BY run_name ORDER BY epoch), last + 1) AS nxt FROM m WHERE low IS NULL OR val_loss < low)"""


def _history(spark, folder):
    rows = inputs.table(spark, folder, "events").select(F.col("user_id").cast("string").alias("run_name"), "ts", "event_id", F.col("value").alias("val_loss"))
    from eventloom.operators.ordered import positions

    return positions(rows, ["run_name"], ["ts", "event_id"]).withColumn("epoch", F.col("pos") + 1)


@query(
    "best_epoch",
    f"WITH {_HISTORY} SELECT run_name, max(epoch) AS best_epoch, min(val_loss) AS best_val_loss, max(last) AS epochs_ran FROM b GROUP BY run_name",
)
def best_epoch(spark, folder):
    return runs.best_epochs(_history(spark, folder))


@query(
    "early_stopping",
    f"""WITH {_HISTORY}, s AS (SELECT run_name, coalesce(min(epoch + 2) FILTER (nxt - epoch > 2), max(last)) AS epochs_ran FROM b GROUP BY run_name)
  SELECT run_name, max(epoch) AS best_epoch, min(val_loss) AS best_val_loss, max(epochs_ran) AS epochs_ran FROM b JOIN s USING (run_name) WHERE epoch <= epochs_ran GROUP BY run_name""",
)
def early_stopping(spark, folder):
    return runs.best_epochs(_history(spark, folder), patience=2)


# --- learned models ---------------------------------------------------------------------------------

FEATURES = [f"E{i}" for i in range(1, VOCAB + 1)] + ["sequence_len", "latency", "ti_mean", "ti_max", "ti_std", "ti_zeros"]


def feature_split(spark, folder):
    """Features with their stratified split, written once because fitting reads them repeatedly."""
    events = inputs.events(spark, folder)
    labels = inputs.labels(events)
    counts = sequences.occurrence_matrix(events.withColumn("event", F.col("event") + 1), range(1, VOCAB + 1), prefix="E")
    table = block_features(counts, sequences.interval_features(events), labels, FEATURES[:VOCAB])
    return cut_lineage(splits.tag_split(table, splits.split_stratified(labels)))


@query("logistic_scores")
def logistic_scores(spark, folder):
    table = feature_split(spark, folder)
    train = table.filter(F.col("split") == "train")
    model = learners.fit_weighted(learners.logistic_regression(FEATURES, train.count()), train)
    return learners.positive_probability(model, table, ["block_id", "split", "y"])


@query("forest_scores")
def forest_scores(spark, folder):
    table = feature_split(spark, folder)
    model = learners.fit_weighted(learners.random_forest(FEATURES), table.filter(F.col("split") == "train"))
    return learners.positive_probability(model, table, ["block_id", "split", "y"])


@query("feature_importance")
def feature_importance(spark, folder):
    table = feature_split(spark, folder)
    train = table.filter(F.col("split") == "train")
    model = learners.fit_weighted(learners.logistic_regression(FEATURES, train.count()), train)
    return learners.importance_table(model, table, FEATURES)


@query("isolation_scores")
def isolation_scores(spark, folder):
    table = feature_split(spark, folder)
    normal = table.filter((F.col("split") == "train") & (F.col("y") == 0))
    forest = learners.fit_isolation_forest(normal, FEATURES, "block_id")
    return learners.isolation_scores(forest, table, ["block_id", "split", "y"])


@query("mlp_scores")
def mlp_scores(spark, folder):
    events, _, split, _ = fitted(spark, folder)
    made = cut_lineage(windows.make_windows(events, WINDOW, 1, "one_step", split=split))
    model, _ = learners.window_perceptron(made.filter(F.col("split") == "train"), VOCAB, WINDOW)
    scored = learners.perceptron_log_probs(model, learners.encode_windows(made, VOCAB))
    nll = -F.element_at("log_probs", F.col("target") + 1)
    return scored.groupBy("block_id").agg(F.max(nll).alias("score"), F.count(F.lit(1)).alias("num_windows"))


@query("external_model_scores", f"""WITH {SPLIT}, t AS (SELECT block_id, pos, event, lead(event) OVER (PARTITION BY block_id ORDER BY pos) AS nxt FROM ev),
  w AS (SELECT a.block_id, a.pos, avg(-ln(CASE WHEN b.nxt = b.event THEN exp(1.0) ELSE 1.0 END / (exp(1.0) + 4))) AS s, count(*) AS n
    FROM t a JOIN t b ON a.block_id = b.block_id AND b.pos BETWEEN a.pos AND a.pos + 9 WHERE b.nxt IS NOT NULL GROUP BY ALL HAVING count(*) = 10)
  SELECT block_id, count(*) AS num_windows, round(avg(s), 6) AS score FROM w GROUP BY block_id""")
def external_model_scores(spark, folder):
    """Logits from a caller's network (here one that expects the last event again)."""
    made = windows.make_windows(inputs.events(spark, folder), WINDOW)
    scored = nextevent.score_logits(nextevent.predict_logits(made, _repeat_last))
    return rounded(scoring.score_blocks(scored, None, ["nll_mean"]).select("block_id", "num_windows", "score"))


def _repeat_last(batch):
    import numpy as np

    return np.eye(VOCAB)[batch]




@query(
    "strategy_metrics",
    f"""WITH {WSCORE}, bs AS (SELECT block_id, is_anomaly AS y, split, max(nll_max) AS a, avg(nll_mean) AS b FROM ws JOIN sp USING (block_id) WHERE split <> 'train' GROUP BY ALL),
  sc AS (SELECT block_id, y, split, 'nll_max' AS strategy, round(a, 9) AS score FROM bs UNION ALL SELECT block_id, y, split, 'nll_mean', round(b, 9) FROM bs),
  v AS (SELECT strategy, score, sum(count(*)) OVER w AS p, sum(sum(y)) OVER w AS t, sum(sum(y)) OVER (PARTITION BY strategy) AS a FROM sc WHERE split = 'val'
    GROUP BY strategy, score WINDOW w AS (PARTITION BY strategy ORDER BY score DESC)),
  th AS (SELECT strategy, score AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY round(2.0 * t / (p + a), 12) DESC, score DESC) = 1)
  SELECT strategy, split, round(threshold, 6) AS threshold, count(*) FILTER (y = 0 AND score < threshold) AS tn, count(*) FILTER (y = 0 AND score >= threshold) AS fp,
    count(*) FILTER (y = 1 AND score < threshold) AS fn, count(*) FILTER (y = 1 AND score >= threshold) AS tp FROM sc JOIN th USING (strategy) GROUP BY ALL""",
)
def strategy_metrics(spark, folder):
    """Thresholds from validation and confusion counts on both held-out splits, for two strategies."""
    events = inputs.events(spark, folder)
    labels = inputs.labels(events)
    _, _, metrics, _ = flows.score_and_evaluate(events, labels, splits.split_blocks(labels), VOCAB, strategies=["nll_max", "nll_mean"])
    return rounded(metrics.select("strategy", "split", "threshold", "tn", "fp", "fn", "tp"))
