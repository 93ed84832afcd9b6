"""Named queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import alignment, chat, decontam, intervals, lines, mixing, packing, pieces, sharding, simhash, topk, toxicity, warc
from eventloom.session import cut_lineage

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


_CHAT_SQL = """
WITH r AS (
  SELECT conv_id, turn, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT conv_id, turns, len(turns) - list_position(list_reverse(list_transform(turns, lambda x: x.role)), 'assistant') + 1 AS last
  FROM (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS turns FROM r GROUP BY conv_id)
  WHERE list_contains(list_transform(turns, lambda x: x.role), 'assistant')),
p AS (
  SELECT a.conv_id, a.turns AS chosen, list_append(a.turns[1:a.last - 1], b.turns[b.last]) AS rejected
  FROM t a JOIN t b ON b.conv_id = xor(a.conv_id, 1)),
n AS (
  SELECT *, coalesce(nullif(list_position(list_transform(range(1, greatest(len(chosen), len(rejected)) + 1),
      lambda i: chosen[i] IS NOT DISTINCT FROM rejected[i]), false), 0) - 1, len(chosen)) AS n FROM p),
e AS (
  SELECT conv_id, CAST(n AS INTEGER) AS prompt_turns, chosen[1:n] AS pr, chosen[n + 1:] AS ch, rejected[n + 1:] AS re FROM n)
SELECT conv_id, prompt_turns,
  coalesce(array_to_string(list_transform(pr, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(ch, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') AS chosen_text,
  coalesce(array_to_string(list_transform(re, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') AS rejected_text,
  coalesce(array_to_string(list_transform(ch, lambda x: CASE WHEN x.role = 'assistant' THEN (length(x.role) + 5) || ',' || (length(x.text) + 8)
    ELSE (length(x.role) + length(x.text) + 13) || ',0' END), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(re, lambda x: CASE WHEN x.role = 'assistant' THEN (length(x.role) + 5) || ',' || (length(x.text) + 8)
    ELSE (length(x.role) + length(x.text) + 13) || ',0' END), ','), '') AS rejected_mask,
  CAST(coalesce(list_sum(list_transform(ch, lambda x: CASE WHEN x.role = 'assistant' THEN length(x.text) + 8 ELSE 0 END)), 0) AS BIGINT) AS chosen_trained,
  CAST(coalesce(list_sum(list_transform(re, lambda x: CASE WHEN x.role = 'assistant' THEN length(x.text) + 8 ELSE 0 END)), 0) AS BIGINT) AS rejected_trained
FROM e"""


@query("op1_preference_pairs", _CHAT_SQL)
def op1_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation against itself with the answer of its partner, as prompt and masked completions."""
    return chat.format_pairs(chat.swapped_answers(table(spark, folder, "conversations")))


_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * d.x[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""


@query("op2_block_topk", _TOPK_SQL)
def op2_block_topk(spark: SparkSession, folder: str) -> DataFrame:
    """For every 50th vector the five best others by integer inner product."""
    vectors = table(spark, folder, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("terms"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query("op3_golay_simhash")
def op3_golay_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprint of every document and the smallest document it is linked to."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _entities(text: str) -> str:
    """The SQL of the character references: each distinct one is looked up or counted out, the ampersand comes last."""
    names = ", ".join(f"{_quoted(name)}: {_quoted(char)}" for name, char in warc.NAMED.items())
    code = "CAST(CASE WHEN lower(r[3]) = 'x' THEN '0x' || r[4:-2] ELSE r[3:-2] END AS INTEGER)"
    return f"""replace(list_reduce(list_prepend({text}, list_distinct(regexp_extract_all({text}, '&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,7}});'))),
      lambda a, r: CASE WHEN r = '&amp;' THEN a WHEN r[2] <> '#' THEN replace(a, r, coalesce(MAP {{{names}}}[r], r))
        WHEN {code} = 38 THEN replace(a, r, '&amp;')
        WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND {warc.LAST_CHAR} THEN replace(a, r, chr({code})) ELSE a END), '&amp;', '&')"""


def _one_line(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[ \t\r\n\f\x{{0B}}]+', ' ', 'g'), ' ')"


def _uuid(seed: str) -> str:
    h = f"md5({seed})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


CRAWL_DATE = "2024-01-01T00:00:00Z"

_HREF = r"""(?i)[\s"'']href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
_WARC_SQL = f"""
WITH s AS (
  SELECT page_id AS key, coalesce(url, '') AS uri, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS pd FROM pages),
i AS (
  SELECT *, {_uuid("'response|' || coalesce(CAST(key AS VARCHAR), '') || '|' || uri || '|' || pd")} AS rid,
    regexp_replace(regexp_replace(regexp_replace(payload, '{warc.HIDDEN_PATTERN}', '', 'g'), '{warc.BREAK_PATTERN}', chr(10), 'g'), '{warc.TAG_PATTERN}', '', 'g') AS bare,
    regexp_extract(payload, '{warc.TITLE_PATTERN}', 1) AS title,
    list_transform(list_filter(regexp_extract_all(payload, '(?i)<a\\s[^>]*'), lambda t: regexp_matches(t, '{_HREF}')),
      lambda t: regexp_extract(t, '{_HREF}', 1) || regexp_extract(t, '{_HREF}', 2) || regexp_extract(t, '{_HREF}', 3)) AS links FROM s),
x AS (
  SELECT *, trim(regexp_replace(regexp_replace({_entities("bare")}, '{warc.BLANK_PATTERN}', ' ', 'g'), '{warc.LINES_PATTERN}', chr(10), 'g'), ' ' || chr(10)) AS text FROM i),
b AS (
  SELECT key, uri, pd, rid, 'conversion' AS kind, 'text/plain; charset=utf-8' AS type, text AS block FROM x
  UNION ALL
  SELECT key, uri, pd, rid, 'metadata', 'application/warc-fields',
    'title: ' || {_one_line(_entities("title"))} || E'\r\ntext-bytes: ' || strlen(text) || E'\r\n'
    || coalesce(array_to_string(list_transform(links, lambda u: 'outlink: ' || {_one_line(_entities("u"))} || E'\r\n'), ''), '')
    || E'source-http-header: HTTP/1.1 200 OK\r\nsource-http-header: Content-Type: text/html; charset=utf-8\r\n'
    || 'source-http-header: Content-Length: ' || strlen(payload) || E'\r\nsource-payload-digest: ' || pd || E'\r\n' FROM x),
o AS (SELECT *, 'sha256:' || sha256(block) AS bd FROM b),
u AS (SELECT *, {_uuid("kind || '|' || rid || '|' || bd")} AS own FROM o)
SELECT key, kind AS record_type, own AS record_id, rid AS refers_to, pd AS source_payload_digest, bd AS block_digest,
  CAST(strlen(block) AS BIGINT) AS content_length,
  E'WARC/1.1\r\nWARC-Type: ' || kind || E'\r\nWARC-Record-ID: ' || own || E'\r\nWARC-Refers-To: ' || rid
  || E'\r\nWARC-Target-URI: ' || {_one_line("uri")} || E'\r\nWARC-Date: {CRAWL_DATE}\r\nWARC-Block-Digest: ' || bd
  || E'\r\nContent-Type: ' || type || E'\r\nContent-Length: ' || strlen(block) || E'\r\n' AS header,
  block
FROM u"""


@query("op4_warc_derivatives", _WARC_SQL)
def op4_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata and the conversion record of every page."""
    return warc.derive(warc.responses(table(spark, folder, "pages"), CRAWL_DATE))


_LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, coalesce(k.doc_id <> f.first, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


@query("op5_line_dedup", _LINES_SQL)
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that an earlier document holds."""
    return lines.dedup_lines(table(spark, folder, "documents"), "digest")


@query("op9_benchmark_leaks")
def op9_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a benchmark item within the edit budget, with the item."""
    return decontam.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"), least=1)


@query("op6_context_mixing")
def op6_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The log10 probability of every document, learned from those outside the held-out fold."""
    return mixing.score_documents(table(spark, folder, "documents"), toxicity.fold(F.col("doc_id"), 7) == 2)


TOXICITY_FOLDS = 5


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document, by a model that has seen no label of the held-out fold."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit_labelled(docs, labels.where(toxicity.fold(F.col("doc_id"), TOXICITY_FOLDS) != 0))
    held_out = (toxicity.fold(F.col("doc_id"), TOXICITY_FOLDS) == 0).alias("held_out")
    scored = toxicity.score_documents(docs, model, F.col("doc_id"), held_out)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


SHARDS = 24

_SHARDING_SQL = """
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, coalesce(CAST(doc_id AS VARCHAR), '') AS k,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes
  FROM documents),
c AS (
  SELECT doc_id, size, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, crc_table),
h AS (
  SELECT doc_id, j, CAST('0x' || substr(md5(k || ':' || j), 1, 13) AS BIGINT) AS h,
         CAST('0x' || substr(md5(k || ':slot'), 1, 13) AS BIGINT) % 1024 AS bucket
  FROM c, range(25) r(j)),
p AS (
  SELECT doc_id, any_value(bucket) AS bucket, arg_max(j, h) FILTER (j < 24) AS shard, arg_max(j, h) AS grown_shard
  FROM h GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM c JOIN p USING (doc_id)"""


@query("op8_rendezvous_shards", _SHARDING_SQL)
def op8_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents over 24 equal shards, and where they would be beside a 25th."""
    return sharding.shard_documents(table(spark, folder, "documents"), [1.0] * SHARDS)


@query("op10_piece_round_trip")
def op10_piece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole text through the public 32k piece model and back."""
    import public_tokenizers

    return pieces.encode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), "digest")


@query("op11_packed_sequences")
def op11_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), form="digest")


_RANKED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
i AS (
  SELECT row_number() OVER () AS i, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT i, item_id, t, count(*) AS often FROM (SELECT i, item_id, unnest(ts) AS t FROM i) GROUP BY i, item_id, t),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS t FROM n) WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), g),
s AS (
  SELECT i, item_id, doc_id, r, CAST(sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN w USING (t), g GROUP BY i, item_id, doc_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""


@query("op12_ranked_intervals", _RANKED_SQL)
def op12_ranked_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    index = cut_lineage(intervals.build_index(table(spark, folder, "documents")))
    return intervals.rank(index, table(spark, folder, "benchmark"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole text in byte-level tokens and in pieces, and how often their linked ids are linked in all texts."""
    import public_tokenizers

    tokenizer, model = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_documents(table(spark, folder, "documents"), tokenizer, model, "digest")
