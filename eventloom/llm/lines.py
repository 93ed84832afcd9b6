"""Line deduplication by range-partitioned line hashes.

Narrow rows (line hash, document, position) are range-partitioned and sorted by just that order. A task streams
its range, remembers the first document of the current hash and marks what later documents repeat. A hash that
runs over the border of a range, as a very common line does, is settled by the heads of the ranges, two rows for
each range. The marks come back as compressed bitmaps, one for each document that loses a line; texts only meet
their bitmap, never the lines of other texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import cut_lineage

#: What is stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: Code points that a key needs for its line to count.
LEAST_POINTS = 10
#: Lines that one range holds on average.
RANGE_LINES = 2_000_000
#: Stands for a null doc_id: one document, after every other.
NO_ID = 2**63 - 1

_HASHES = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())]
)
_MARKS = pa.schema([*_HASHES, ("kind", pa.int8())])
_HASHES_DDL = "doc_id long, text_key long, pos int, hi long, lo long"
#: Kinds of rows that a range gives: a repeated line, a line of the first hash, which earlier ranges may hold too, and the first document of a hash at a border.
DROPPED, OPEN, HEAD = 0, 1, 2


def line_hashes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A row for each line whose key is long enough; keys are 128-bit hashes."""
    for batch in batches:
        ids, keys, texts = (batch.column(i) for i in range(3))
        owners, places, digests = [], [], []
        for row, text in enumerate(texts.to_pylist()):
            for pos, line in enumerate((text or "").split("\n")):
                line = line.strip(BLANKS)
                if len(line) >= least:
                    owners.append(row)
                    places.append(pos)
                    digests.append(xxhash.xxh3_128_digest(line.encode().lower()))
        halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
        at = pa.array(owners, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [ids.take(at), keys.take(at), pa.array(places, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
            schema=_HASHES,
        )


def mark_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream one sorted range: repeats are marked, lines of the first hash left open, heads of both borders given."""
    first = last = None  # (hi, lo) of the range's first hash and of the last row so far
    leader = 0  # first document of the last hash
    heads: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, key, pos, hi, lo = (batch.column(i).to_numpy() for i in range(5))
        new = np.ones(len(doc), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        new[0] = (int(hi[0]), int(lo[0])) != last
        if first is None:
            first = (int(hi[0]), int(lo[0]))
            heads.append((int(doc[0]), *first))
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1  # -1: goes on from the batch before
        leaders = np.append(doc[starts], leader)[group]
        is_open = (hi == first[0]) & (lo == first[1])
        kind = np.where(is_open, OPEN, DROPPED)
        keep = is_open | (doc != leaders)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, key, pos, hi, lo)] + [pa.array(kind[keep].astype(np.int8))], schema=_MARKS)
        last, leader = (int(hi[-1]), int(lo[-1])), int(leaders[-1])
    if first is not None:
        heads.append((leader, *last))
        n = len(heads)
        columns = [[h[0] for h in heads], [0] * n, [0] * n, [h[1] for h in heads], [h[2] for h in heads], [HEAD] * n]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MARKS, strict=True)], schema=_MARKS)


def pack(dropped: list[int]) -> bytes:
    """A compressed bitmap whose bits are set for the lines to drop; lines after the last bit stay."""
    bits = np.zeros(max(dropped) + 1 if len(dropped) else 0, np.uint8)
    bits[np.asarray(dropped, np.int64)] = 1
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def unpack(bitmap: bytes | None) -> np.ndarray:
    if bitmap is None:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little"))


def _keyed(docs: DataFrame) -> DataFrame:
    """documents with a non-null id and a hash of the text, so that rows of one id are told apart."""
    return docs.withColumns(
        {
            "_doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)),
            "_key": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
        }
    )


def drop_bitmaps(docs: DataFrame, least: int = LEAST_POINTS, range_lines: int = RANGE_LINES) -> DataFrame:
    """(_doc, _key, dropped): for each row of documents(doc_id, text) that loses lines, its packed bitmap.

    A line is dropped where its key, stripped of blanks and with A-Z in lower case, has at least ``least`` code
    points and a smaller doc_id holds it too. A document never loses a line to itself, so repeats within one
    document stay if it is the first. Null texts have one empty line; a null doc_id is after all others.
    """
    spark = docs.sparkSession
    narrow = _keyed(docs).select(F.col("_doc").alias("doc_id"), F.col("_key").alias("text_key"), "text")
    hashes = cut_lineage(narrow.mapInArrow(partial(line_hashes, least=least), _HASHES_DDL))
    order = ["hi", "lo", "doc_id", "pos", "text_key"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), hashes.count() // range_lines + 1)
    ranged = hashes.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    marks = cut_lineage(ranged.mapInArrow(mark_repeats, _HASHES_DDL + ", kind byte"))
    # two rows for each range
    heads = marks.where(F.col("kind") == HEAD).groupBy("hi", "lo").agg(F.min("doc_id").alias("leader"))
    late = marks.where(F.col("kind") == OPEN).join(F.broadcast(heads), ["hi", "lo"]).where(F.col("doc_id") != F.col("leader"))
    both = marks.where(F.col("kind") == DROPPED).select("doc_id", "text_key", "pos").unionByName(late.select("doc_id", "text_key", "pos"))
    # no more positions than the text has lines
    packed = F.pandas_udf(lambda lists: pd.Series([pack(x) for x in lists]), "binary")
    grouped = both.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("pos"))
    return grouped.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), packed("pos").alias("dropped"))


def kept_text(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    """(lines before, lines dropped, what stays)."""
    lines = (text or "").split("\n")
    gone = set(unpack(bitmap).tolist())
    return len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)


def _finish(batches: Iterator[pa.RecordBatch], shape: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, maps = (batch.column(i) for i in range(3))
        rows = [shape(*kept_text(t, b)) for t, b in zip(texts.to_pylist(), maps.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(3)]], schema=schema)


def _digest(n_lines: int, n_dropped: int, text: str) -> tuple:
    return n_lines, n_dropped, hashlib.sha256(text.encode()).hexdigest()


def _text(n_lines: int, n_dropped: int, text: str) -> tuple:
    return n_lines, n_dropped, text


def dedup_lines(docs: DataFrame, form: str = "text", least: int = LEAST_POINTS, range_lines: int = RANGE_LINES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, and kept_text or, with ``form`` "digest", kept_sha256) for each row of documents.

    See ``drop_bitmaps`` for what is dropped. Equal rows are treated alike and all returned; other columns are
    ignored; an empty table gives no rows.
    """
    maps = drop_bitmaps(docs, least, range_lines)
    base = _keyed(docs.select("doc_id", "text"))
    joined = base.join(maps, ["_doc", "_key"], "left").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "dropped")
    shape, name = (_text, "kept_text") if form == "text" else (_digest, "kept_sha256")
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), (name, pa.string())])
    return joined.mapInArrow(partial(_finish, shape=shape, schema=schema), f"doc_id long, n_lines long, n_dropped long, {name} string")


def without_repeats(docs: DataFrame, least: int = LEAST_POINTS, range_lines: int = RANGE_LINES) -> DataFrame:
    """documents with all their columns and rows, their texts without the dropped lines; null texts stay null."""
    maps = drop_bitmaps(docs, least, range_lines)
    rows = _keyed(docs.select("doc_id", "text", F.struct("*").alias("_row"))).select("_doc", "_key", "_row")
    joined = rows.join(maps, ["_doc", "_key"], "left")
    cut = F.pandas_udf(lambda texts, maps: pd.Series([kept_text(t, b)[2] for t, b in zip(texts, maps)]), "string")
    text = F.when(F.col("dropped").isNull(), F.col("_row.text")).otherwise(cut("_row.text", "dropped"))
    return joined.select(*[(text if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
