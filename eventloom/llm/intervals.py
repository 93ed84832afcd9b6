"""Ranked lexical search by best-first intervals of documents over range-maximum tables.

The index is made of segments: every task cuts the documents it reads into ranges of bounded size, orders each range so that
like documents are neighbours, and writes one posting list for each term of the range (places of the documents and
how often the term occurs), so no posting is shuffled while the index is built. A search takes the lists of the
queried terms, turns them into integer impacts, and puts a sparse table of range maxima over each list. A query's
intervals of places are kept by the sum of the maxima of its terms inside them, the most that any document
there can score. The best intervals are split at the document of the highest impact, which is scored, until no
interval can reach the kth score; intervals of few documents are scored whole instead of being split.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.session import cut_lineage

#: Letters and digits of ASCII and everything beyond it; a character beyond it has no byte below 0x80.
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Characters of text and documents in a segment of the index.
SEGMENT_CHARS = 24_000_000
SEGMENT_DOCS = 65_536
#: Posting lists in one batch of rows.
LISTS_AT_ONCE = 20_000
#: Queries that visit a segment together.
BLOCK_QUERIES = 1_000
#: Intervals of at most so many documents are scored whole.
LEAF = 48
#: Intervals that are split at once.
WIDTH = 128
#: Bytes of terms up to which the list of queried terms is broadcast.
SMALL_TERMS = 10_000_000
#: A null id while it is sorted: before all others.
NULL_ID = -(1 << 63)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats; a null text has none. Only A to Z are lower-cased."""
    return [] if text is None else _TERM.findall(text.encode().lower())


def impacts(times: np.ndarray, terms: np.ndarray, weights: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """The integer score that a term brings to a document: ``times`` it occurs there, ``terms`` the document has."""
    m = 25 + (75 * terms * documents) // occurrences
    return weights * ((1_000_000_000 * times) // (1000 * times + 8 * m))


def _segment(ids: pa.Array, texts: list[str | None], name: str) -> Iterator[pa.RecordBatch]:
    """The rows of one segment: its documents, and one posting list for each term."""
    vocabulary: defaultdict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    rows, kept = [], []
    for i, text in enumerate(texts):
        found = terms_of(text)
        if found:
            rows.append(np.fromiter(map(vocabulary.__getitem__, found), np.int32, len(found)))
            kept.append(i)
    if not kept:
        return
    width = len(vocabulary)
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    keys = np.repeat(np.arange(len(rows)) * width, lengths)
    keys += np.concatenate(rows)
    del rows
    keys, times = np.unique(keys, return_counts=True)
    place, term = np.divmod(keys, width)
    # like documents become neighbours: by their most frequent term, then by length
    starts = np.searchsorted(place, np.arange(len(lengths)))
    common = times * (1 << 32) + np.bincount(term, minlength=width)[term]
    first = np.flatnonzero(common == np.maximum.reduceat(common, starts)[place])
    main = np.full(len(lengths), width, np.int64)
    np.minimum.at(main, place[first], term[first])
    order = np.lexsort((lengths, main))
    new_place = np.empty(len(lengths), np.int64)
    new_place[order] = np.arange(len(lengths))
    keys = term * len(lengths) + new_place[place]
    sort = np.argsort(keys)
    place, times = (keys[sort] % len(lengths)).astype("<u4"), times[sort].astype("<u4")
    holding = np.bincount(term, minlength=width)
    head = pa.RecordBatch.from_arrays(
        [
            pa.array([name]),
            pa.nulls(1, pa.binary()),
            pa.array([len(lengths)], pa.int64()),
            pa.nulls(1, pa.binary()),
            pa.nulls(1, pa.binary()),
            pa.ListArray.from_arrays([0, len(lengths)], ids.take(pa.array(np.array(kept)[order]))),
            pa.ListArray.from_arrays([0, len(lengths)], pa.array(lengths[order])),
        ],
        schema=_ARROW,
    )
    yield head
    words = pa.array(vocabulary, pa.binary())
    bounds = np.concatenate([[0], np.cumsum(holding)])
    for a in range(0, width, LISTS_AT_ONCE):
        b = min(a + LISTS_AT_ONCE, width)
        at = pa.py_buffer(((bounds[a : b + 1] - bounds[a]) * 4).astype(np.int32).tobytes())
        blobs = [pa.Array.from_buffers(pa.binary(), b - a, [None, at, pa.py_buffer(x[bounds[a] : bounds[b]].tobytes())]) for x in (place, times)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * (b - a)),
                words.slice(a, b - a),
                pa.array(holding[a:b], pa.int64()),
                *blobs,
                pa.nulls(b - a, _ARROW.field("doc_ids").type),
                pa.nulls(b - a, _ARROW.field("lengths").type),
            ],
            schema=_ARROW,
        )


INDEX = T.StructType(
    [
        T.StructField("segment", T.StringType()),
        T.StructField("term", T.BinaryType()),
        T.StructField("holding", T.LongType()),
        T.StructField("places", T.BinaryType()),
        T.StructField("times", T.BinaryType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
    ]
)
_ARROW = pa.schema(
    [
        ("segment", pa.string()),
        ("term", pa.binary()),
        ("holding", pa.int64()),
        ("places", pa.binary()),
        ("times", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
    ]
)


def _index(batches: Iterator[pa.RecordBatch], chars: int, docs: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    task = context.partitionId() if context is not None else 0
    ids, texts, size, segments = [], [], 0, 0
    for batch in batches:
        column = batch.column(1).to_pylist()
        start = 0
        for i, text in enumerate(column):
            size += len(text or "")
            if size >= chars or len(texts) + i - start + 1 >= docs:
                ids.append(batch.column(0).slice(start, i + 1 - start))
                texts += column[start : i + 1]
                yield from _segment(pa.concat_arrays(ids), texts, f"{task}-{segments}")
                ids, texts, size, segments, start = [], [], 0, segments + 1, i + 1
        if start < len(column):
            ids.append(batch.column(0).slice(start))
            texts += column[start:]
    if texts:
        yield from _segment(pa.concat_arrays(ids), texts, f"{task}-{segments}")


def build_index(docs: DataFrame, chars: int = SEGMENT_CHARS, most: int = SEGMENT_DOCS) -> DataFrame:
    """The index of documents(doc_id, text): one row for each segment (term null, doc_ids, lengths) and each of its terms.

    Every row of the table with at least one term is a document, also those with a null or repeated doc_id. A segment
    ends after ``chars`` characters or ``most`` documents. Store it before it is searched: the names of segments
    follow the tasks that read the documents.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(partial(_index, chars=chars, docs=most), INDEX)


class Lists:
    """Posting lists of a segment, one after the other, with a sparse table of range maxima over them."""

    def __init__(self, places: list[np.ndarray], scores: list[np.ndarray], documents: int):
        lengths = np.fromiter(map(len, places), np.int64, len(places))
        self.documents = documents
        self.starts = np.cumsum(lengths) - lengths
        self.ends = self.starts + lengths
        self.places = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.scores = np.concatenate(scores) if scores else np.zeros(0, np.int64)
        #: where each posting is found by (list, place)
        self.keys = np.repeat(np.arange(len(places)), lengths) * documents + self.places
        #: row i holds the position of the maximum of the 2^i postings from each position on
        longest = int(lengths.max()) if len(lengths) else 1
        self.levels = np.empty((max(longest, 1).bit_length(), len(self.scores)), np.int32)
        self.levels[0] = np.arange(len(self.scores))
        for i in range(1, len(self.levels)):
            step = 1 << (i - 1)
            a, b = self.levels[i - 1, :-step], self.levels[i - 1, step:]
            self.levels[i] = self.levels[i - 1]
            self.levels[i, :-step] = np.where(self.scores[a] >= self.scores[b], a, b)

    def positions(self, lists: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The first posting of each list at or after each place, one row for each place."""
        return np.searchsorted(self.keys, lists[None, :] * self.documents + places[:, None])

    def top(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The position of the maximum of each range [a, b), or -1 of an empty one."""
        size = b - a
        some = np.maximum(size, 1)
        level = np.frexp(some.astype(np.float64))[1] - 1
        last = len(self.scores) - 1
        x = self.levels[level, np.minimum(a, last)]
        y = self.levels[level, np.minimum(np.maximum(b, 1), last + 1) - (1 << level)]
        return np.where(size > 0, np.where(self.scores[x] >= self.scores[y], x, y), -1)


class Found:
    """The k best documents so far: highest score first, ties to the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.rows: list[tuple[int, int]] = []

    @property
    def least(self) -> int:
        """The score that a document must reach to matter."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.least)
        if len(good):
            self.rows = sorted([*self.rows, *zip((-scores[good]).tolist(), ids[good].tolist(), strict=True)])[: self.k]


def search_segment(lists: Lists, wanted: np.ndarray, often: np.ndarray, ids: np.ndarray, k: int, leaf: int = LEAF, width: int = WIDTH) -> tuple[list[tuple[int, int]], int]:
    """((score, id) of the k best documents of a segment, documents scored) for a query's lists and how often it has each term."""
    best = Found(k)
    scored = 0
    low, high = np.zeros(1, np.int64), np.full(1, lists.documents, np.int64)
    a, b = lists.starts[wanted][None, :], lists.ends[wanted][None, :]
    top = lists.top(a, b)
    worth = np.where(top >= 0, lists.scores[top], 0) * often
    bound = worth.sum(axis=1)
    while len(bound):
        kept = bound >= best.least
        if not kept.all():
            low, high, a, b, top, worth, bound = low[kept], high[kept], a[kept], b[kept], top[kept], worth[kept], bound[kept]
            if not len(bound):
                break
        if len(bound) > width:
            now = np.argpartition(-bound, width)[:width]
            later = np.ones(len(bound), bool)
            later[now] = False
        else:
            now, later = np.arange(len(bound)), np.zeros(len(bound), bool)
        x, y, i, j, t, w = low[now], high[now], a[now], b[now], top[now], worth[now]
        small = y - x <= leaf
        if small.any():
            first, size = i[small].ravel(), (j[small] - i[small]).ravel()
            total = int(size.sum())
            at = np.arange(total) + np.repeat(first - np.cumsum(size) + size, size)
            rows = np.repeat(np.repeat(np.arange(int(small.sum())), len(wanted)), size)
            times = np.repeat(np.tile(often, int(small.sum())), size)
            cell = rows * leaf + lists.places[at] - x[small][rows]
            sums = np.zeros(int(small.sum()) * leaf, np.int64)
            np.add.at(sums, cell, lists.scores[at] * times)
            hit = np.flatnonzero(sums)
            scored += len(hit)
            best.add(sums[hit], ids[x[small][hit // leaf] + hit % leaf])
        large = ~small
        parts = [(low[later], high[later], a[later], b[later], top[later], worth[later], bound[later])]
        if large.any():
            x, y, i, j, t, w = x[large], y[large], i[large], j[large], t[large], w[large]
            pick = w.argmax(axis=1)
            split = lists.places[t[np.arange(len(t)), pick]]
            at = lists.positions(wanted, split)
            holds = (at < j) & (lists.places[np.minimum(at, len(lists.places) - 1)] == split[:, None])
            sums = (np.where(holds, lists.scores[np.minimum(at, len(lists.scores) - 1)], 0) * often).sum(axis=1)
            scored += len(sums)
            best.add(sums, ids[split])
            new_low, new_high = np.concatenate([x, split + 1]), np.concatenate([split, y])
            new_a, new_b = np.concatenate([i, at + holds]), np.concatenate([at, j])
            new_top = lists.top(new_a, new_b)
            new_worth = np.where(new_top >= 0, lists.scores[new_top], 0) * often
            parts.append((new_low, new_high, new_a, new_b, new_top, new_worth, new_worth.sum(axis=1)))
        low, high, a, b, top, worth, bound = (np.concatenate(c) for c in zip(*parts, strict=True))
    return [(-s, d) for s, d in best.rows], scored


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Counter(terms_of(t)) for t in batch.column(1).to_pylist()]
        words, often = pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), words, often], ["item_id", "words", "often"])


def _search(table: pa.Table, k: int, documents: int, occurrences: int) -> pa.Table:
    """All queries of a block in one segment."""
    kinds = np.array(table["kind"])
    head = table.filter(pa.array(kinds == 0))
    ids = np.array(head["doc_ids"].combine_chunks().flatten().fill_null(NULL_ID))
    lengths = np.array(head["lengths"].combine_chunks().flatten())
    posted = table.filter(pa.array(kinds == 1))
    names, places, scores = {}, [], []
    for term, where, times, w in zip(posted["term"].to_pylist(), posted["places"], posted["times"], posted["weight"].to_pylist(), strict=True):
        names[term] = len(places)
        at = np.frombuffer(where.as_buffer(), "<u4").astype(np.int64)
        places.append(at)
        scores.append(impacts(np.frombuffer(times.as_buffer(), "<u4").astype(np.int64), lengths[at], w, documents, occurrences))
    lists = Lists(places, scores, len(ids))
    out: list[tuple] = []
    asked = table.filter(pa.array(kinds == 2))
    for query, words, often in zip(asked["query"].to_pylist(), asked["words"].to_pylist(), asked["often"].to_pylist(), strict=True):
        known = [(names[t], n) for t, n in zip(words, often, strict=True) if t in names]
        if known:
            wanted, counts = np.array(known, np.int64).T
            rows, scored = search_segment(lists, wanted, counts, ids, k)
            out += [(query, d if d != NULL_ID else None, s, scored) for s, d in rows]
    return pa.table(
        {n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("query", "doc_id", "score", "scored"))}
    )


def rank(index: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK_QUERIES) -> DataFrame:
    """The k best documents of an index for each of queries(item_id, text): (item_id, rank, doc_id, score).

    ``index`` is a stored result of ``build_index``. Ranks run from 1, equal scores by ascending doc_id (null first),
    and only documents with a score above 0 appear. Equal rows of queries count once; an item_id with several
    texts is ranked for each text by itself; a null text, or one without known terms, finds nothing; an empty index or
    empty queries give no rows; other columns are ignored.

    Terms meet their lists by a join, and only lists of queried terms move. Queries visit every segment in blocks of
    ``block``, so that a task holds one segment and one block.
    """
    totals = index.where("term IS NULL").agg(
        F.sum("holding").alias("documents"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("occurrences")
    ).first()
    documents, occurrences = totals["documents"] or 0, totals["occurrences"] or 0
    shape = T.StructType([queries.schema["item_id"], T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("often", T.ArrayType(T.LongType()))])
    asked = cut_lineage(
        queries.select("item_id", "text").distinct().mapInArrow(_asked, shape).withColumn("query", F.monotonically_increasing_id())
    )
    blocks = asked.count() // block + 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    words = asked.select("block", F.explode("words").alias("term")).distinct()
    small = (words.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) <= SMALL_TERMS
    fitted = F.broadcast if small else lambda frame: frame
    lists = index.where("term IS NOT NULL")
    held = lists.select("term", "holding").join(fitted(words.select("term").distinct()), "term").groupBy("term").agg(F.sum("holding").alias("n"))
    # in doubles
    weight = F.floor(1000 * F.ln((F.lit(2 * documents + 2) / (2 * F.col("n") + 1)))).cast("long")
    queried = words.join(held.select("term", weight.alias("weight")), "term")
    posted = lists.join(fitted(queried), "term")
    heads = index.where("term IS NULL").select(
        "segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "doc_ids", "lengths"
    )
    columns = {
        "kind": "int", "term": "binary", "places": "binary", "times": "binary", "weight": "long", "doc_ids": "array<bigint>", "lengths": "array<bigint>",
        "query": "long", "words": "array<binary>", "often": "array<bigint>",
    }

    def rows(frame: DataFrame, kind: int) -> DataFrame:
        made = frame.withColumn("kind", F.lit(kind))
        return made.select(
            "segment", "block", *[F.col(c) if c in made.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
        )

    # the queries of a block go to every segment
    visits = heads.select("segment", "block").join(asked.select("block", "query", "words", "often"), "block")
    met = rows(heads, 0).unionByName(rows(posted.select("segment", "block", "term", "places", "times", "weight"), 1)).unionByName(rows(visits, 2))

    def visit(table: pa.Table) -> pa.Table:
        return _search(table, k, documents, occurrences)

    found = met.groupBy("segment", "block").applyInArrow(visit, "query long, doc_id long, score long, scored long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
