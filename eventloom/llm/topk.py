"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are cut into blocks of neighbouring identifiers. A block keeps the least and greatest weight of each term
(component) and its rows as a forward index. For each query, blocks are taken in the order of their summed term
maxima and scored whole, until the bound of the next block is below the kth score so far. The result is exact;
only the work depends on how tight the bounds are.

Queries travel in chunks, vectors stay in lanes of a bounded number of rows, and each chunk visits each lane.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, blocks that travel as one row, rows of a lane, queries of a chunk.
BLOCK, GROUP_BLOCKS, LANE_ROWS, CHUNK = 128, 32, 65_536, 256
#: Integers up to here add and multiply exactly as doubles.
EXACT = 2**53

_PACKED = "n long, dims long, ids binary, values binary"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for a null vector and one with null, infinite or NaN components."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    wide = vector.cast("array<double>")
    return F.when(~F.exists(wide, bad), F.transform(wide, lambda x: F.floor(x * scale)))


def _pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows (id, array) as one row of bytes for each ``rows`` of them."""
    ids: list[int] = []
    vectors: list[np.ndarray] = []

    def packed() -> pa.RecordBatch:
        dims = max(map(len, vectors))
        matrix = np.zeros((len(ids), dims), np.int64)
        for i, v in enumerate(vectors):
            matrix[i, : len(v)] = v
        columns = [[len(ids)], [dims], [np.array(ids, np.int64).tobytes()], [matrix.tobytes()]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["n", "dims", "ids", "values"])

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(i)
            vectors.append(v.values.to_numpy())
            if len(ids) == rows:
                yield packed()
                ids, vectors = [], []
    if ids:
        yield packed()


def _unpack(n: int, dims: int, ids: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(values, np.int64).reshape(n, dims)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.score = np.full((len(queries), k), -np.inf)
        self.id = np.full((len(queries), k), -1, np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Flat candidates; ties go to the smaller id."""
        touched, at = np.unique(rows, return_inverse=True)
        old = self.score[touched]
        keep = np.isfinite(old)
        row = np.concatenate([at, np.nonzero(keep)[0]])
        score = np.concatenate([scores, old[keep]])
        each = np.concatenate([ids, self.id[touched][keep]])
        order = np.lexsort((each, -score, row))
        row, score, each = row[order], score[order], each[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        first = rank < self.k
        fresh, names = np.full((len(touched), self.k), -np.inf), np.full((len(touched), self.k), -1, np.int64)
        fresh[row[first], rank[first]] = score[first]
        names[row[first], rank[first]] = each[first]
        self.score[touched], self.id[touched] = fresh, names


def search_group(best: Best, q: np.ndarray, ids: np.ndarray, x: np.ndarray, block: int) -> int:
    """Let the blocks of one group compete; gives how many (query, block) pairs were scored."""
    dims = max(q.shape[1], x.shape[1])
    n_blocks = -(-len(ids) // block)
    forward = np.zeros((n_blocks * block, dims), np.int64)
    forward[: len(ids), : x.shape[1]] = x
    names = np.full(n_blocks * block, -1, np.int64)
    names[: len(ids)] = ids
    wide = np.zeros((len(q), dims), np.int64)
    wide[:, : q.shape[1]] = q
    exact = float(np.abs(wide).max(initial=0)) * float(np.abs(forward).max(initial=0)) * dims < EXACT
    kind = np.float64 if exact else object
    forward, wide = forward.astype(kind), wide.astype(kind)
    names, forward = names.reshape(n_blocks, block), forward.reshape(n_blocks, block, dims)
    # rows that only fill a block take no part in its maxima, or the bound of a block of negatives would be loose
    real = names[:, :, None] >= 0 if ids.min(initial=0) >= 0 else np.arange(n_blocks * block).reshape(n_blocks, block, 1) < len(ids)
    high = np.where(real, forward, forward[:, :1]).max(axis=1)
    low = np.where(real, forward, forward[:, :1]).min(axis=1)
    bound = (np.maximum(wide, 0) @ high.T + np.minimum(wide, 0) @ low.T).astype(np.float64)
    order = np.argsort(-bound, axis=1, kind="stable")
    here = np.arange(len(wide))
    scored = 0
    for step in range(n_blocks):
        chosen = order[:, step]
        # a bound that equals the kth score may hide a smaller id
        live = np.flatnonzero(bound[here, chosen] >= best.score[:, -1])
        if not len(live):
            break
        scored += len(live)
        chosen = chosen[live]
        score = np.matmul(forward[chosen], wide[live][:, :, None])[:, :, 0].astype(np.float64)
        name = names[chosen]
        fits = (score >= best.score[live, -1][:, None]) & real[chosen][:, :, 0] & (name != best.queries[live][:, None])
        row, col = np.nonzero(fits)
        if len(row):
            best.offer(live[row], score[row, col], name[row, col])
    return scored


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _visit(batches: Iterator[pa.RecordBatch], k: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows of (chunk, query bytes, group bytes). While the chunk stays the same its thresholds are carried on."""

    def given(best: Best) -> pa.RecordBatch:
        found = np.isfinite(best.score)
        rows = np.nonzero(found)[0]
        columns = [best.queries[rows], best.id[found], best.score[found].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_OUT)

    chunk, best, q = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["chunk"] != chunk:
                if best is not None:
                    yield given(best)
                chunk = row["chunk"]
                queries, q = _unpack(*[row[f"q_{c}"] for c in ("n", "dims", "ids", "values")])
                best = Best(queries, k)
            search_group(best, q, *_unpack(*[row[c] for c in ("n", "dims", "ids", "values")]), block)
    if best is not None:
        yield given(best)


def search(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k highest inner products over all other vectors.

    Both frames hold (vec_id long, terms array<bigint>); null arrays and null ids take no part. Ties go to the
    smaller vec_id, ranks count from 1, a query with fewer vectors than k returns all. A vector never answers a
    query of its own id. Shorter vectors count as padded with zeros. Repeated rows are separate answers. Scores
    within 2**53 are exact. Other columns are ignored; empty tables give no rows.
    """
    spark = vectors.sparkSession
    usable = "vec_id is not null and terms is not null"
    rows = vectors.where(usable).select("vec_id", "terms")
    lanes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // LANE_ROWS))
    groups = (
        rows.repartitionByRange(lanes, "vec_id")
        .sortWithinPartitions("vec_id")
        .mapInArrow(partial(_pack, rows=block * GROUP_BLOCKS), _PACKED)
        .withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
    )
    chunks = queries.where(usable).select("vec_id", "terms").mapInArrow(partial(_pack, rows=CHUNK), _PACKED)
    named = chunks.select(F.xxhash64("ids", "values").alias("chunk"), *[F.col(c).alias(f"q_{c}") for c in ("n", "dims", "ids", "values")])
    everywhere = named.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    met = everywhere.repartition(lanes, "lane").join(groups.repartition(lanes, "lane").hint("shuffle_hash"), "lane").drop("lane")
    found = met.mapInArrow(partial(_visit, k=k, block=block), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")
