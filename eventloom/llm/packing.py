"""Cutting-stock packing of token sequences by column generation.

Documents become pieces of at most ``capacity`` tokens: full ones and a rest. The histogram of lengths, never the
documents, goes to the driver. There a linear program over patterns (how many pieces of which length class share a
sequence) is solved by column generation: a knapsack dynamic program prices columns, the simplex step takes them
in. Patterns are used a whole number of times; what rounding leaves over, a number of pieces bounded by the classes
and not by the corpus, is packed by best fit on exact lengths, and its badly filled sequences are poured together.
Pieces are ranked inside their class on the cluster, and a pattern takes a range of ranks, so a piece finds its
sequence by arithmetic on its rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.chunks import grouped, id_table
from eventloom.session import cut_lineage

#: Pieces of one length that are ranked in one group.
RANKED_ROWS = 250_000
#: Share of the sequences by which the linear program may end above its lower bound.
GAP = 1e-4
#: Knapsacks solved at most; the patterns found so far are valid at any time.
PRICINGS = 150
#: A sequence of the rest with more room than capacity / POUR is poured together with others.
POUR = 64

RANGES = T.StructType(
    [
        T.StructField("length_class", T.IntegerType()),
        T.StructField("rank_from", T.LongType()),
        T.StructField("rank_to", T.LongType()),
        T.StructField("each", T.LongType()),
        T.StructField("slot_from", T.LongType()),
        T.StructField("sequence_from", T.LongType()),
        T.StructField("cut_from", T.LongType()),
        T.StructField("cut_length", T.LongType()),
    ]
)


def class_sizes(capacity: int) -> np.ndarray:
    """Upper bounds of the length classes: single lengths up to a quarter of the capacity, steps of two and four beyond."""
    quarter, half = max(capacity // 4, 1), max(capacity // 2, 1)
    edges = set(range(1, quarter + 1)) | set(range(quarter, half + 1, 2)) | set(range(half, capacity + 1, 4)) | {half, capacity}
    return np.array(sorted(e for e in edges if 1 <= e <= capacity), np.int64)


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest total price that fits, by dynamic programming over the room that is left."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fitting[room]:
            worth = best[room - sizes[: fitting[room]]] + prices[: fitting[room]]
            j = int(worth.argmax())
            if worth[j] > best[room] + 1e-12:
                best[room], pick[room] = worth[j], j
    pattern = np.zeros(len(sizes), np.int64)
    room = capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            pattern[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(best[capacity]), pattern


def _first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns filled from the longest class down, each used until it exhausts a class: a feasible basis, triangular."""
    m = len(sizes)
    left = demand.astype(np.float64)
    alive = np.ones(m, bool)
    basis, uses = np.zeros((m, m)), np.zeros(m)
    for _ in range(m):
        pattern = np.zeros(m, np.int64)
        room, candidates = capacity, np.flatnonzero(alive)
        while len(candidates) and room >= sizes[candidates[0]]:
            j = candidates[np.searchsorted(sizes[candidates], room, side="right") - 1]
            pattern[j] = room // sizes[j]
            room -= int(pattern[j] * sizes[j])
            candidates = candidates[candidates < j]
        taken = pattern > 0
        ratio = np.full(m, np.inf)
        ratio[taken] = left[taken] / pattern[taken]
        i = int(ratio.argmin())
        basis[:, i], uses[i] = pattern, ratio[i]
        left = np.maximum(left - ratio[i] * pattern, 0)
        left[i], alive[i] = 0, False
    return basis, uses


def column_generation(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, pricings: int = PRICINGS
) -> tuple[list[np.ndarray], np.ndarray, float]:
    """(patterns, how often each is used, lower bound) of the least sequences for ``demand`` pieces of each size.

    Prices are drawn towards the best ones known so far (at first the share of the sequence that a piece takes),
    which keeps early columns sensible. It ends when no column improves, when the sequences are within ``gap`` of
    the bound that prices prove, or after ``pricings`` knapsacks.
    """
    basis, uses = _first_basis(sizes, demand, capacity)
    patterns = [basis[:, i].astype(np.int64) for i in range(len(sizes))]
    inverse = np.linalg.inv(basis)
    centre = sizes / capacity
    bound = float((demand * centre).sum())
    done = 0
    while done < pricings:
        prices = inverse.sum(axis=0)
        if uses.sum() - bound <= gap * uses.sum():
            break
        for blend in (0.5, 0.0):
            trial = np.maximum(blend * centre + (1 - blend) * prices, 0)
            worth, pattern = knapsack(sizes, trial, capacity)
            done += 1
            if (demand * trial).sum() / worth > bound:
                bound, centre = float((demand * trial).sum() / worth), trial / worth
            if float(prices @ pattern) > 1 + 1e-9:
                break
        else:
            break
        step = inverse @ pattern
        ratio = np.full(len(sizes), np.inf)
        ratio[step > 1e-9] = uses[step > 1e-9] / step[step > 1e-9]
        i = int(ratio.argmin())
        uses, entered = np.maximum(uses - ratio[i] * step, 0), ratio[i]
        uses[i] = entered
        row = inverse[i] / step[i]
        inverse -= np.outer(step, row)
        inverse[i] = row
        patterns[i] = pattern
    return patterns, uses, bound


def _best_fit(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Positions of ``lengths`` by sequence: the longest first, each where the least room is left."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = np.flatnonzero(open_rooms[lengths[i] :])
        if len(fits):
            room = int(fits[0]) + lengths[i]
            b = by_room[room].pop()
            open_rooms[room] -= 1
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        by_room[room - lengths[i]].append(b)
        open_rooms[room - lengths[i]] += 1
    return bins


def plan(lengths: dict[int, int], capacity: int, gap: float = GAP, pricings: int = PRICINGS) -> list[tuple]:
    """Rows of ``RANGES``: which ranks of each length class go to which slots of which sequences.

    ``lengths`` counts the pieces of each length. Ranks of a class run through its lengths in ascending order. A
    row with ``each`` pieces to a sequence covers ranks [rank_from, rank_to); a row with ``cut_length`` takes only that
    many tokens of its one piece, from ``cut_from`` on.
    """
    edges = class_sizes(capacity)
    known = np.array(sorted(lengths), np.int64)
    counts = np.array([lengths[int(n)] for n in known], np.int64)
    kind = np.searchsorted(edges, known)
    used = np.unique(kind)
    sizes = edges[used]
    demand = np.array([counts[kind == k].sum() for k in used], np.int64)
    rows: list[tuple] = []
    taken = np.zeros(len(used), np.int64)
    sequences = 0
    if len(used):
        patterns, uses, _ = column_generation(sizes, demand, capacity, gap, pricings)
        for pattern, often in zip(patterns, uses, strict=True):
            n = int(min([int(often + 1e-9), *((demand - taken)[pattern > 0] // pattern[pattern > 0]).tolist()]))
            if n < 1:
                continue
            slot = 0
            for c in np.flatnonzero(pattern).tolist():
                each = int(pattern[c])
                start = int(taken[c])
                rows.append((int(used[c]), start, start + each * n, each, slot, sequences, 0, None))
                taken[c] += each * n
                slot += each
            sequences += n
    rest: list[tuple[int, int, int]] = []  # (class, rank, exact length)
    for c, k in enumerate(used.tolist()):
        inside = np.flatnonzero(kind == k)
        upto = np.cumsum(counts[inside])
        for rank in range(int(taken[c]), int(demand[c])):
            rest.append((k, rank, int(known[inside[int(np.searchsorted(upto, rank, side="right"))]])))
    poured: list[tuple[int, int, int]] = []
    for members in _best_fit([n for _, _, n in rest], capacity):
        if capacity - sum(rest[i][2] for i in members) > capacity // POUR:
            poured += [rest[i] for i in members]
            continue
        for slot, i in enumerate(members):
            k, rank, _ = rest[i]
            rows.append((k, rank, rank + 1, 1, slot, sequences, 0, None))
        sequences += 1
    at = slot = 0
    for k, rank, length in sorted(poured):
        start = 0
        while start < length:
            if at == capacity:
                sequences, at, slot = sequences + 1, 0, 0
            n = min(length - start, capacity - at)
            rows.append((k, rank, rank + 1, 1, slot, sequences, start, n))
            start, at, slot = start + n, at + n, slot + 1
    return rows


def _run(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    table = id_table(path)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        i = 0
        for group in grouped(texts):
            source, starts, lengths, totals, sums, blobs = [], [], [], [], [], []
            for ids in table.encode(group):
                blob = np.append(ids, np.uint32(end)).astype("<u4").tobytes()
                n = len(ids) + 1
                for start in range(0, n, capacity):
                    part = blob[4 * start : 4 * min(start + capacity, n)]
                    source.append(i)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    totals.append(n)
                    sums.append(zlib.crc32(part))
                    blobs.append(part)
                i += 1
            columns = [pa.array(x, pa.int64()) for x in (starts, lengths, totals, sums)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64())), *columns, pa.array(blobs, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"],
            )


def cut_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids_crc32, ids): the ids of every document and an end id, cut at each full sequence."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "ids_crc32")]
        + [T.StructField("ids", T.BinaryType())]
    )
    return docs.select("doc_id", "text").mapInArrow(partial(_run, path=tokenizer, end=end, capacity=capacity), schema)


def ranked(pieces: DataFrame, lengths: dict[int, int], capacity: int) -> DataFrame:
    """Add ``length_class`` and ``rank``, dense from 0 inside a class, by length and then piece.

    A length that many pieces share is numbered in groups of about ``RANKED_ROWS`` pieces, which start where the
    counts of the groups before them end.
    """
    spark = pieces.sparkSession
    edges = class_sizes(capacity)
    rows, before, last = [], 0, -1
    for n in sorted(lengths):
        k = int(np.searchsorted(edges, n))
        before = before if k == last else 0
        rows.append((n, k, before, lengths[n] // RANKED_ROWS + 1))
        before, last = before + lengths[n], k
    # one row for each length up to the capacity
    known = F.broadcast(spark.createDataFrame(rows, "length long, length_class int, _before long, _groups long"))
    dealt = pieces.join(known, "length").withColumn("_group", F.pmod(F.xxhash64("piece"), F.col("_groups")))
    sizes = dealt.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_rows"))
    ahead = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_group", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_group").orderBy("piece")
    placed = dealt.withColumn("_row", F.row_number().over(inside)).join(starts, ["length", "_group"])
    rank = F.col("_before") + F.col("_start") + F.col("_row") - 1
    return placed.withColumn("rank", rank).drop("_before", "_groups", "_group", "_row", "_start")


def pack(
    docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = 2048, form: str = "ids", gap: float = GAP, pricings: int = PRICINGS
) -> DataFrame:
    """Pack documents(doc_id, text) into sequences of at most ``capacity`` tokens with little padding.

    One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) and, with ``form`` "ids",
    ``ids`` as little-endian unsigned 32-bit integers; "digest" leaves them out, so that only narrow rows move.
    ``tokenizer`` is a tokenizer file that each executor can read; a document is its ids and ``end``. A document of
    several sequences is cut at full ones; beyond that only pieces of the poured rest are cut. Sequences and
    offsets are gapless from 0.

    A null text counts as the empty one, which is the end id alone; null and repeated doc_ids and repeated rows
    are documents of their own; a very long text must fit a task; other columns are ignored, whatever their
    names; an empty table gives no rows. Every task of a shuffle takes a bounded part of one length or of one sequence.
    """
    if capacity < 1:
        raise ValueError("a sequence must hold at least one token")
    pieces = cut_lineage(cut_pieces(docs, tokenizer, end, capacity).withColumn("piece", F.monotonically_increasing_id()))
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most one row for each length
    spark = pieces.sparkSession
    # patterns, and what their rounding leaves over: bounded by the length classes
    ranges = F.broadcast(spark.createDataFrame(plan(lengths, capacity, gap, pricings), RANGES))
    narrow = ranked(pieces.drop("ids"), lengths, capacity)
    where = (narrow["length_class"] == ranges["length_class"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    place = F.col("rank") - F.col("rank_from")
    placed = narrow.join(ranges, where).select(
        "piece",
        "doc_id",
        (F.col("start") + F.col("cut_from")).alias("start"),
        F.coalesce("cut_length", "length").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence_from") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("slot_from") + F.pmod(place, F.col("each"))).alias("_slot"),
        "cut_from",
        (F.coalesce("cut_length", "length") < F.col("length")).alias("_is_cut"),
    )
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    part = F.substring(F.col("ids"), F.col("cut_from").cast("int") * 4 + 1, F.col("length").cast("int") * 4)
    blobs = pieces.select("piece", "ids")
    if form == "ids":
        out = ordered.join(blobs, "piece").withColumn("ids", part).withColumn("ids_crc32", F.crc32("ids"))
        return out.select(*names, "ids")
    ordered = cut_lineage(ordered)
    # pieces of the poured rest: bounded by the length classes
    recut = blobs.join(F.broadcast(ordered.where("_is_cut")), "piece").withColumn("ids_crc32", F.crc32(part))
    return ordered.where("NOT _is_cut").select(*names).unionByName(recut.select(*names))
