"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each filled up with zeros to a word of the perfect binary Golay
code [23, 12, 7]. A word is decoded to all code words within four bits of it, one or six of them; two words that
differ in at most two bits share at least one. Differences of at most four bits fall on the segments in one of
two ways: at most two on each, so that a triple of code words is shared, or three or four on one, so that of the other
two segments one is equal and one differs in a single bit. Both cases have their keys, equal keys are brought together,
and every pair that they bring together is verified bit by bit.

Fingerprints are made unique first, so copies of a text never meet. Within a key only a spanning forest of the
links is kept, not every pair; a key with very many fingerprints is worked on in pairs of blocks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.graph import components
from eventloom.llm.lines import NO_ID
from eventloom.llm.xxh64 import hash_ranges
from eventloom.session import cut_lineage

#: Bits in which linked fingerprints may differ: what the keys are made for.
RADIUS = 4
#: (first bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the Golay code.
GENERATOR = 0b110001110101
CODE_BITS, CHECK_BITS = 23, 11
#: Bytes of text that are fingerprinted at once, fingerprints whose keys are made at once.
TEXT_BYTES, KEYED = 1 << 20, 4096
#: Shingles of a passage on average; hashes that a sketch holds at most.
PASSAGE, SKETCH = 16, 512
#: Texts that are summarised at once: all their hashes are held.
SUMMARISED = 512
#: Share of all their shingles that two near copies have in common.
SIMILARITY = 0.8
#: Least hashes of a band; share of the pairs just at the threshold that may have no band in common.
BAND, MISSED = 5, 1e-7
#: Shingles up to which a text has keys that no similar text can miss; longer ones have bands alone.
COMPLETE = 64
#: Texts and bytes of text that one task compares in pairs of blocks, each block of at most so many on average.
BLOCK_TEXTS, BLOCK_BYTES = 4096, 8 << 20
#: Fingerprints of one key that one task links at once.
HOT = 50_000
#: Keys of at most so many fingerprints are compared all at once.
SMALL = 8

_BLANK = rb"\x20\x09-\x0d"
_NEXT_BLANK = re.compile(rb"[" + _BLANK + rb"]")


# --- fingerprints


def _shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of all k-word shingles of texts data[offsets[i] : offsets[i + 1]]."""
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    filled = offsets[:-1] < offsets[1:]
    before, after = np.empty_like(blank), np.empty_like(blank)
    before[1:], after[:-1] = blank[:-1], blank[1:]
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    first = np.flatnonzero(~blank & before)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.flatnonzero(~blank & after) + 1 - first
    text = np.searchsorted(offsets, first, "right") - 1
    # one space after each word
    place = np.cumsum(size + 1) - (size + 1)
    dense = np.full(int(place[-1] + size[-1] + 1), 32, np.uint8)
    letters = data[~blank]
    dense[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    count = np.bincount(text, minlength=len(offsets) - 1)
    begin = np.cumsum(count) - count
    within = np.arange(len(first)) - begin[text]
    opens = np.flatnonzero(within <= np.maximum(count - k, 0)[text])
    owner = text[opens]
    last = np.minimum(opens + k - 1, begin[owner] + count[owner] - 1)
    return hash_ranges(dense, place[opens], place[last] + size[last] - place[opens]), owner


def _pieces(text: bytes, k: int) -> Iterator[bytes]:
    """A long text in pieces whose shingles together are the text's: each goes on for k - 1 words into the next."""
    at, n = 0, len(text)
    ahead = re.compile(rb"(?:[" + _BLANK + rb"]*[^" + _BLANK + rb"]+){%d}" % (k - 1))
    while True:
        cut = _NEXT_BLANK.search(text, min(at + TEXT_BYTES, n))
        tail = ahead.match(text, cut.start()) if cut else None
        # the last piece takes what would have no full shingle of its own
        if not tail or not text[tail.end() :].strip(b" \t\n\x0b\x0c\r"):
            yield text[at:]
            return
        yield text[at : tail.end()]
        at = cut.start()


def _majority(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Fingerprints as signed integers: a bit is set where over half of the hashes have it."""
    return np.packbits((2 * ones > total[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<i8")[:, 0]


def bit_counts(texts: list[bytes], k: int, parts_of: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(how many shingle hashes of each text have each bit, how many hashes it has).

    ``parts_of`` gathers (texts, fingerprints of their passages, texts, hashes); a passage ends at a shingle whose hash says so.
    """
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    parts: list[bytes] = []
    owners: list[int] = []

    def flush() -> None:
        if not parts:
            return
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        hashes, part = _shingles(np.frombuffer(b"".join(parts), np.uint8), offsets, k)
        if len(hashes):
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            owner = np.array(owners)[part]
            if parts_of is None:
                sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            else:
                ends = (hashes >> np.uint64(20)) % np.uint64(PASSAGE) == 0
                cuts = np.union1d(starts, np.flatnonzero(ends[:-1]) + 1)
                passages = np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
                parts_of.append((owner[cuts], _majority(passages, np.diff(np.append(cuts, len(hashes)))), owner, hashes))
                sums = np.add.reduceat(passages, np.searchsorted(cuts, starts), axis=0)
            np.add.at(ones, owner[starts], sums)
            np.add.at(total, owner[starts], np.diff(np.append(starts, len(hashes))))
        parts.clear()
        owners.clear()

    size = 0
    for i, text in enumerate(texts):
        for piece in _pieces(text, k) if len(text) > TEXT_BYTES else (text,):
            parts.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= TEXT_BYTES:
                flush()
                size = 0
    flush()
    return ones, total


def fingerprint_texts(texts: list[bytes], k: int) -> np.ndarray:
    """64-bit fingerprints as signed integers: a bit is set where over half of the shingle hashes have it."""
    return _majority(*bit_counts(texts, k))


def summaries(texts: list[bytes], k: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(fingerprints, distinct passage keys of each text, its SKETCH smallest 32-bit shingle hashes in order).

    A passage's key are the indices of the code words nearest to the segments of its own fingerprint.
    """
    parts: list = []
    fps = _majority(*bit_counts(texts, k, parts))
    none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    owner, passage, whose, hashes = (np.concatenate(x) for x in zip(none, *parts, strict=True))
    codes = [code_indices(((passage.view(np.uint64) >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64))[:, 0] for a, n in SEGMENTS]
    keys = (codes[0] << 24) | (codes[1] << 12) | codes[2]
    each = np.arange(len(texts))

    def split(owners: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(owners, kind="stable")
        return np.split(values[order], np.searchsorted(owners[order], each[1:])) if len(texts) else []

    return fps, [np.unique(x) for x in split(owner, keys)], [np.unique(x)[:SKETCH] for x in split(whose, (hashes >> np.uint64(32)).astype(np.uint32))]


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two shingle sets from their sketches: exact if both sketches hold their whole set."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    both = np.union1d(x, y)
    if max(len(x), len(y)) >= SKETCH:
        both = both[:SKETCH]
    shared = np.isin(both, x, assume_unique=True) & np.isin(both, y, assume_unique=True)
    return float(shared.mean()) if len(both) else 1.0


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        columns = [batch.column(0), batch.column(1), pa.array(fingerprint_texts(texts, k), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "text_key", "fp"])


# --- Golay keys


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for bit in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - CHECK_BITS))
    return rest


def _error_table() -> np.ndarray:
    """For each syndrome the errors of at most four bits that have it: one, or one of three bits and five of four; -1 fills up."""
    table = np.full((1 << CHECK_BITS, 6), -1, np.int64)
    used = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(CODE_BITS), weight)] or [0], np.int64)
        for syndrome, error in zip(_syndromes(errors).tolist(), errors.tolist(), strict=True):
            table[syndrome, used[syndrome]] = error
            used[syndrome] += 1
    return table


_ERRORS = _error_table()


def code_indices(words: np.ndarray) -> np.ndarray:
    """Indices of the code words within four bits of each 23-bit word, as rows of six; -1 fills up."""
    errors = _ERRORS[_syndromes(words)]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> CHECK_BITS, -1)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the fingerprint): fingerprints within RADIUS bits share a key."""
    plain = fps.view(np.uint64)
    parts = [((plain >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    codes = [code_indices(p) for p in parts]
    keys, owners = [], []

    def give(kind: int, values: np.ndarray, valid: np.ndarray) -> None:
        owner = np.nonzero(valid)[0]
        keys.append(values[valid] | (kind << 40))
        owners.append(owner)

    a, b, c = codes[0][:, :, None, None], codes[1][:, None, :, None], codes[2][:, None, None, :]
    give(0, (a << 24) | (b << 12) | c, (a >= 0) & (b >= 0) & (c >= 0))
    pairs = [(i, j) for i in range(3) for j in range(3) if i != j]
    for kind, (i, j) in enumerate(pairs, 1):
        give(kind, (parts[i][:, None] << 12) | codes[j], codes[j] >= 0)
    return np.concatenate(keys), np.concatenate(owners)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for i in range(0, len(fps), KEYED):
            part = fps[i : i + KEYED]
            keys, owners = golay_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[owners])], ["key", "fp"])


# --- links


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS


def spanning_forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct fingerprints that keep together what is linked: at most one fewer than fingerprints."""
    left, right = [], []
    waiting = fps
    while len(waiting):
        frontier, waiting = [waiting[0]], waiting[1:]
        while frontier and len(waiting):
            at = frontier.pop()
            near = _near(waiting, np.int64(at))
            found = waiting[near]
            if len(found):
                left.append(np.full(len(found), at, np.int64))
                right.append(found)
                frontier += found.tolist()
                waiting = waiting[~near]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _links(lefts: list[np.ndarray], rights: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lefts, rights))
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return pa.RecordBatch.from_arrays([pa.array(low[new]), pa.array(high[new]), pa.array(np.zeros(int(new.sum()), np.int64))], schema=_LINKS)


def _linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    """Links within the keys of sorted rows that hold whole keys."""
    lefts, rights = [], []
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    k, f = keys[small], fps[small]
    for step in range(1, SMALL):
        if len(k) <= step:
            break
        pair = np.flatnonzero((k[step:] == k[:-step]) & _near(f[step:], f[:-step]))
        lefts.append(f[pair])
        rights.append(f[pair + step])
    for i in np.flatnonzero(sizes > SMALL):
        a, b = spanning_forest(fps[starts[i] : starts[i] + sizes[i]])
        lefts.append(a)
        rights.append(b)
    return _links(lefts, rights)


def _stream(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, fp). A key of over ``hot`` rows is only counted: (key, key, rows)."""
    keys, fps, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # seen: rows of keys[0] that were let go

    def close() -> Iterator[pa.RecordBatch]:
        """Give what is held, whole keys only."""
        nonlocal keys, fps, seen
        if seen:
            own = int(np.searchsorted(keys, hot_key, "right"))
            yield pa.RecordBatch.from_arrays([pa.array([hot_key]), pa.array([hot_key]), pa.array([seen + own])], schema=_LINKS)
            keys, fps, seen = keys[own:], fps[own:], 0
        yield _linked(keys, fps)

    hot_key = None
    for batch in batches:
        keys, fps = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([fps, batch.column(1).to_numpy()])
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
        if last:
            rest = keys[last:], fps[last:]
            keys, fps = keys[:last], fps[:last]
            yield from close()
            keys, fps = rest
        if seen or len(keys) > hot:
            hot_key = int(keys[0])
            seen += len(keys)
            keys, fps = keys[:0], fps[:0]
    yield from close()


def _block_pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = spanning_forest(np.unique(pdf["fp"].to_numpy()))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def dealt(fps: DataFrame) -> DataFrame:
    """Fingerprints over all tasks: few bytes come in and many keys go out, so none should get more than its share.

    By a hash of the column: by the column itself rows that an aggregate has dealt already would stay where they are.
    """
    return fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column ``fp`` that keep together whatever is within RADIUS bits.

    Not all pairs are given, but whoever follows the links reaches exactly what all pairs would reach.
    """
    keyed = dealt(fps).mapInArrow(_keys, "key long, fp long")
    swept = cut_lineage(
        keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(partial(_stream, hot=hot), "a long, b long, n long")
    )
    found = swept.where("n = 0").select("a", "b")
    # at most rows / hot keys
    busy = swept.where("n > 0").select(F.col("a").alias("key"), F.ceil(F.col("n") / hot).alias("blocks"))
    if busy.isEmpty():
        return found.distinct()
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    spread = keyed.join(F.broadcast(busy), "key").select("key", "fp", own.alias("own"), other.alias("other"))
    paired = spread.select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return found.union(paired.groupBy("key", "i", "j").applyInPandas(_block_pair, "a long, b long")).distinct()


# --- documents


def _classes(docs: DataFrame, k: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(doc, text_key, fp) of every row; (fp, component, keeper) of every fingerprint."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    rows = cut_lineage(narrow.mapInArrow(partial(_fingerprints, k=k), "doc long, text_key long, fp long"))
    first = rows.groupBy("fp").agg(F.min(F.struct("doc", "text_key")).alias("first"))
    roots = components(links(first.select("fp"), hot)).select(F.col("node").alias("fp"), "root")
    own = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = own.groupBy("root").agg(F.min("first").alias("keeper"))
    return rows, own.join(named, "root").select("fp", F.col("keeper.doc").alias("component"), "keeper")


def near_duplicates(docs: DataFrame, shingle_words: int = 4, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of documents(doc_id, text).

    Texts have A-Z in lower case and are split at blanks; a fingerprint bit is set where over half of the XXH64
    (seed 42) of all word shingles have it. A text with fewer words is one shingle, one without words has
    fingerprint zero. Rows are linked where fingerprints differ in at most four bits; component_id is the
    smallest doc_id that links reach, itself included. A null doc_id counts as larger than all others and gives
    null where it is the smallest. Equal rows are all returned; other columns are ignored.
    """
    rows, classes = _classes(docs, shingle_words, hot)
    ided = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(classes, "fp").select(ided("doc").alias("doc_id"), text.alias("fingerprint"), ided("component").alias("component_id"))


# --- near copies


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The distinct 64-bit shingle hashes of each text in order."""
    found: list = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    parts: list[bytes] = []
    owners: list[int] = []

    def flush() -> None:
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        hashes, part = _shingles(np.frombuffer(b"".join(parts), np.uint8), offsets, k)
        found.append((hashes, np.array(owners, np.int64)[part]))
        parts.clear()
        owners.clear()

    size = 0
    for i, text in enumerate(texts):
        for piece in _pieces(text, k) if len(text) > TEXT_BYTES else (text,):
            parts.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= TEXT_BYTES:
                flush()
                size = 0
    if parts:
        flush()
    hashes, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts)))) if texts else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _band_keys(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Keys of filled sets, a row each: bands of BAND smallest hashes under different permutations."""
    bands = math.ceil(math.log(MISSED) / math.log1p(-(similarity**BAND))) if similarity < 1 else 1
    draw = np.random.default_rng(1)
    factors = draw.integers(0, 1 << 63, bands * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
    terms = draw.integers(0, 1 << 63, bands * BAND, np.uint64)
    hashes = np.concatenate(sets)
    starts = np.cumsum([0, *[len(x) for x in sets[:-1]]])
    keys = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band, np.uint64)
        for j in range(band * BAND, (band + 1) * BAND):
            key = _mixed(key ^ np.minimum.reduceat(hashes * factors[j] + terms[j], starts))
        keys[:, band] = key
    return keys


def _size_classes(most: int, similarity: float) -> list[int]:
    """Least size of each class, up to the first that is over ``most``: similar sets are of one class or of two in a row."""
    least = [1]
    while least[-1] <= most:
        least.append(int(least[-1] / similarity + 1e-9) + 1)
    return least


def _complete_keys(sets: list[np.ndarray], similarity: float) -> list[np.ndarray]:
    """Keys of small filled sets of which similar sets always share one.

    The sets of two classes in a row differ in at most ``apart`` hashes if they are similar, so of more parts than that, into
    which hashes fall by their value, one at least is equal. Only where a set fills no more than ``apart`` parts may all equal ones
    be empty; then its empty parts have keys too.
    """
    sizes = np.array([len(x) for x in sets])
    least = np.array(_size_classes(int(sizes.max()), similarity))
    least = np.append(least, int(least[-1] / similarity + 1e-9) + 1)
    hashes = _mixed(np.concatenate(sets))
    keys, owners = [], []
    for step in (0, 1):
        pair = np.searchsorted(least, sizes, "right") - 1 + step
        apart = (2 * (least[pair + 1] - 1) * (1 - similarity) / (1 + similarity) + 1e-9).astype(np.int64)
        parts = np.where(apart > 0, apart + 3 + apart // 4, 1)
        begin = np.cumsum(parts) - parts
        place = np.repeat(begin, sizes) + (hashes % np.repeat(parts, sizes).astype(np.uint64)).astype(np.int64)
        total = np.zeros(parts.sum(), np.uint64)
        np.add.at(total, place, hashes)
        owner = np.repeat(np.arange(len(sets)), parts)
        filled = np.bincount(place, minlength=len(total)) > 0
        few = np.bincount(owner, filled, len(sets)) <= apart
        number = (np.arange(len(total)) - begin[owner]).astype(np.uint64) | (pair[owner].astype(np.uint64) << np.uint64(32))
        given = filled | few[owner]
        keys.append(_mixed(total ^ _mixed(number + np.uint64(1)))[given])
        owners.append(owner[given])
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.split(key[order], np.searchsorted(owner[order], np.arange(1, len(sets))))


def near_keys(sets: list[np.ndarray], similarity: float) -> list[np.ndarray]:
    """Keys of each shingle set: sets that are similar enough share one, but for a share of MISSED of large ones at the threshold.

    Sets without shingles share one key.
    """
    keys = [[] if len(x) else [np.zeros(1, np.uint64)] for x in sets]
    # sizes that a small set and its like may have need both
    for least, most, give in ((1, COMPLETE / similarity + 1e-9, _complete_keys), (COMPLETE + 1, math.inf, _band_keys)):
        own = [i for i, x in enumerate(sets) if least <= len(x) <= most]
        for i, row in zip(own, give([sets[i] for i in own], similarity) if own else (), strict=True):
            keys[i].append(row)
    return [np.unique(np.concatenate(x)).view(np.int64) for x in keys]


def similar_forest(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links between the numbers of shingle sets that keep together what is similar enough, by their whole sets."""
    sizes = np.array([len(x) for x in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    many = np.bincount(ids)
    first = np.cumsum(many) - many
    waiting = np.ones(len(sets), bool)
    left, right = [], []
    for start in range(len(sets)):
        frontier = [start] if waiting[start] else []
        waiting[start] = False
        while frontier and waiting.any():
            at = frontier.pop()
            own = ids[ends[at] - sizes[at] : ends[at]]
            # who holds each of its shingles
            n = many[own]
            places = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(holders[places], minlength=len(sets))
            near = np.flatnonzero(waiting & (both >= 1) & (both / np.maximum(sizes[at] + sizes - both, 1) >= similarity) if sizes[at] else waiting & (sizes == 0))
            waiting[near] = False
            left += [at] * len(near)
            right += near.tolist()
            frontier += near.tolist()
    return left, right


def _keyed(batches: Iterator[pa.RecordBatch], k: int, similarity: float, fingerprint_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SUMMARISED):
            part = batch.slice(i, SUMMARISED)
            texts = [(t or "").encode() for t in part.column(2).to_pylist()]
            size, fps = pa.array([len(t) for t in texts], pa.int64()), pa.array(fingerprint_texts(texts, fingerprint_words), pa.int64())
            keys = pa.array(near_keys(shingle_sets(texts, k), similarity), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), size, fps, keys], ["doc", "node", "bytes", "fp", "keys"])


def _compared(pdf: pd.DataFrame, k: int, similarity: float) -> pd.DataFrame:
    nodes = pdf["node"].to_numpy()
    a, b = similar_forest(shingle_sets([t.encode() for t in pdf["text"]], k), similarity)
    return pd.DataFrame({"a": nodes[a], "b": nodes[b]}, dtype="int64")


def fingerprint_links(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links between the nodes of texts(node, fp) that keep together equal fingerprints and those that ``links`` joins."""
    hubs = cut_lineage(texts.groupBy("fp").agg(F.min("node").alias("hub"), F.max("node").alias("last")))
    equal = texts.join(hubs.where("hub < last"), "fp").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    a, b = (hubs.select(F.col("fp").alias(f"fp_{x}"), F.col("hub").alias(x)) for x in ("a", "b"))
    near = links(hubs.select("fp"), hot).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return equal.union(near.join(a, "fp_a").join(b, "fp_b").select("a", "b"))


def similar_links(docs: DataFrame, texts: DataFrame, k: int, similarity: float, block_texts: int = BLOCK_TEXTS, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """(a, b): links that keep together whichever of texts(node, doc, bytes, fp, keys) have shingle sets that are similar enough.

    What fingerprints link or what shares a key, directly or by way of others, makes a set of candidates. Each set goes to
    one task with its texts from docs(doc, node, text), where every two are compared by their whole shingle sets unless links
    join them already; a large one is worked on in pairs of blocks.
    """
    one = texts.select("node", F.explode("keys").alias("key"))
    hubs = one.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key", "a")
    keyed = one.join(hubs, "key").where("node <> a").select("a", F.col("node").alias("b"))
    met = components(fingerprint_links(texts, hot).union(keyed))
    members = texts.select("node", "doc", "bytes").join(met, "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block_texts, F.sum("bytes") / block_bytes, F.lit(1)))
    members = members.join(members.groupBy("root").agg(blocks.alias("blocks")), "root")
    whole = docs.join(members, ["doc", "node"]).dropDuplicates(["doc", "node"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    spread = whole.select("root", "node", "text", own.alias("own"), other.alias("other"))
    paired = spread.select("root", "node", "text", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return paired.groupBy("root", "i", "j").applyInPandas(partial(_compared, k=k, similarity=similarity), "a long, b long")


def keep_one(
    docs: DataFrame, shingle_words: int = 5, similarity: float = SIMILARITY, block_texts: int = BLOCK_TEXTS, block_bytes: int = BLOCK_BYTES,
    fingerprint_words: int = 4, hot: int = HOT,
) -> DataFrame:
    """documents with all their columns, one row of each group of near copies: that of the smallest doc_id, of equals one.

    Texts are grouped where links reach, each between two texts whose sets of word shingles have at least the given share
    in common, counted on the whole sets. Texts without words are one group. Texts are compared where their fingerprints are
    linked as in ``near_duplicates`` and, since texts of that similarity often differ in more bits, where keys of their sets meet.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    narrow = docs.select(doc.alias("doc"), F.xxhash64(text).alias("node"), text.alias("text"))
    rows = cut_lineage(narrow.mapInArrow(partial(_keyed, k=shingle_words, similarity=similarity, fingerprint_words=fingerprint_words), "doc long, node long, bytes long, fp long, keys array<long>"))
    texts = cut_lineage(rows.groupBy("node").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("bytes", "fp", "keys")]))
    roots = components(similar_links(narrow, texts, shingle_words, similarity, block_texts, block_bytes, hot))
    named = texts.select("node", "doc").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("doc", "node")).alias("keeper"))
    keepers = named.select(F.col("keeper.doc").alias("_doc"), F.col("keeper.node").alias("_key"))
    row = docs.select(doc.alias("_doc"), F.xxhash64(text).alias("_key"), F.struct("*").alias("_row"))
    kept = row.join(keepers, ["_doc", "_key"]).dropDuplicates(["_doc", "_key"])
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
