"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is a sequence of tokens: its words in lower case, then one end. A token is spelled byte by byte, a byte as
bits along a prefix code. Several predictors, each with its own hashed context within the token, give a
probability for the next bit; gated weights combine them in the logistic domain, and a second table, indexed by the
bit and the combined probability, refines the result. The predictors count every distinct token of the training texts
once, since what is left to spell is mostly new; their weights are learned online, each token as if it had not been
counted itself. A token's own count in the training texts, discounted, comes on top: over all texts, and over the texts
of a few classes, told apart by their bytes, which gate it. Each text adapts to the tokens it has used so far,
and to the class that has predicted them best.

Across words, bits are mixed too: a known token's code opens with a few bits, its lead, that say in which part of the
vocabulary it lies. Three predictors, without a context, with the word before and with the two words before as hashed
contexts, are mixed in the logistic domain for each of these bits, at every occurrence. What lies behind the lead is
spelt as above, so probabilities still sum to one: a token's own one is divided by that of its part of the vocabulary.

What a token's spelling costs depends on nothing outside it, so it is computed once for each distinct token of the
corpus. Texts are dealt into chunks of bounded size, the distinct tokens of a chunk fetch their counts and
probabilities, and the chunk's texts are summed up from them, each occurrence with its lead after the words before.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import cut_lineage

#: The end of a text, and what closes the spelling of a word; neither occurs in a word.
END, STOP = b"\n", 32
#: Hash bits of each predictor's table: position, one to four bytes before, the whole token so far.
TABLE_BITS = (12, 16, 18, 18, 20, 20)
WHOLE = len(TABLE_BITS) - 1
#: Bits of a lead; hash bits of the word before and of the one before that; rounds of learning over all counted leads.
LEAD_BITS, WORD_BITS, LEAD_ROUNDS = 4, (12, 5), 4
LEADS, WORD_ROWS = 1 << LEAD_BITS, 1 << sum(WORD_BITS)
#: Pseudo-counts of each bit; learning rate of the weights; strength of the combined probability in the second table.
PRIOR, LEARN, TRUST = 0.4, 0.5, 30.0
#: What each seen token gives up for unseen ones; weight of the corpus against the text itself, in tokens.
DISCOUNT, CORPUS = 0.75, 2000.0
#: Classes of texts; training texts that their centres start from and the least bytes of these; rounds over all training texts.
CLASSES, CLASS_TEXTS, CLASS_LEAST, CLASS_ROUNDS = 6, 2000, 300, 5
#: Steps of a stored root of a share.
SHARE_STEPS = 65535
#: Steps of the second table over the logit, from -LIMIT to LIMIT.
CELLS, LIMIT = 24, 8.0
#: Bytes of text in a chunk, distinct tokens in a task, tokens that are worked on at once.
CHUNK_BYTES, TASK_TOKENS, STEP = 16_000_000, 500_000, 1024
#: Bytes of text whose distinct tokens are found at once; bytes whose words are hashed at once; tokens of texts that are summed up at once.
SLICE_BYTES, HASH_BYTES, SUM_TOKENS = 16_000_000, 400_000, 1 << 15
#: Bytes of a word up to which it is hashed beside others.
HASHED_LENGTH = 64
BLOCK_CELLS = 1 << 14
_OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])]).astype(np.int64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def tokens_of(text: str | None) -> list[bytes]:
    """Words, split at ASCII blanks, with A-Z in lower case."""
    return (text or "").encode().lower().split()


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, how many) of runs of texts of about ``most`` bytes together; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + most, "right")))
        yield first, last - first
        first = last


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of ``tokens_of`` of all texts, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # blanks at a text's ends leave empty words
    ends = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy()]
    return (words if full.all() else words.filter(pa.array(full))).cast(pa.binary()), np.diff(ends)


def _but_last(sizes: np.ndarray) -> np.ndarray:
    """Whether an element is not the last of its group."""
    out = np.ones(int(sizes.sum()), bool)
    out[np.cumsum(sizes) - 1] = False
    return out


def numbered(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, END the last of them; number of each text's tokens in these, one text after the other; tokens of each text)."""
    parts = [words_of(part) for part in (texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts])]
    encoded = pa.chunked_array([words for words, _ in parts], pa.binary()).dictionary_encode().unify_dictionaries()
    tokens = pa.concat_arrays([encoded.chunk(0).dictionary if encoded.num_chunks else pa.array([], pa.binary()), pa.array([END], pa.binary())])
    sizes = np.concatenate([n for _, n in parts]) + 1 if parts else np.zeros(0, np.int64)
    numbers = np.full(int(sizes.sum()), len(tokens) - 1, np.int32)
    numbers[_but_last(sizes)] = np.concatenate([chunk.indices.to_numpy() for chunk in encoded.chunks]) if encoded.num_chunks else 0
    return tokens, numbers, sizes


def _as_bytes(column: pa.Array) -> list[bytes]:
    return column.to_numpy(zero_copy_only=False).tolist()


# --- spelling


def prefix_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of each byte, inner nodes on its way, bits on its way) of an optimal prefix code; no byte is without a code."""
    heap = [(float(c) + 1e-3, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children: list[tuple] = []
    while len(heap) > 1:
        (x, _, a), (y, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        node = 256 + len(children)
        children.append((a, b))
        heapq.heappush(heap, (x + y, node, node))
    way: dict[int, list[tuple[int, int]]] = {255 + len(children): []}
    for node in range(255 + len(children), 255, -1):
        for bit, child in enumerate(children[node - 256]):
            way[child] = [*way[node], (node - 256, bit)]
    longest = max(len(way[b]) for b in range(256))
    length = np.array([len(way[b]) for b in range(256)], np.int64)
    nodes, bits = np.zeros((256, longest), np.int64), np.zeros((256, longest), np.int64)
    for b in range(256):
        for j, (node, bit) in enumerate(way[b]):
            nodes[b, j], bits[b, j] = node, bit
    return length, nodes, bits


@dataclass
class Bits:
    """The bits of some tokens, one after the other."""

    token: np.ndarray  # whose bit it is
    bit: np.ndarray
    node: np.ndarray
    place: np.ndarray  # position of its byte, 3 for all later ones
    slots: list[np.ndarray]  # for each predictor, where its counts are


def spell(tokens: list[bytes], code: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Bits:
    length, nodes, bits = code
    whole = [t if t == END else t + b" " for t in tokens]
    size = np.fromiter(map(len, whole), np.int64, len(whole))
    data = np.frombuffer(b"".join(whole), np.uint8).astype(np.int64)
    start = np.repeat(np.cumsum(size) - size, size)
    pos = np.arange(len(data)) - start
    owner = np.repeat(np.arange(len(whole)), size)
    power = np.cumprod(np.full(int(size.max(initial=1)), 0x100000001B3, np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[pos])])
    contexts = [np.minimum(pos, 3).astype(np.uint64)]
    recent = np.zeros(len(data), np.uint64)
    for back in range(1, 5):
        before = np.where(pos >= back, data[np.maximum(np.arange(len(data)) - back, 0)] + 1, 0)
        recent = recent * np.uint64(257) + before.astype(np.uint64)
        contexts.append(recent)
    contexts.append(sums[:-1] - sums[start])
    n_bits = length[data]
    byte = np.repeat(np.arange(len(data)), n_bits)
    # where a bit stands in the code's tables, row after row
    at = np.take(data * nodes.shape[1] - (np.cumsum(n_bits) - n_bits), byte)
    at += np.arange(len(byte))
    node = np.take(nodes, at)
    salt = np.take(_SALTS, node)
    slots = []
    high = np.empty(len(byte), np.uint64)
    for k, (context, width) in enumerate(zip(contexts, TABLE_BITS, strict=True)):
        mixed = np.take(context * _MIX + np.uint64(k), byte)
        mixed ^= salt
        np.right_shift(mixed, np.uint64(32), out=high)
        mixed ^= high
        mixed *= _MIX
        mixed >>= np.uint64(64 - width)
        slot = mixed.view(np.int64)
        slot += _OFFSETS[k]
        slots.append(slot)
    return Bits(np.take(owner, byte), np.take(bits, at), node, np.take(np.minimum(pos, 3), byte), slots)


# --- the model


@dataclass
class Mixer:
    code: tuple[np.ndarray, np.ndarray, np.ndarray]
    counts: np.ndarray  # (2, cells): how often each bit followed
    by_place: np.ndarray
    by_support: np.ndarray
    refined: np.ndarray | None = None  # (2, nodes * CELLS): how often each bit followed, by node and logit
    cells: tuple | None = None  # what ``inputs`` reads of every cell, made where it is first asked for

    @staticmethod
    def fresh(code: tuple[np.ndarray, np.ndarray, np.ndarray], counts: np.ndarray) -> Mixer:
        n = len(TABLE_BITS) + 1
        return Mixer(code, counts, np.full((4 * 256, n), 0.2, np.float64), np.zeros((48, n), np.float64))

    def inputs(self, b: Bits, less: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretched predictions and a constant, gate by place and node, gate by support); ``less`` occurrences of each bit are taken out."""
        if self.cells is None or self.cells[0] != less:
            self.cells = (less, *self._cells(less))
        _, stretched, gates = self.cells
        x = np.empty((len(TABLE_BITS) + 1, len(b.bit)))
        base = b.bit * self.counts.shape[1] if less else 0
        gate = np.zeros(len(b.bit), np.int64)
        for k, slot in enumerate(b.slots):
            at = slot + base
            x[k] = np.take(stretched, at)
            if k >= WHOLE - 1:
                gate += np.take(gates, at)
        x[-1] = 0.3
        return x, b.place * 256 + b.node, gate

    def _cells(self, less: float) -> tuple[np.ndarray, np.ndarray]:
        """Each cell's stretched prediction and its part of the gate by support, for both bits in turn if ``less`` occurrences are taken out."""
        stretched, gates = [], []
        for bit in (0, 1) if less else (0,):
            zero, one = (np.maximum(n - np.float32(less * (bit == i)), 0) for i, n in enumerate(self.counts))
            stretched.append(np.log((one + np.float32(PRIOR)) / (zero + np.float32(PRIOR))))
            support = np.log2(1 + zero + one)
            gate = np.minimum(support / 4, 3).astype(np.uint8)
            gate[_OFFSETS[WHOLE] :] = np.minimum(support[_OFFSETS[WHOLE] :], 11).astype(np.uint8) * 4
            gates.append(gate)
        return np.concatenate(stretched), np.concatenate(gates)

    def logits(self, x: np.ndarray, place: np.ndarray, support: np.ndarray) -> np.ndarray:
        total = np.zeros(x.shape[1])
        for by_place, by_support, row in zip(np.ascontiguousarray(self.by_place.T), np.ascontiguousarray(self.by_support.T), x):
            weight = np.take(by_place, place)
            weight += np.take(by_support, support)
            weight *= row
            total += weight
        return np.clip(total, -LIMIT * 2, LIMIT * 2)

    def cell(self, node: np.ndarray, logit: np.ndarray) -> np.ndarray:
        step = np.clip((logit + LIMIT) * (CELLS / (2 * LIMIT)), 0, CELLS - 1).astype(np.int64)
        return node * CELLS + step

    def learn(self, tokens: list[bytes], rate: float, seen: np.ndarray) -> None:
        """One online step over distinct tokens: seen[bit] gathers what the second table needs."""
        b = spell(tokens, self.code)
        x, place, support = self.inputs(b, 1.0)
        logit = self.logits(x, place, support)
        cell = self.cell(b.node, logit)
        for bit in (0, 1):
            seen[bit] += np.bincount(cell[b.bit == bit], minlength=seen.shape[1])
        pull = b.bit - 1 / (1 + np.exp(-logit))
        x *= pull
        for table, gate in ((self.by_place, place), (self.by_support, support)):
            total = np.maximum(np.bincount(gate, minlength=len(table)), 1)
            for k in range(len(x)):
                table[:, k] += rate * np.bincount(gate, x[k], len(table)) / total

    def log10(self, tokens: list[bytes]) -> np.ndarray:
        """log10 probability of each token."""
        b = spell(tokens, self.code)
        x, place, support = self.inputs(b)
        logit = self.logits(x, place, support)
        one = 1 / (1 + np.exp(-logit))
        if self.refined is not None:
            cell = self.cell(b.node, logit)
            n0, n1 = self.refined[0][cell], self.refined[1][cell]
            one = (one + (n1 + TRUST * one) / (n0 + n1 + TRUST)) / 2
        p = np.where(b.bit == 1, one, 1 - one)
        return np.bincount(b.token, np.log(np.maximum(p, 1e-12)), len(tokens)) / math.log(10)


# --- leads, in the context of the words before


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def word_hashes(words: pa.Array) -> np.ndarray:
    """``hashes`` of an Arrow column without nulls, a byte of all words at a time."""
    if not len(words):
        return np.zeros(0, np.uint32)
    _, offsets, data = words.buffers()
    starts = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    sizes = np.diff(starts)
    order = np.argsort(-np.minimum(sizes, HASHED_LENGTH + 1).astype(np.int16), kind="stable")
    at, ordered, table = starts[order], sizes[order], _crc_table()
    out = np.full(len(words), 0xFFFFFFFF, np.uint32)
    more = np.searchsorted(-ordered, -np.arange(min(HASHED_LENGTH, int(sizes.max()))))  # words of more bytes than 0, 1, ...
    for n in more:
        crc = out[:n]
        out[:n] = np.take(table, (crc ^ np.take(data, at[:n])) & np.uint32(255)) ^ (crc >> np.uint32(8))
        at[:n] += 1
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(ordered > HASHED_LENGTH):
        first = int(starts[order[i]])
        out[i] = zlib.crc32(data[first : first + int(ordered[i])])
    hashed = np.empty_like(out)
    hashed[order] = out
    return hashed


def leads_of(hashed: np.ndarray) -> np.ndarray:
    """The first bits of a known token's code."""
    return (hashed >> np.uint32(32 - LEAD_BITS)).astype(np.int64)


def word_rows(hashed: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The row of the two words before each token, texts beginning at ``starts``; an end comes before a text.

    Rows of one word before lie side by side.
    """
    end = np.uint32(zlib.crc32(END))
    before = np.concatenate([[end], hashed[:-1]]).astype(np.uint32)
    before[starts] = end
    second = np.concatenate([[end], before[:-1]]).astype(np.uint32)
    second[starts] = end
    near = (before >> np.uint32(32 - LEAD_BITS - WORD_BITS[0])) & np.uint32((1 << WORD_BITS[0]) - 1)
    far = (second >> np.uint32(32 - LEAD_BITS - sum(WORD_BITS))) & np.uint32((1 << WORD_BITS[1]) - 1)
    return (near.astype(np.int64) << WORD_BITS[1]) + far


def _lead_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each lead follows in each row of words before, over all occurrences of a task, as compressed blocks."""
    counts = np.zeros(WORD_ROWS * LEADS, np.uint32)
    some = False
    for batch in batches:
        texts = batch.column(0)
        for at in slices(texts, HASH_BYTES):
            words, sizes = words_of(texts.slice(*at))
            sizes += 1
            hashed = np.full(int(sizes.sum()), zlib.crc32(END), np.uint32)
            hashed[_but_last(sizes)] = word_hashes(words)
            np.add.at(counts, word_rows(hashed, np.cumsum(sizes) - sizes) * LEADS + leads_of(hashed), np.uint32(1))
            some = True
    if some:
        for block in range(0, len(counts), BLOCK_CELLS):
            packed = zlib.compress(counts[block : block + BLOCK_CELLS].astype(np.float64).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed], pa.binary())], ["block", "cells"])


def _bit_counts(counts: np.ndarray) -> np.ndarray:
    """(2, nodes, rows): how often each bit follows at each node of the leads' tree, from counts (rows, leads)."""
    out = np.zeros((2, LEADS, len(counts)), np.float64)
    for depth in range(LEAD_BITS):
        split = counts.reshape(len(counts), 1 << depth, 2, -1).sum(axis=3)
        out[:, 1 << depth : 2 << depth] = split.transpose(2, 1, 0)
    return out[:, 1:]


class LeadMixer:
    """The probability of each bit of a lead from counts without a context, after a word, and after two words."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.reshape(WORD_ROWS, LEADS)
        self.none = _bit_counts(self.counts.sum(axis=0, dtype=np.float64)[None])
        self.weights = np.tile(np.array([0.3, 0.4, 0.3]), (LEADS - 1, 48, 1))

    def _near(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of bits after two words in some rows, a whole number of words before, and after the word before alone."""
        two = _bit_counts(self.counts[first:last].astype(np.float64))
        each = 1 << WORD_BITS[1]
        one = two.reshape(2, LEADS - 1, -1, each).sum(axis=3)
        return two, np.repeat(one, each, axis=2)

    def _inputs(self, first: int, last: int, bit: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretched predictions, gate, how often ``bit`` follows); one occurrence of ``bit`` is taken out."""
        two, one = self._near(first, last)
        x, support = np.empty((3, *two.shape[1:])), []
        for k, (zero, ones) in enumerate((np.broadcast_to(self.none, two.shape), one, two)):
            if bit is not None:
                zero, ones = (np.maximum(zero - 1, 0), ones) if bit == 0 else (zero, np.maximum(ones - 1, 0))
            x[k] = np.log((ones + PRIOR) / (zero + PRIOR))
            support.append(np.log2(1 + zero + ones))
        gate = np.minimum(support[2], 11).astype(np.int64) * 4 + np.minimum(support[1] / 4, 3).astype(np.int64)
        return x, gate, two[bit] if bit is not None else two

    def _logits(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        node = np.arange(LEADS - 1)[:, None]
        total = sum(self.weights[node, gate, k] * x[k] for k in range(3))
        return np.clip(total, -LIMIT * 2, LIMIT * 2)

    def learn(self, rounds: int = LEAD_ROUNDS, rows: int = 1 << 13) -> LeadMixer:
        """Online steps over all counted occurrences, each as if it had not been counted itself."""
        cells = (LEADS - 1) * 48
        node = np.arange(LEADS - 1)[:, None] * 48
        for round_ in range(rounds):
            for step, first in enumerate(range(0, WORD_ROWS, rows)):
                pulls, total = np.zeros((3, cells)), np.zeros(cells)
                for bit in (0, 1):
                    x, gate, often = self._inputs(first, first + rows, bit)
                    pull = (bit - 1 / (1 + np.exp(-self._logits(x, gate)))) * often
                    at = (node + gate).ravel()
                    total += np.bincount(at, often.ravel(), cells)
                    for k in range(3):
                        pulls[k] += np.bincount(at, (pull * x[k]).ravel(), cells)
                rate = LEARN / math.sqrt(1 + step / 16 + round_)
                self.weights += rate * (pulls / np.maximum(total, 1)).T.reshape(self.weights.shape)
        return self

    def log10(self, rows: int = 1 << 13) -> np.ndarray:
        """log10 probability of each lead in each row, as one array over row * LEADS + lead."""
        out = np.empty((WORD_ROWS, LEADS), np.float32)
        for first in range(0, WORD_ROWS, rows):
            x, gate, _ = self._inputs(first, first + rows, None)
            one = 1 / (1 + np.exp(-self._logits(x, gate)))
            logs = np.zeros((LEADS, rows))
            for depth in range(LEAD_BITS):
                at = np.arange(LEADS) >> (LEAD_BITS - depth)
                bit = (np.arange(LEADS) >> (LEAD_BITS - depth - 1)) & 1
                p = one[(1 << depth) - 1 + at]
                logs += np.log10(np.where(bit[:, None] == 1, p, 1 - p))
            out[first : first + rows] = logs.T
        return out.ravel()


@dataclass
class Leads:
    log_p: np.ndarray  # log10 probability of each lead after the words before: row * LEADS + lead
    parts: np.ndarray  # (classes, leads): log10 share of the known tokens with that lead in what all known tokens have


def fit_leads(taught: DataFrame) -> np.ndarray:
    """log10 probabilities of leads from all occurrences in taught(text); what comes to the driver is of fixed size."""
    counted = taught.select("text").mapInArrow(_lead_counts, "block long, cells binary").groupBy("block").applyInPandas(_added, "block long, cells binary")
    counts = np.zeros(WORD_ROWS * LEADS, np.float32)
    for row in counted.collect():
        counts[row.block : row.block + BLOCK_CELLS] = np.frombuffer(zlib.decompress(row.cells), np.float32)
    return LeadMixer(counts).learn().log10()


def lead_parts(known: DataFrame, names: list[str], totals: np.ndarray, distincts: np.ndarray) -> np.ndarray:
    """log10 share of each lead's known tokens in those of all, by class, from known(token, counts..., log_p)."""
    lead = F.shiftrightunsigned(F.crc32("token"), 32 - LEAD_BITS).cast("int")
    kept = [F.sum(F.greatest(F.col(n) - F.lit(DISCOUNT), F.lit(0.0))).alias(n) for n in names]
    seen = known.where(sum((F.col(n) for n in names), F.lit(0)) > 0)
    own, spelt = np.zeros((len(names), LEADS)), np.zeros(LEADS)
    for row in seen.groupBy(lead.alias("lead")).agg(*kept, F.sum(F.pow(F.lit(10.0), F.col("log_p"))).alias("spelt")).collect():
        own[:, row.lead], spelt[row.lead] = [row[n] for n in names], row.spelt
    each = np.maximum(totals, 1)[:, None]
    parts = own / each + DISCOUNT * distincts[:, None] / each * spelt
    with np.errstate(divide="ignore"):
        return np.log10(parts) - np.log10(np.maximum(parts.sum(axis=1), 1e-300))[:, None]


# --- passes over the distinct tokens


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in batches:
        tokens = _as_bytes(batch.column(0))
        for i in range(0, len(tokens), STEP):
            yield tokens[i : i + STEP]


def _context_counts(batches: Iterator[pa.RecordBatch], code) -> Iterator[pa.RecordBatch]:
    """Counts of both bits in every cell, as compressed blocks."""
    counts = np.zeros((2, int(_OFFSETS[-1])), np.float64)
    flat = counts.reshape(-1)
    some = False
    for tokens in _steps(batches):
        some = True
        b = spell(tokens, code)
        base = b.bit * counts.shape[1]
        for slot in b.slots:
            np.add.at(flat, base + slot, 1.0)
    if some:
        for block in range(0, counts.shape[1], BLOCK_CELLS):
            packed = zlib.compress(counts[:, block : block + BLOCK_CELLS].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed], pa.binary())], ["block", "cells"])


def _added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), np.float64) for c in pdf["cells"])
    return pd.DataFrame({"block": [key[0]], "cells": [zlib.compress(total.astype(np.float32).tobytes(), 1)]})


def _learned(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Weights after one pass over the partition, with the tokens they rest on, and what the second table gathers."""
    mixer: Mixer = model.value
    mixer = Mixer(mixer.code, mixer.counts, mixer.by_place.copy(), mixer.by_support.copy())
    seen = np.zeros((2, 256 * CELLS))
    total = 0.0
    for step, tokens in enumerate(_steps(batches)):
        mixer.learn(tokens, LEARN / math.sqrt(1 + step / 16), seen)
        total += len(tokens)
    if total:
        columns = [[total], *[[x.tobytes()] for x in (mixer.by_place, mixer.by_support, seen)]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["n", "by_place", "by_support", "seen"])


_LEARNED = "n double, by_place binary, by_support binary, seen binary"


def _averaged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for many: weights averaged by n, gathered counts added."""
    total = float(pdf["n"].sum())
    sums = {name: sum(f * np.frombuffer(x, np.float64) for f, x in zip(share, pdf[name])) for name, share in (("by_place", pdf["n"] / total), ("by_support", pdf["n"] / total), ("seen", np.ones(len(pdf))))}
    return pd.DataFrame({"n": [total]} | {name: [x.tobytes()] for name, x in sums.items()})


def log10_share(own: np.ndarray, tokens: int, distinct: int, spelt: np.ndarray) -> np.ndarray:
    """log10 of a token's discounted share of ``tokens`` tokens, plus what the discounts leave times its spelling.

    In logarithms throughout: the spelling of a long token is far below the least double.
    """
    with np.errstate(divide="ignore"):
        kept = np.log(np.maximum(own - DISCOUNT, 0) / tokens)
    return np.logaddexp(kept, math.log(DISCOUNT * distinct / tokens) + spelt * math.log(10)) / math.log(10)


def _token_scores(batches: Iterator[pa.RecordBatch], model, total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """Adds log10 of each token's probability: its discounted share of the training tokens, and its spelling for the rest."""
    for batch in batches:
        tokens = _as_bytes(batch.column(0))
        c = sum(batch.column(1 + k).to_numpy() for k in range(CLASSES))
        spelt = [model.value.log10(tokens[i : i + STEP]) for i in range(0, len(tokens), STEP)]
        log_p = np.concatenate(spelt) if spelt else np.zeros(0)
        if total:
            log_p = log10_share(c, total, distinct, log_p)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(log_p, pa.float64())], [*batch.schema.names, "log_p"])


def fit(vocabulary: DataFrame, code) -> Mixer:
    """The mixer of vocabulary(token binary, seen boolean), from all tokens that training texts hold; at least one is needed.

    What comes to the driver is of fixed size: tables, weights and the second table. Partitions learn side by side
    and their weights are averaged by the tokens they rest on.
    """
    spark = vocabulary.sparkSession
    known = vocabulary.where("seen").select("token").sortWithinPartitions("token")  # weights follow the order
    blocks = known.mapInArrow(partial(_context_counts, code=code), "block long, cells binary").groupBy("block").applyInPandas(_added, "block long, cells binary")
    counts = np.zeros((2, int(_OFFSETS[-1])), np.float32)
    for row in blocks.collect():
        part = np.frombuffer(zlib.decompress(row.cells), np.float32).reshape(2, -1)
        counts[:, row.block : row.block + part.shape[1]] = part
    mixer = Mixer.fresh(code, counts)
    learned = known.mapInArrow(partial(_learned, model=spark.sparkContext.broadcast(mixer)), _LEARNED)
    few = learned.groupBy(F.floor(F.spark_partition_id() / 64).alias("some")).applyInPandas(_averaged, _LEARNED)
    rows = _averaged((0,), few.toPandas()).iloc[0]
    weights = [np.frombuffer(rows[name], np.float64).reshape(like) for name, like in (("by_place", mixer.by_place.shape), ("by_support", mixer.by_support.shape), ("seen", (2, 256 * CELLS)))]
    return Mixer(code, counts, *weights)


# --- documents


_LETTERS = (np.arange(256) >= 128) | ((np.arange(256) >= 97) & (np.arange(256) <= 122))


def _shares(lowered: bytes) -> np.ndarray:
    data = np.bincount(np.frombuffer(lowered, np.uint8), minlength=256) * _LETTERS
    return np.sqrt(data / max(1, data.sum()))


def profile(text: str | None) -> np.ndarray:
    """The letters of a text, a-z and the bytes of all others, as roots of their shares."""
    return _shares((text or "").encode().lower())


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each text's profile as 256 unsigned 16-bit steps to the other columns, and leaves the text out."""
    for batch in batches:
        rows = [np.rint(profile(t) * SHARE_STEPS).astype("<u2").tobytes() for t in batch["text"].to_pylist()]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(rows, pa.binary())], [*names, "profile"])


def _steps_of(profiles: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(profiles), "<u2").reshape(-1, 256)


def _steps_in(column: pa.BinaryArray) -> np.ndarray:
    """The same of an Arrow column without nulls, read where it lies."""
    if not len(column):
        return np.zeros((0, 256), "<u2")
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, "<u2", 256 * len(column), int(first)).reshape(-1, 256)


def nearest(profiles: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row."""
    return ((middle**2).sum(axis=1) - 2 * profiles @ middle.T).argmin(axis=1)


def _class_sums(batches: Iterator[pa.RecordBatch], middle: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(class, byte, sum of the steps, texts) over the texts of a task that lie nearest to the class's centre.

    Sums are whole numbers, so they do not depend on how texts lie in tasks.
    """
    sums, texts = np.zeros((CLASSES, 256), np.int64), np.zeros(CLASSES, np.int64)
    for batch in batches:
        rows = _steps_in(batch["profile"])
        near = nearest(rows / SHARE_STEPS, middle)
        for k in range(CLASSES):
            sums[k] += rows[near == k].sum(axis=0, dtype=np.int64)
        texts += np.bincount(near, minlength=CLASSES)
    classes, byte = np.divmod(np.arange(CLASSES * 256), 256)
    yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(byte), pa.array(sums.ravel()), pa.array(texts[classes])], ["k", "byte", "steps", "texts"])


def class_centres(profiles: DataFrame, start: np.ndarray, rounds: int = CLASS_ROUNDS) -> np.ndarray:
    """k-means centres after ``rounds`` over profiles(profile binary), from ``start``; a class without texts stays where it is.

    Each round brings one number for every class and byte to the driver.
    """
    middle = start.copy()
    for _ in range(rounds):
        sums = profiles.select("profile").mapInArrow(partial(_class_sums, middle=middle), "k long, byte long, steps long, texts long")
        for row in sums.groupBy("k", "byte").agg(F.sum("steps").alias("steps"), F.sum("texts").alias("texts")).collect():
            if row.texts:
                middle[row.k, row.byte] = row.steps / (row.texts * SHARE_STEPS)
    return middle


def centres(profiles: np.ndarray, k: int = CLASSES) -> np.ndarray:
    """k-means centres, begun at the rows that lie farthest from those before."""
    if not len(profiles):
        return np.zeros((k, 256))
    found = [profiles.mean(axis=0)]
    for _ in range(k - 1):
        found.append(profiles[np.min([((profiles - c) ** 2).sum(axis=1) for c in found], axis=0).argmax()])
    out = np.array(found)
    for _ in range(20):
        near = ((profiles[:, None] - out[None]) ** 2).sum(axis=2).argmin(axis=1)
        out = np.array([profiles[near == i].mean(axis=0) if (near == i).any() else out[i] for i in range(k)])
    return out


def _counted(batches: Iterator[pa.RecordBatch], middle: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, how often it is in training texts of each class) of the distinct tokens of slices of a task's texts."""
    names = ["token", *[f"c{k}" for k in range(CLASSES)]]
    for batch in batches:
        for at in slices(batch.column(0), SLICE_BYTES):
            texts, held_out = batch.column(0).slice(*at), batch.column(1).slice(*at).to_numpy(zero_copy_only=False)
            tokens, numbers, sizes = numbered(texts)
            profiles = np.array([profile(text) for text in texts.to_pylist()])
            # a held-out text's tokens are named, not counted
            owner = np.where(held_out, CLASSES, nearest(profiles, middle))
            cell = numbers + np.repeat(owner, sizes) * len(tokens)
            c = np.bincount(cell, minlength=(CLASSES + 1) * len(tokens)).reshape(CLASSES + 1, -1)
            yield pa.RecordBatch.from_arrays([tokens, *[pa.array(c[k]) for k in range(CLASSES)]], names)


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.float64)
    for tokens in _steps(batches):
        whole = b"".join(t if t == END else t + b" " for t in tokens)
        total += np.bincount(np.frombuffer(whole, np.uint8), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])


def _chunk_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, place in sorted order, token) of the distinct tokens of each chunk; a chunk's rows come one after the other."""

    def given(chunk: int, parts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        tokens = pa.concat_arrays([pa.chunked_array(parts, pa.binary()).unique(), pa.array([END], pa.binary())])
        tokens = tokens.take(pc.array_sort_indices(tokens))
        for i in range(0, len(tokens), 100_000):
            part = tokens.slice(i, 100_000)
            columns = [pa.array(np.full(len(part), chunk, np.int64)), pa.array(np.arange(i, i + len(part), dtype=np.int32)), part]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "place", "token"])

    current, parts = None, []
    for batch in batches:
        chunks = batch["chunk"].to_numpy()
        starts = np.flatnonzero(np.diff(chunks, prepend=chunks[:1] - 1))
        for first, last in zip(starts, [*starts[1:], len(chunks)]):
            if chunks[first] != current:
                if current is not None:
                    yield from given(current, parts)
                current, parts = int(chunks[first]), []
            texts = batch["text"].slice(first, last - first)
            parts += [words_of(texts.slice(*at))[0].unique() for at in slices(texts, SLICE_BYTES)]
    if current is not None:
        yield from given(current, parts)


_SCORES = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def earlier(keys: np.ndarray) -> np.ndarray:
    """How often each element, a whole number from 0, has occurred before."""
    bits = max(1, len(keys).bit_length())
    if len(keys) and int(keys.max()).bit_length() + bits < 64:
        # keys with their places behind them differ, so a plain sort does
        packed = np.sort((keys.astype(np.int64) << bits) | np.arange(len(keys)))
        order, ordered = packed & ((1 << bits) - 1), packed >> bits
    else:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - first
    return out


_ROW = np.dtype([("place", "<i4"), ("log_p", "<f8"), ("c", "<i8", (CLASSES,))])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, place, log_p, counts...) with one row for all that a batch holds of a chunk."""
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = batch.column(0).to_numpy()
        order = np.argsort(chunk, kind="stable")
        rows = np.zeros(len(chunk), _ROW)
        rows["place"], rows["log_p"] = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for k in range(CLASSES):
            rows["c"][:, k] = batch.column(3 + k).to_numpy()
        rows, chunk = rows[order], chunk[order]
        starts = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1))
        blobs = [zlib.compress(part.tobytes(), 1) for part in np.split(rows, starts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[starts]), pa.array(blobs, pa.binary())], ["chunk", "told"])


def _summed(texts: pa.Table, told: pa.Table, totals: np.ndarray, distincts: np.ndarray, distinct: int, leads=None) -> pa.Table:
    """The scores of one chunk's texts from the counts and probabilities of its tokens, and of leads after the words before.

    Without ``leads`` words before are no context.
    """
    if not texts.num_rows:
        return pa.schema(_SCORES).empty_table()
    known = np.concatenate([np.frombuffer(zlib.decompress(b), _ROW) for b in told["told"].to_pylist()])
    tokens, numbers, counts = numbered(texts["text"])
    if len(tokens) != len(known):
        raise RuntimeError("a chunk has other tokens than were looked up")
    row_of = np.empty(len(known), np.int64)
    row_of[pc.array_sort_indices(tokens).to_numpy()[known["place"]]] = np.arange(len(known))
    known = known[row_of]
    c, total = known["c"].sum(axis=1), int(totals.sum())
    known_token = c > 0
    if leads is not None:
        hashed = hashes(_as_bytes(tokens))
        lead = leads_of(hashed)
    # a row for each distinct token: log10 probabilities in the classes, as occurrences; the base; whether it is known
    classes = [k for k in range(CLASSES) if totals[k] or not total]
    each = len(classes)
    table = np.empty((len(known), each + 2))
    for j, k in enumerate(classes):
        log_p = log10_share(known["c"][:, k], int(totals[k]), int(distincts[k]), known["log_p"]) if total else known["log_p"]
        if leads is not None:
            log_p = np.where(known_token, log_p - leads.value.parts[k][lead], log_p)
        table[:, j] = log_p + math.log10(CORPUS)
    table[:, each], table[:, each + 1] = np.log10((c + 1) / (total + distinct + 1)), known_token
    # beside an occurrence in the text, a probability below the least double is nothing
    plain = 10.0 ** table[:, :each]
    starts = np.cumsum(counts) - counts
    sums = np.zeros((len(counts), each + 2))
    # some texts at a time, a long one in pieces, so that what is worked on stays in a cache
    begin = 0
    while begin < len(counts):
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + SUM_TOKENS)))
        low, high = int(starts[begin]), int(starts[end - 1] + counts[end - 1])
        block, own = numbers[low:high], starts[begin:end] - low
        # the text so far counts as further occurrences
        again = earlier(np.repeat(np.arange(end - begin), counts[begin:end]) * len(known) + block)
        if leads is not None:
            rows = word_rows(hashed[block], own)
        for first in range(0, high - low, SUM_TOKENS):
            piece = slice(first, first + SUM_TOKENS)
            at, seen = block[piece], np.flatnonzero(again[piece])
            step, p = np.take(table, at, axis=0), np.take(plain, at[seen], axis=0)
            if leads is not None:
                after = leads.value.log_p[rows[piece] * LEADS + lead[at]].astype(np.float64)
                after[~known_token[at]] = 0
                step[:, :each] += after[:, None]
                p *= np.exp(after[seen] * math.log(10))[:, None]
            p += again[piece][seen][:, None]
            step[seen, :each] = np.log(p) / math.log(10)
            inside = slice(np.searchsorted(own, first, "right") - 1, np.searchsorted(own, first + len(at)))
            sums[begin:end][inside] += np.add.reduceat(step, np.maximum(own[inside] - first, 0))
        begin = end
    # classes are weighed by how well they have done so far
    lengths = np.concatenate([[0.0], np.cumsum(np.log10(CORPUS + np.arange(counts.max())))])[counts]
    logs = np.full((CLASSES, len(counts)), -np.inf)
    for j, k in enumerate(classes):
        logs[k] = sums[:, j] - lengths + math.log10(totals[k] / total if total else 1 / CLASSES)
    best = logs.max(axis=0)
    score = best + np.log10((10.0 ** (logs - best)).sum(axis=0))
    columns = [
        texts["doc_id"], texts["held_out"], texts["n_bytes"], pa.array(counts),
        pa.array(sums[:, each + 1].astype(np.int64)), pa.array(sums[:, each]), pa.array(score),
    ]
    return pa.table(columns, schema=pa.schema(_SCORES))


def score_documents(docs: DataFrame, held_out: Column, chunk_bytes: int = CHUNK_BYTES, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of documents(doc_id, text).

    ``held_out`` is a boolean expression over the columns; rows where it is true (or null) teach nothing. Classes of texts are
    centres that rounds over all training texts, of any length, have found. ``base_score`` is the
    add-one unigram score, ``score`` the model's log10 probability of the text's tokens, ``bits_per_byte`` that in
    bits for each byte of the text, null for texts without bytes. Null texts are empty. Without a training
    row the bits are equally likely. Equal rows are all returned; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), text.alias("text"))
    taught = rows.where(~F.col("held_out")).select("doc_id", F.octet_length("text").alias("size"), "text")
    profiles = cut_lineage(taught.mapInArrow(_profiles, "doc_id long, size int, profile binary"))
    # the start only: the rounds that follow take all training texts
    first = profiles.where(F.col("size") >= CLASS_LEAST).orderBy(F.xxhash64("doc_id"), "doc_id", "profile").limit(CLASS_TEXTS)
    sample = sorted(bytes(r.profile) for r in first.select("profile").collect())
    middle = class_centres(profiles, centres(_steps_of(sample) / SHARE_STEPS))
    names = [f"c{k}" for k in range(CLASSES)]
    counted = rows.select("text", "held_out").mapInArrow(partial(_counted, middle=middle), "token binary, " + ", ".join(f"{n} long" for n in names))
    vocabulary = cut_lineage(counted.groupBy("token").agg(*[F.sum(n).alias(n) for n in names]))
    seen = sum((F.col(n) for n in names), F.lit(0)) > 0
    facts = vocabulary.agg(
        F.count(F.lit(1)).alias("all"), F.count_if(seen).alias("distinct"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], *[F.count_if(F.col(n) > 0).alias(f"d{n}") for n in names],
    ).first()
    totals, distincts = (np.array([facts[x + n] for n in names], np.int64) for x in ("", "d"))
    tasks = max(1, -(-facts["all"] // task_tokens))
    dealt = vocabulary.select("token", seen.alias("seen")).repartition(tasks, "token")
    bytes_seen = np.zeros(256)
    for row in dealt.where("seen").mapInArrow(_byte_counts, "byte long, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        bytes_seen[row.byte] = row.n
    code = prefix_code(bytes_seen)
    if facts["distinct"]:
        mixer = fit(dealt, code)
    else:
        mixer = Mixer.fresh(code, np.zeros((2, int(_OFFSETS[-1])), np.float32))
    scorer = partial(_token_scores, model=spark.sparkContext.broadcast(mixer), total=int(totals.sum()), distinct=facts["distinct"])
    known = cut_lineage(vocabulary.mapInArrow(scorer, "token binary, " + ", ".join(f"{n} long" for n in names) + ", log_p double"))

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // chunk_bytes))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk")
    grouped = rows.select(chunk, "text", "doc_id", "held_out", F.octet_length("text").cast("long").alias("n_bytes")).repartition(chunks, "chunk")
    # all columns go along, so that both sides read the same shuffle
    asked = grouped.sortWithinPartitions("chunk").mapInArrow(_chunk_tokens, "chunk long, place int, token binary")
    told = asked.join(known.hint("merge"), "token").select("chunk", "place", "log_p", *names).mapInArrow(_packed, "chunk long, told binary")
    leads = None
    if facts["distinct"]:
        leads = spark.sparkContext.broadcast(Leads(fit_leads(taught), lead_parts(known, names, totals, distincts)))
    sums = partial(_summed, totals=totals, distincts=distincts, distinct=facts["distinct"], leads=leads)
    scored = grouped.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        sums, "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double"
    )
    rate = F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes"))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(totals.sum())).cast("long").alias("train_tokens"), "base_score", "score", rate.alias("bits_per_byte")
    )
