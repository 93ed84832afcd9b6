"""Alignment of a byte-level and a piece tokenizer over the same bytes of a text.

Both libraries say which part of a text a token stands for: character offsets here, byte spans of a piece there.
These are coarse cuts, since several tokens of one character share its span; inside such a run the decoded
bytes of the tokens refine it. Where tokens of both kinds end at one byte the text is cut into groups, and the
two tokens that end there are linked. A chunk that many texts share is aligned once for a task.

How often a pair of ids is linked in the whole corpus is counted over a fixed list of pairs: of two tokens that
end together one ends with the other, so only pairs of ids of which one's bytes end with the other's can be
linked, which the vocabularies alone bound.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.chunks import byte_symbols, cut, cuttable, grouped, is_blank
from eventloom.llm.pieces import gather
from eventloom.session import cut_lineage

MARK = "▁"
#: Chunks that are aligned in one call.
JOINED_CHUNKS = 2048
#: Characters of the chunks that a process keeps; the table starts anew beyond, which only costs time.
TABLE_CHARS = 4_000_000
#: Characters from which a chunk is aligned by itself.
LONG_CHUNK = 1000


def byte_level_tokens(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer; a token outside its alphabet stands for its own text."""
    symbols = byte_symbols()
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return [bytes(symbols[c] for c in n) if all(c in symbols for c in n) else n.encode() for n in names]


def piece_tokens(processor) -> list[bytes]:
    """The bytes of each id of a piece model: a marker is a space, a byte piece its byte."""
    names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    return [bytes([int(n[1:-1], 16)]) if processor.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]


def linkable(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Sorted keys left * len(right) + right of all pairs of ids of which one's bytes end with the other's."""
    by_bytes: dict[bytes, list[int]] = {}
    for i, b in enumerate(right):
        by_bytes.setdefault(b, []).append(i)
    ends: dict[bytes, list[int]] = {}
    for i, a in enumerate(left):
        ends.setdefault(a, []).append(i)
    pairs = [(i, j) for i, a in enumerate(left) for k in range(len(a)) for j in by_bytes.get(a[k:], ())]
    pairs += [(i, j) for j, b in enumerate(right) for k in range(1, len(b)) for i in ends.get(b[k:], ())]
    found = np.array(pairs, np.int64).reshape(-1, 2)
    return np.unique(found[:, 0] * len(right) + found[:, 1])


def refined(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The byte at which each token ends.

    ``spans`` are the libraries' spans in bytes, one row (start, end) for each token, ``sizes`` the numbers of their decoded bytes.
    Where a span moves on and the next does not reach back behind its end is a coarse cut, and the token there
    ends with its span. Between two cuts, inside a character, tokens end where their decoded bytes do.
    """
    if not len(spans):
        return np.zeros(0, np.int64)
    ends = spans[:, 1]
    furthest = np.maximum.accumulate(ends)
    moved = ends > np.concatenate([[0], furthest[:-1]])
    clear = np.append(spans[1:, 0] >= ends[:-1], True)
    coarse = moved & clear
    decoded = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(coarse, np.arange(len(ends)), -1))  # the last coarse cut at or before each token
    inside = np.where(last >= 0, ends[last] - decoded[last], 0) + decoded
    return np.where(coarse, ends, inside)


def byte_offsets(text: str) -> np.ndarray:
    """The byte at which each character of a text starts, and its length in bytes at last."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.concatenate([[0], np.cumsum(1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF))])


class Aligner:
    """Aligned ids of distinct chunks, each with the space before it."""

    def __init__(self, tokenizer: str, model: str, limit: int = TABLE_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work over the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_file(tokenizer)
        self.left.encode_special_tokens = True
        self.right = sentencepiece.SentencePieceProcessor(model_file=model)
        self.left_bytes, self.right_bytes = byte_level_tokens(self.left), piece_tokens(self.right)
        self.left_sizes, self.right_sizes = (np.array([len(b) for b in x], np.int64) for x in (self.left_bytes, self.right_bytes))
        self.pairs = linkable(self.left_bytes, self.right_bytes)
        #: ids in writing with what follows them: a comma, or what ends the side of a group, the group or the chunk
        left, right = ([str(i) for i in range(len(x))] for x in (self.left_bytes, self.right_bytes))
        self.written = [x + sign for names, signs in ((left, ",|"), (right, ",;\n")) for sign in signs for x in names]
        self.right_at = 2 * len(left)
        # a marker inside a piece would let the piece cross a cut
        self.cuttable = cuttable(tokenizer) and not any(MARK in self.right.id_to_piece(i).lstrip(MARK) for i in range(self.right.get_piece_size()))
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # left tokens, right tokens, groups, whether the bytes agree
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(left ids, right ids, their ends in bytes) of a space and a text; None where the bytes of either differ."""
        want = b" " + text.encode()
        left = self.left.encode(" " + text, add_special_tokens=False)
        ids = left.ids
        if b"".join(map(self.left_bytes.__getitem__, ids)) != want:
            return None
        # (id, first byte, byte after the last) of each piece
        pieces = [x for p in self.right.encode(text, return_type="proto").pieces for x in (p.id, p.begin, p.end)]
        if b"".join(map(self.right_bytes.__getitem__, pieces[::3])) != want:
            return None
        a, right = np.array(ids, np.int64), np.array(pieces, np.int64).reshape(-1, 3)
        spans = np.fromiter(chain.from_iterable(left.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        if len(want) != len(text) + 1:
            spans = byte_offsets(" " + text)[spans]
        b = right[:, 0]
        # the space that the piece model adds has no place in its spans
        return a, b, refined(spans, self.left_sizes[a]), refined(right[:, 1:] + 1, self.right_sizes[b])

    def align(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """(groups in writing, sizes, keys of linked pairs) of chunks that are one text with spaces between; None where bytes differ."""
        found = self.tokens(" ".join(chunks))
        if found is None:
            return None
        a, b, a_ends, b_ends = found
        common, i, j = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[i], b_last[j] = True, True
        # tokens in the order of the groups: those of the left side of a group, then those of its right side
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        a_count, b_count = np.bincount(a_group, minlength=len(common)), np.bincount(b_group, minlength=len(common))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(b_count) - b_count)[a_group]] = a + np.where(a_last, len(self.left_bytes), 0)
        upto = np.cumsum([len(c.encode()) + 1 for c in chunks])
        closes = np.isin(b_ends, upto)
        order[np.arange(len(b)) + np.cumsum(a_count)[b_group]] = self.right_at + b + len(self.right_bytes) * (b_last.astype(np.int64) + closes)
        written = "".join([self.written[k] for k in order.tolist()]).split("\n")[:-1]
        per = [np.diff(np.searchsorted(x, upto, side="right"), prepend=0) for x in (a_ends, b_ends, common)]
        sizes = np.stack([*per, np.ones(len(chunks), np.int64)], axis=1)
        return written, sizes, a[i] * len(self.right_bytes) + b[j]

    def add(self, chunks: Iterable[str]) -> None:
        new = [c for c in dict.fromkeys(chunks) if c not in self.index]
        alone = [not self.cuttable or len(c) >= LONG_CHUNK or MARK in c or is_blank(c[:1]) or is_blank(c[-1:]) for c in new]
        plain = [c for c, x in zip(new, alone, strict=True) if not x]
        parts = [plain[i : i + JOINED_CHUNKS] for i in range(0, len(plain), JOINED_CHUNKS)]
        parts += [[c] for c, x in zip(new, alone, strict=True) if x]
        groups, sizes, keys = [], [self.sizes], []
        while parts:
            part = parts.pop()
            found = self.align(part)
            if found is None and len(part) > 1:
                parts += [part[: len(part) // 2], part[len(part) // 2 :]]
                continue
            base = len(self.index)
            self.index.update(zip(part, range(base, base + len(part)), strict=True))
            written, size, key = found if found is not None else ([""], np.zeros((1, 4), np.int64), np.zeros(0, np.int64))
            groups += written
            sizes.append(size)
            keys.append(key)
        if not groups:
            return
        key = np.concatenate(keys)
        places = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        if not np.array_equal(self.pairs[places], key):
            raise AssertionError("tokens that end together must be a linkable pair")
        self.chars += sum(map(len, new))
        self.groups += groups
        self.sizes = np.concatenate(sizes)
        self.flat = np.concatenate([self.flat, places.astype(np.uint32)])
        self.starts = np.cumsum(self.sizes[:, 2]) - self.sizes[:, 2]

    def encode(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """(left tokens, right tokens, groups, groups in writing, numbers of the linked pairs) of each text."""
        cuts = [(cut(t) if self.cuttable else [t]) if t else [] for t in texts]
        if self.chars > self.limit:
            self.clear()
        self.add(chain.from_iterable(cuts))
        counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
        where = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cuts)), np.int64, int(counts.sum()))
        sizes = self.sizes[where]
        links = gather(self.flat, self.starts[where], sizes[:, 2])
        totals = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(sizes, axis=0)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        written = self.groups
        nothing = np.zeros(0, np.uint32)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n_a, n_b, n_groups, good = (totals[b] - totals[a]).tolist()
            if a == b or good < b - a:
                yield 0, 0, 0, "", nothing
            else:
                yield n_a, n_b, n_groups, ";".join([written[w] for w in where[a:b].tolist()]), links[totals[a, 2] : totals[b, 2]]


@lru_cache(maxsize=1)
def _aligner(tokenizer: str, model: str) -> Aligner:
    """One aligner and table for all tasks of a worker process."""
    return Aligner(tokenizer, model)


def _align(batches: Iterator[pa.RecordBatch], tokenizer: str, model: str, form: str) -> Iterator[pa.RecordBatch]:
    aligner = _aligner(tokenizer, model)
    for batch in batches:
        rows = []
        for group in grouped(t or "" for t in batch.column(1).to_pylist()):
            for n_a, n_b, n_groups, groups, links in aligner.encode(group):
                if form == "digest":
                    groups = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
                rows.append((n_a, n_b, n_groups, groups, links.astype("<u4").tobytes()))
        values = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate([pa.int64()] * 3 + [pa.string(), pa.binary()])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *values], ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])


def _pair_counts(batches: Iterator[pa.RecordBatch], pairs: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(pairs, np.int64)
    for batch in batches:
        for links in batch.column(0):
            counts += np.bincount(np.frombuffer(links.as_buffer(), "<u4"), minlength=pairs) if len(links.as_buffer()) > 4 * pairs else 0
        small = [x for x in batch.column(0) if 0 < len(x.as_buffer()) <= 4 * pairs]
        if small:
            counts += np.bincount(np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in small]), minlength=pairs)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["pair", "n"])


def _with_counts(batches: Iterator[pa.RecordBatch], counts, names: list[str]) -> Iterator[pa.RecordBatch]:
    total, is_best = counts.value
    for batch in batches:
        best, sums, sizes = [], [], []
        for links in batch.column(batch.schema.get_field_index("links")):
            which = np.frombuffer(links.as_buffer(), "<u4")
            sizes.append(len(which))
            best.append(int(is_best[which].sum()))
            sums.append(int(total[which].sum()))
        kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
        yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x, pa.int64()) for x in (sizes, best, sums)]], [*names, "n_links", "n_best", "count_sum"])


def align_documents(docs: DataFrame, tokenizer: str, model: str, form: str = "groups") -> DataFrame:
    """Align a byte-level tokenizer (a) and a piece model (b) on every whole text of documents(doc_id, text).

    One row for each row: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups). Tokens are those of a
    space and the text, which the piece model adds itself; strings of special tokens are plain text. ``groups``
    writes the ids between common ends as ``a1,a2|b1;a3|b2,b3``; with ``form`` "digest" it is ``groups_sha256``. A
    pair's count is the number of its links in all rows; ``count_sum`` adds the counts of a row's links and
    ``n_best`` counts those links that no other pair of the same piece id outnumbers.

    A text that is null, empty, or whose tokens of either kind don't spell a space and the text (a piece marker of
    its own, for instance) has no tokens: zeros and ''. Null and repeated doc_ids and repeated rows stay, and
    their links count each time; a very long text without blanks is aligned in one call; an empty table gives no
    rows; other columns are ignored. Both files must be readable on each executor. The texts are read once, and
    only counts of pairs are shuffled or broadcast, of which the two vocabularies bound the number.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups")]
        + [T.StructField("groups", T.StringType()), T.StructField("links", T.BinaryType())]
    )
    aligned = cut_lineage(docs.select("doc_id", "text").mapInArrow(partial(_align, tokenizer=tokenizer, model=model, form=form), schema))
    shape = Aligner(tokenizer, model)
    width, pairs = len(shape.right_bytes), shape.pairs
    counted = aligned.select("links").mapInArrow(partial(_pair_counts, pairs=len(pairs)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most one row for each linkable pair
    total = np.zeros(len(pairs), np.int64)
    total[found["pair"].to_numpy()] = found["n"].to_numpy()
    highest = np.zeros(width, np.int64)
    np.maximum.at(highest, pairs % width, total)
    shared = docs.sparkSession.sparkContext.broadcast((total, total == highest[pairs % width]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups"]
    out = T.StructType([aligned.schema[n] for n in names] + [T.StructField(c, T.LongType()) for c in ("n_links", "n_best", "count_sum")])
    result = aligned.mapInArrow(partial(_with_counts, counts=shared, names=names), out)
    return result.withColumnRenamed("groups", "groups_sha256") if form == "digest" else result
