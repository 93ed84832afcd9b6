"""Piece-model encoding and decoding through a table of distinct chunks.

In the model no piece holds a space marker after another character, so a text can be cut before each run of
markers and every chunk can be segmented by itself. Each distinct chunk of a task is segmented once by the
library; ids, and decoded bytes, are put back together by position. The table of chunks is local to a task:
a table of the whole corpus would have to shuffle every position of every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: A run of markers with the text up to the next run, in a text whose spaces are marked.
_CHUNK = re.compile(f"{MARK}*[^{MARK}]*")
#: Distinct chunks that a task keeps; the table starts anew beyond, which only costs time.
TABLE_CHUNKS = 400_000
#: Chunks that are segmented in one call.
JOINED_CHUNKS = 4096
#: Characters after which a group of texts is put together.
GROUP_CHARS = 2_000_000


class ChunkTable:
    """Ids and decoded bytes of distinct chunks. A chunk is stored without its first marker."""

    def __init__(self, processor, limit: int = TABLE_CHUNKS):
        self.processor = processor
        self.limit = limit
        size = processor.get_piece_size()
        names = [processor.id_to_piece(i) for i in range(size)]
        self.opens = np.array([n.startswith(MARK) for n in names])
        odd = [processor.is_byte(i) or processor.is_unknown(i) or processor.is_control(i) for i in range(size)]
        #: characters that a piece stands for; what doesn't stand for its own characters is out of all proportion
        self.chars = np.array([1 << 40 if x else len(n) for n, x in zip(names, odd, strict=True)], np.int64)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.decoded: dict[int, bytes] = {}  # of chunks that don't decode to themselves, with a space for the first marker

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths), one call for each chunk; the library puts a marker before each text it encodes."""
        lone = self.processor.piece_to_id(MARK)
        ids = [self.processor.encode(c) if c else [lone] for c in chunks]
        return np.array([x for row in ids for x in row], np.uint32), np.array([len(row) for row in ids], np.int64)

    def _joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks without a marker inside, in one call: a piece with a marker opens the next chunk."""
        ids = np.array(self.processor.encode(" ".join(chunks)), np.uint32)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(chunks) or (len(ids) and starts[0]):
            return self._each(chunks)
        return ids, np.diff(np.append(starts, len(ids)))

    def add(self, chunks: Iterable[str]) -> None:
        new = [c for c in dict.fromkeys(chunks) if c not in self.index]
        single = [c for c in new if c and MARK not in c]
        special = [c for c in new if not c or MARK in c]
        parts = [(single[i : i + JOINED_CHUNKS], self._joined) for i in range(0, len(single), JOINED_CHUNKS)] + [(special, self._each)]
        flats, counts = [self.flat], [self.lengths]
        for part, encode_part in parts:
            if not part:
                continue
            ids, lengths = encode_part(part)
            starts = np.cumsum(lengths) - lengths
            whole = np.add.reduceat(self.chars[ids], starts) == np.fromiter(map(len, part), np.int64, len(part)) + 1
            base = len(self.index)
            self.index.update(zip(part, range(base, base + len(part)), strict=True))
            for i in np.flatnonzero(~whole).tolist():
                back = self.processor.decode(ids[starts[i] : starts[i] + lengths[i]].tolist())
                if back != part[i]:
                    self.decoded[base + i] = b" " + back.encode()
            flats.append(ids)
            counts.append(lengths)
        self.flat, self.lengths = np.concatenate(flats), np.concatenate(counts)
        self.starts = np.cumsum(self.lengths) - self.lengths


def cut(text: str) -> list[str]:
    """Chunks of a text, each without its first marker. The empty text has none."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    marked = MARK + text.replace(" ", MARK)
    return [c[1:] for c in _CHUNK.findall(marked) if c]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + length]."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - ends + lengths, lengths)]


def encode_texts(texts: list[str], table: ChunkTable) -> Iterator[tuple[np.ndarray, bytes]]:
    """(ids without begin and end, decoded UTF-8) of each text, as the library's encode and decode give them."""
    cuts = [cut(t) for t in texts]
    if len(table.index) > table.limit:
        table.clear()
    table.add(chain.from_iterable(cuts))
    counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
    where = np.fromiter(map(table.index.__getitem__, chain.from_iterable(cuts)), np.int64, int(counts.sum()))
    lengths = table.lengths[where]
    ids = gather(table.flat, table.starts[where], lengths)
    at = np.concatenate([[0], np.cumsum(lengths)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    odd = np.isin(where, list(table.decoded)) if table.decoded else np.zeros(len(where), bool)
    odd_before = np.concatenate([[0], np.cumsum(odd)])
    for i, text in enumerate(texts):
        a, b = bounds[i], bounds[i + 1]
        first, last = at[a], at[b]
        if odd_before[a] == odd_before[b]:
            # markers decode to spaces, and the one before the first chunk is dropped again
            plain = text.replace(MARK, " ").encode()
        else:
            known = table.decoded
            parts = [known[w] if w in known else b" " + c.replace(MARK, " ").encode() for w, c in zip(where[a:b].tolist(), cuts[i], strict=True)]
            plain = b"".join(parts)[1:]
        yield ids[first:last], plain


def _grouped(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size > GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _digest(ids: np.ndarray, plain: bytes) -> tuple:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(plain).hexdigest()


def _whole(ids: np.ndarray, plain: bytes) -> tuple:
    return len(ids), ids.astype(np.int32), plain.decode()


_FORMS: dict[str, tuple[Callable, list[tuple[str, pa.DataType, T.DataType]]]] = {
    "digest": (
        _digest,
        [
            ("n_tokens", pa.int64(), T.LongType()),
            ("ids_sha256", pa.string(), T.StringType()),
            ("decoded_sha256", pa.string(), T.StringType()),
        ],
    ),
    "ids": (
        _whole,
        [
            ("n_tokens", pa.int64(), T.LongType()),
            ("ids", pa.list_(pa.int32()), T.ArrayType(T.IntegerType())),
            ("decoded", pa.string(), T.StringType()),
        ],
    ),
}


def _run(batches: Iterator[pa.RecordBatch], model: str, form: str) -> Iterator[pa.RecordBatch]:
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    table = ChunkTable(processor)
    begin, end = (np.array([x], np.uint32) for x in (processor.bos_id(), processor.eos_id()))
    shape, columns = _FORMS[form]
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        rows = [
            shape(np.concatenate([begin, ids, end]), plain)
            for group in _grouped(texts)
            for ids, plain in encode_texts(group, table)
        ]
        values = [pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *values], ["doc_id", *[c[0] for c in columns]])


def encode(docs: DataFrame, model: str, form: str = "ids") -> DataFrame:
    """Encode every whole text of documents(doc_id, text) with begin and end ids, then decode it.

    ``model`` is a model file that each executor can read. ``form`` "ids" returns (doc_id, n_tokens, ids,
    decoded), "digest" the hashes of ids (little-endian unsigned 32-bit) and of the decoded text instead. One row
    for each row, in no order; a null text counts as the empty one, whose ids are begin and end; a null doc_id
    stays null; other columns are ignored. Nothing is shuffled.
    """
    columns = _FORMS[form][1]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(n, kind) for n, _, kind in columns])
    return docs.select("doc_id", "text").mapInArrow(partial(_run, model=model, form=form), schema)
