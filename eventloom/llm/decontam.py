"""Benchmark decontamination: pigeonhole pieces find candidates, Myers' bit-parallel distance decides.

Texts are compared in a canonical form: lower case, only letters and digits, one space between words. An item of
canonical length n may differ by ``floor(rate * n)`` edits. It is split into one piece more than that, so a
passage within the budget holds at least one piece unchanged. An automaton of all pieces runs once over each
document, and only windows around the hits are verified. Documents are never shuffled; items go out in blocks of
bounded size, each of which is one pass over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of an item's canonical characters that may be inserted, deleted or replaced.
RATE = 0.06
#: Canonical characters below which ``contaminations`` and ``clean`` leave an item out unless told otherwise; the query and
#: the pipeline look for all items.
LEAST_CHARS = 40
#: Canonical characters below which an item must be found as it is and as whole words.
EDITED_CHARS = 17
#: Canonical characters of the items that one broadcast block holds.
BLOCK_CHARS = 4_000_000

_PLAIN = re.compile(r"[^\W_]+")
#: Letters of scripts that put no space between words: Thai, Lao, Burmese, Khmer, kana, ideographs.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def canonical(text: str | None) -> str:
    """Words of letters and digits in lower case, joined by one space."""
    return " ".join(_PLAIN.findall((text or "").lower()))


def pieces_of(length: int, budget: int) -> list[tuple[int, int]]:
    """budget + 1 ranges of nearly equal length that cover an item."""
    n = budget + 1
    return [(length * i // n, length * (i + 1) // n) for i in range(n)]


def myers(pattern_bits: dict[str, int], length: int, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best approximate occurrence of a pattern anywhere in ``text``, the leftmost end of
    equals, or None beyond the budget. One column is two machine-word-like integers of ``length`` bits."""
    mask = (1 << length) - 1
    high = 1 << (length - 1)
    plus, minus, score = mask, 0, length
    best = None
    for end, char in enumerate(text, 1):
        eq = pattern_bits.get(char, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diag | plus)
        down = plus & diag
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up <<= 1
        down <<= 1
        plus = (down | ~(diag | up)) & mask
        minus = up & diag & mask
        if score <= budget and (best is None or score < best[0]):
            best = (score, end)
    return best


def bits_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, char in enumerate(pattern):
        out[char] = out.get(char, 0) | 1 << i
    return out


def _parted(text: str, at: int) -> bool:
    """Whether a word may begin or end before character ``at`` of a canonical text."""
    if at in (0, len(text)) or " " in text[at - 1 : at + 1]:
        return True
    return bool(_UNSPACED.match(text[at - 1]) or _UNSPACED.match(text[at]))


class Finder:
    """Items of one block, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str, int]]):
        import ahocorasick

        self.items = items
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, budget) in enumerate(items):
            for a, b in pieces_of(len(text), budget):
                owners.setdefault(text[a:b], []).append((number, a))
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        if owners:
            self.automaton.make_automaton()
        self.bits: dict[int, dict[str, int]] = {}

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end) of each item that the canonical text holds: its best place, the leftmost of equals."""
        windows: dict[int, list[list[int]]] = {}
        whole: dict[int, int] = {}  # ends of short items
        if len(self.automaton):
            for end, (size, where) in self.automaton.iter(text):
                for number, offset in where:
                    _, item, budget = self.items[number]
                    if len(item) < EDITED_CHARS:
                        if number not in whole and _parted(text, end + 1 - size) and _parted(text, end + 1):
                            whole[number] = end + 1
                        continue
                    start = end + 1 - size - offset  # where the item would begin without edits
                    low, high = max(0, start - budget), min(len(text), start + len(item) + budget)
                    spans = windows.setdefault(number, [])
                    # hits come from left to right, and starts of one item differ by less than its length
                    for span in reversed(spans[-4:]):
                        if low <= span[1] and high >= span[0]:
                            span[0], span[1] = min(low, span[0]), max(high, span[1])
                            break
                    else:
                        spans.append([low, high])
        found = [(self.items[number][0], 0, end) for number, end in whole.items()]
        for number, spans in windows.items():
            item_id, item, budget = self.items[number]
            if number not in self.bits:
                self.bits[number] = bits_of(item)
            best = None
            for low, high in sorted(spans):
                hit = myers(self.bits[number], len(item), text[low:high], budget)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], low + hit[1])
            if best:
                found.append((item_id, *best))
        return sorted(found)


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int64()), ("budget", pa.int32()), ("item_chars", pa.int32())])
_FOUND_DDL = "doc_id long, item_id long, distance int, end long, budget int, item_chars int"


def _scan(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    finder = Finder(block.value)
    facts = {item_id: (budget, len(text)) for item_id, text, budget in finder.items}
    for batch in batches:
        rows = [
            (doc_id, item_id, distance, end, *facts[item_id])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if text
            for item_id, distance, end in finder.find(canonical(text))
        ]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


def _blocks(bench: DataFrame, rate: float, least: int, block_chars: int) -> Iterator[list[tuple[int, str, int]]]:
    """Items in blocks, streamed through the driver one partition at a time and never held whole."""
    block, size, seen = [], 0, set()
    for row in bench.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        text = canonical(row.text)
        if len(text) < max(least, 1) or (row.item_id, text) in seen:
            continue
        if size + len(text) > block_chars and block:
            yield block
            block, size, seen = [], 0, set()
        block.append((row.item_id, text, int(rate * len(text)) if len(text) >= EDITED_CHARS else 0))
        seen.add((row.item_id, text))
        size += len(text)
    if block:
        yield block


def contaminations(
    docs: DataFrame, bench: DataFrame, rate: float = RATE, least: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id, distance, end, budget, item_chars) for each document and benchmark item it contains.

    ``distance`` is the least number of canonical characters to edit in the item so that the document contains
    it, at most ``budget``; ``end`` is where that place ends in the canonical document. Items under EDITED_CHARS canonical
    characters must stand there unedited and as whole words. Items shorter than ``least`` canonical characters, null ids and null texts of items are left out; null and empty documents
    contain nothing. An id that stands for several texts, or several rows of one doc_id, give their best row
    once; a null doc_id counts as one document. Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = None
    for block in _blocks(bench, rate, least, block_chars):
        # an item id is looked up by its text, so one id with two texts takes two passes of facts
        for part in _one_text_each(block):
            hits = source.mapInArrow(partial(_scan, block=spark.sparkContext.broadcast(part)), _FOUND_DDL)
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], _FOUND_DDL)
    best = F.min_by(F.struct("distance", "end", "budget", "item_chars"), F.struct("distance", "end"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _one_text_each(block: list[tuple[int, str, int]]) -> list[list[tuple[int, str, int]]]:
    """The block, split so that no part has an id twice."""
    parts: list[dict[int, tuple[int, str, int]]] = []
    for item in block:
        for part in parts:
            if item[0] not in part:
                part[item[0]] = item
                break
        else:
            parts.append({item[0]: item})
    return [list(p.values()) for p in parts]


def _keep(batches: Iterator[pa.RecordBatch], block, at: int) -> Iterator[pa.RecordBatch]:
    finder = Finder(block.value)
    for batch in batches:
        texts = batch.column(at).to_pylist()
        yield batch.filter(pa.array([not (t and finder.find(canonical(t))) for t in texts], pa.bool_()))


def clean(docs: DataFrame, bench: DataFrame, rate: float = RATE, least: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of documents that contain no benchmark item, with all their columns, judged row by row."""
    at = docs.columns.index("text")
    for block in _blocks(bench, rate, least, block_chars):
        docs = docs.mapInArrow(partial(_keep, block=docs.sparkSession.sparkContext.broadcast(block), at=at), docs.schema)
    return docs
