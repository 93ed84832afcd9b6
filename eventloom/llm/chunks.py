"""Cuts of a text before which byte-level and piece tokenizers always begin a new token, and ids of distinct chunks.

A single space between two characters that are not blank opens a token in both kinds: the byte-level pattern lets
a space stand only at the front of a word, and no piece holds a space marker after another character. So chunks
can be encoded one by one, and a chunk that many texts share is encoded once for a task.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np

from eventloom.llm.pieces import gather

#: A space between two characters that no pattern counts as blank.
_CUT = re.compile(r"(?<=[^\s\u180e\u200b\u2060\ufeff]) (?=[^\s\u180e\u200b\u2060\ufeff])")
_BLANK = re.compile(r"[\s\u180e\u200b\u2060\ufeff]")
#: Blanks other than the space and the end of a line.
_RARE = re.compile(r"[\t\r\f\v\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: A chunk of printable ASCII, Latin letters and signs, CJK ideographs and inner ends of lines: every library sees the same words in it.
_PLAIN = re.compile(r"[!-~\u00a1-\u024f\u4e00-\u9fa5](?:[!-~\u00a1-\u024f\u4e00-\u9fa5\n]*[!-~\u00a1-\u024f\u4e00-\u9fa5])?")
#: The words of a byte-level tokenizer (a fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of the chunks that a process keeps; the table starts anew beyond, which only costs time.
TABLE_CHARS = 10_000_000
#: Chunks that are encoded in one call.
JOINED_CHUNKS = 4096
#: Characters after which a group of texts is put together.
GROUP_CHARS = 2_000_000


def is_blank(char: str) -> bool:
    """Whether there is a character that may not stand beside a cut."""
    return not char or _BLANK.match(char) is not None


def cut(text: str) -> list[str]:
    """Chunks of a text; joined by single spaces they are the text again."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] in ("", " ") or text[-1] == " " or _RARE.search(text):
        return _CUT.split(text)
    return text.split(" ")


def grouped(texts: Iterable[str], chars: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Texts in groups of about ``chars`` characters; a longer text is a group of its own."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > chars:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def cuttable(path: str) -> bool:
    """Whether texts may be cut into chunks for this tokenizer file: byte-level words and no token with a blank of its own."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    words = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and spec.get("post_processor") is None
        and words.get("type") == "ByteLevel"
        and bool(words.get("use_regex", True))
        and not words.get("add_prefix_space", False)
        and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or _BLANK.search(t["content"]) for t in spec.get("added_tokens") or []
        )
    )


def byte_symbols() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: itself where it prints, else the next from U+0100 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


def quick_encoder(path: str):
    """A faster encoder of the same merges for plain words, or None where the file's ids don't follow its merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    if not cuttable(path) or model.get("type") != "BPE" or any(model.get(x) for x in odd):
        return None
    symbols, vocabulary = byte_symbols(), model["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if any(vocabulary.get(t) != 256 + i for i, t in enumerate(merged)) or len(vocabulary) != 256 + len(merged):
        return None
    import tiktoken

    ranks = {bytes(symbols[c] for c in t): i for t, i in vocabulary.items()}
    return tiktoken.Encoding("merges", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class IdTable:
    """Ids of distinct chunks by a byte-level tokenizer, each with the space before it."""

    def __init__(self, path: str, limit: int = TABLE_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work over the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuttable = cuttable(path)
        self.quick = quick_encoder(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        self.limit = limit
        size = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.whole([" " + c for c in chunks])
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _joined(self, chunks: list[str], encode) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks without an inner space, in one call: a token with a space in front opens the next chunk."""
        ids = np.array(encode(" " + " ".join(chunks)), np.uint32)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(chunks) or (len(ids) and starts[0]):
            return self._each(chunks)
        return ids, np.diff(np.append(starts, len(ids)))

    def is_plain(self, chunk: str) -> bool:
        """Whether the quick encoder gives the library's ids."""
        return self.quick is not None and _PLAIN.fullmatch(chunk) is not None and not (self.special and self.special.search(chunk))

    def add(self, chunks: Iterable[str]) -> None:
        new = [c for c in dict.fromkeys(chunks) if c not in self.index]
        kinds: tuple[list[str], ...] = ([], [], [])
        for c in new:
            kinds[0 if self.is_plain(c) else 2 if not c or _BLANK.search(c) else 1].append(c)
        encoders = (
            lambda part: self._joined(part, self.quick.encode_ordinary),
            lambda part: self._joined(part, lambda text: self.whole([text])[0]),
            self._each,
        )
        flats, counts = [self.flat], [self.lengths]
        for kind, encode_part in zip(kinds, encoders, strict=True):
            for i in range(0, len(kind), JOINED_CHUNKS):
                part = kind[i : i + JOINED_CHUNKS]
                ids, lengths = encode_part(part)
                base = len(self.index)
                self.index.update(zip(part, range(base, base + len(part)), strict=True))
                flats.append(ids)
                counts.append(lengths)
        self.chars += sum(map(len, new))
        self.flat, self.lengths = np.concatenate(flats), np.concatenate(counts)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _heads(self, heads: list[str]) -> list[list[int]]:
        """Ids of chunks without a space before them."""
        plain = [self.is_plain(c) for c in heads]
        rest = iter(self.whole([c for c, x in zip(heads, plain, strict=True) if not x]))
        return [self.quick.encode_ordinary(c) if x else next(rest) for c, x in zip(heads, plain, strict=True)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as the library gives them without special tokens around."""
        if not self.cuttable:
            for ids in self.whole(texts):
                yield np.array(ids, np.uint32)
            return
        cuts = [cut(t) for t in texts]
        if self.chars > self.limit:
            self.clear()
        first = self._heads([c[0] for c in cuts])
        rest = [c[1:] for c in cuts]
        counts = np.fromiter(map(len, rest), np.int64, len(rest))
        every = list(chain.from_iterable(rest))
        where = np.fromiter(map(self.index.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(where < 0)
        fresh = [every[i] for i in missing.tolist()]
        self.add(fresh)
        where[missing] = np.fromiter(map(self.index.__getitem__, fresh), np.int64, len(fresh))
        lengths = self.lengths[where]
        ids = gather(self.flat, self.starts[where], lengths)
        at = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        for i, head in enumerate(first):
            yield np.concatenate([np.array(head, np.uint32), ids[at[bounds[i]] : at[bounds[i + 1]]]])


@lru_cache(maxsize=1)
def id_table(path: str) -> IdTable:
    """One table for all tasks of a worker process."""
    return IdTable(path)
