"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as a few numbers: how much the word itself, and the character sequences in it, lean to toxic texts
of the training sample, with how much support. A window of words runs through a gated recurrent network
in both directions, attention pools its states, and the pooled state gives the window's score. All overlapping
windows of a text are scored; the highest, calibrated, is the text's.

The network is small and is fitted on the driver from a bounded sample of labelled rows. Scoring is one pass over the
documents without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window, and how far the next one begins.
WINDOW, STRIDE = 32, 16
#: Sizes of the lean tables for words and for character sequences.
BUCKETS = 1 << 18
#: Lengths of character sequences.
GRAMS = (3, 4, 5)
FEATURES, HIDDEN = 6, 8
#: Labelled rows of each class that the network is fitted on, and the longest text among them in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 200_000
EPOCHS, ROUNDS, BATCH, RATE = 6, 3, 128, 0.01
#: Distinct words a task remembers, windows that run at once, characters of texts that are taken together, the same beside rows that go through, rows that are read at once.
KNOWN_WORDS, LANES, GROUP_CHARS, STAGE_CHARS, GROUP_ROWS = 300_000, 4096, 2_000_000, 400_000, 256

_WORD = re.compile(r"[^\W\d_]+")
_SHORT = 24
#: Words whose character sequences are made at once.
SLICE = 5000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


# --- words as numbers


def _buckets(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of words, bucket of each word, buckets of its character sequences with -1 as filler), in slices."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    short = np.flatnonzero(size <= _SHORT)
    slices = [short[i : i + SLICE] for i in range(0, len(short), SLICE)] + [np.array([i]) for i in np.flatnonzero(size > _SHORT)]
    for part in slices:
        if not len(part):
            continue
        width = int(size[part].max())
        points = np.array([words[i] for i in part], f"U{width}").view(np.uint32).reshape(len(part), width).astype(np.uint64)
        edged = np.zeros((len(part), width + 2), np.uint64)
        edged[:, 0] = 2
        edged[:, 1:-1] = points
        edged[np.arange(len(part)), size[part] + 1] = 3
        whole = np.zeros(len(part), np.uint64)
        for i in range(width):
            whole = np.where(points[:, i] > 0, (whole * np.uint64(1_000_003)) ^ points[:, i], whole)
        grams = []
        for n in GRAMS:
            count = width + 2 - n + 1
            if count < 1:
                continue
            mixed = np.full((len(part), count), n, np.uint64)
            for i in range(n):
                mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ edged[:, i : i + count]
            fits = np.arange(count)[None, :] + n <= (size[part] + 2)[:, None]
            grams.append(np.where(fits, _fold(mixed), -1))
        yield part, _fold(whole), np.concatenate(grams, axis=1) if grams else np.full((len(part), 1), -1)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def _lean(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Smoothed log odds, zero without support."""
    share_t, share_c = (toxic + 1) / (n_toxic + 2), (clean + 1) / (n_clean + 2)
    return np.where(toxic + clean > 0, np.log(share_t / share_c), 0.0)


@dataclass
class Leans:
    """How many toxic and clean texts of the sample hold each bucket."""

    words: np.ndarray = field(default_factory=lambda: np.zeros((2, BUCKETS), np.float32))
    grams: np.ndarray = field(default_factory=lambda: np.zeros((2, BUCKETS), np.float32))
    texts: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))

    def count(self, label: int, word: np.ndarray, gram: np.ndarray) -> None:
        self.words[label, np.unique(word)] += 1
        self.grams[label, np.unique(gram[gram >= 0])] += 1
        self.texts[label] += 1

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lean and support of every bucket, for words and for sequences; the last sequence bucket is the filler."""
        n_toxic, n_clean = int(self.texts[1]), int(self.texts[0])
        out = []
        for counts in (self.words, self.grams):
            out += [_lean(counts[1], counts[0], n_toxic, n_clean).astype(np.float32), np.log1p(counts.sum(axis=0)) / 3]
        out[2] = np.append(out[2], np.float32(-np.inf))
        return tuple(out)

    def features_without(self, word: np.ndarray, gram: np.ndarray, length: np.ndarray, own: int) -> np.ndarray:
        """The features of a text of the sample, with the text of label ``own`` taken out, so that none explains itself."""
        less = np.zeros((2, 1), np.float32)
        less[own] = 1
        at_word = np.maximum(self.words[:, word] - less, 0)
        at_gram = np.maximum(self.grams[:, np.maximum(gram, 0)] - less[:, :, None], 0)
        n_toxic, n_clean = int(self.texts[1]), int(self.texts[0])
        lean_g = np.where(gram >= 0, _lean(at_gram[1], at_gram[0], n_toxic, n_clean), -np.inf)
        lean_w = _lean(at_word[1], at_word[0], n_toxic, n_clean)
        return _combined(lean_w, np.log1p(at_word.sum(axis=0)) / 3, lean_g, np.log1p(at_gram.sum(axis=0)) / 3, length)


def _combined(lean_w: np.ndarray, support_w: np.ndarray, lean_g: np.ndarray, support_g: np.ndarray, length: np.ndarray) -> np.ndarray:
    """FEATURES numbers for each word; sequences without lean are fillers."""
    rows = np.arange(len(lean_w))
    most = lean_g.argmax(axis=1)
    top = lean_g[rows, most]
    real = np.isfinite(lean_g)
    mean = np.where(real, lean_g, 0).sum(axis=1) / np.maximum(real.sum(axis=1), 1)
    none = ~np.isfinite(top)
    return np.stack([lean_w, support_w, np.where(none, 0, top), mean, np.where(none, 0, support_g[rows, most]), length / 10]).astype(np.float32)


# --- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def fresh_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)
    out = {}
    for side in ("f", "b"):
        out |= {f"in_{side}": draw(3 * HIDDEN, FEATURES), f"bias_{side}": np.zeros((3 * HIDDEN, 1), np.float32)}
        out |= {f"gate_{side}": draw(2 * HIDDEN, HIDDEN), f"new_{side}": draw(HIDDEN, HIDDEN)}
    return out | {"attend": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "out_bias": np.zeros(1, np.float32)}


def forward(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows x (steps, features, lanes) with mask (steps, lanes); with ``keep`` also what ``backward`` needs."""
    steps, _, lanes = x.shape
    states = np.zeros((steps, 2 * HIDDEN, lanes), np.float32)
    trace: dict[str, list] = {"f": [None] * steps, "b": [None] * steps}
    for side, order, rows in (("f", range(steps), slice(0, HIDDEN)), ("b", range(steps - 1, -1, -1), slice(HIDDEN, 2 * HIDDEN))):
        h = np.zeros((HIDDEN, lanes), np.float32)
        for t in order:
            g = w[f"in_{side}"] @ x[t] + w[f"bias_{side}"]
            zr = _sigmoid(g[: 2 * HIDDEN] + w[f"gate_{side}"] @ h)
            z, r = zr[:HIDDEN] * mask[t], zr[HIDDEN:]
            c = np.tanh(g[2 * HIDDEN :] + w[f"new_{side}"] @ (r * h))
            if keep:
                trace[side][t] = (h, zr, c)
            h = h + z * (c - h)
            states[t, rows] = h
    energy = np.einsum("u,tul->tl", w["attend"], states) + np.where(mask > 0, 0, -1e9).astype(np.float32)
    share = np.exp(energy - energy.max(axis=0)) * mask
    share /= np.maximum(share.sum(axis=0), 1e-9)
    pooled = np.einsum("tl,tul->ul", share, states)
    logit = w["out"] @ pooled + w["out_bias"]
    return (logit, (states, trace, share, pooled)) if keep else logit


def backward(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, kept, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    states, trace, share, pooled = kept
    steps = x.shape[0]
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["out"], grad["out_bias"] = pooled @ d_logit, np.array([d_logit.sum()], np.float32)
    d_pooled = w["out"][:, None] * d_logit
    d_share = np.einsum("ul,tul->tl", d_pooled, states)
    d_energy = share * (d_share - (share * d_share).sum(axis=0))
    grad["attend"] = np.einsum("tl,tul->u", d_energy, states)
    d_states = share[:, None, :] * d_pooled[None] + w["attend"][None, :, None] * d_energy[:, None, :]
    for side, order, rows in (("f", range(steps - 1, -1, -1), slice(0, HIDDEN)), ("b", range(steps), slice(HIDDEN, 2 * HIDDEN))):
        d_h = np.zeros_like(d_states[0, rows])
        for t in order:
            h, zr, c = trace[side][t]
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            d_next = d_h + d_states[t, rows]
            d_c = d_next * mask[t] * z * (1 - c * c)
            d_z = d_next * mask[t] * (c - h) * z * (1 - z)
            d_rh = w[f"new_{side}"].T @ d_c
            d_r = d_rh * h * r * (1 - r)
            gates = np.concatenate([d_z, d_r])
            d_h = d_next * (1 - mask[t] * z) + d_rh * r + w[f"gate_{side}"].T @ gates
            both = np.concatenate([gates, d_c])
            grad[f"in_{side}"] += both @ x[t].T
            grad[f"bias_{side}"] += both.sum(axis=1, keepdims=True)
            grad[f"gate_{side}"] += gates @ h.T
            grad[f"new_{side}"] += d_c @ (r * h).T
    return grad


class Adam:
    def __init__(self, w: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.step = w, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def apply(self, grad: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grad.items():
            g = np.clip(g, -5, 5)
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            scale = np.sqrt(self.v[k] / (1 - 0.99**self.step)) + 1e-8
            self.w[k] -= (self.rate * self.m[k] / (1 - 0.9**self.step) / scale).astype(np.float32)


def window_starts(n_words: int) -> np.ndarray:
    """Starts of the windows that cover a text, each word but those at the ends twice; a text without words has one."""
    return np.arange(0, max(n_words - WINDOW + STRIDE, 1), STRIDE)


def gather(feats: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``length`` words at ``begin`` in feats (features, words) as (steps, features, lanes), with their mask."""
    steps = max(1, int(length.max(initial=1)))
    at = begin[None, :] + np.arange(steps)[:, None]
    mask = (np.arange(steps)[:, None] < length[None, :]).astype(np.float32)
    padded = feats if feats.shape[1] else np.zeros((feats.shape[0], 1), np.float32)
    x = padded[:, np.minimum(at, padded.shape[1] - 1)] * mask[None]
    return np.ascontiguousarray(x.transpose(1, 0, 2)), mask


@dataclass
class Model:
    leans: Leans
    weights: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None  # the score of every text where the sample holds one class at most
    untaught: bool = False  # no toxic text with words was seen

    def document_logits(self, feats: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The highest logit over all windows of each text; feats holds the texts' words one after the other."""
        starts = [window_starts(int(n)) for n in counts]
        per = np.array([len(s) for s in starts])
        first = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(counts)), per)
        begin = first + np.repeat(np.cumsum(counts) - counts, per)
        length = np.minimum(WINDOW, counts[owner] - first)
        logits = np.empty(len(begin), np.float32)
        for i in range(0, len(begin), LANES):
            logits[i : i + LANES] = forward(self.weights, *gather(feats, begin[i : i + LANES], length[i : i + LANES]))
        return np.maximum.reduceat(logits, np.cumsum(per) - per) if len(per) else np.zeros(0, np.float32)

    def scores(self, logits: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logits), self.constant)
        return _sigmoid(self.slope * logits.astype(np.float64) + self.offset)


def _calibrated(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton steps with a little ridge."""
    design = np.stack([logits, np.ones_like(logits)], axis=1).astype(np.float64)
    beta = np.array([1.0, 0.0])
    for _ in range(40):
        p = _sigmoid(np.clip(design @ beta, -30, 30))
        gradient = design.T @ (weights * (p - labels)) + 1e-3 * (beta - np.array([1.0, 0.0]))
        hessian = (design.T * (weights * p * (1 - p))) @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta - step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
    return float(beta[0]), float(beta[1])


def fit(texts: list[str], labels: list[int], totals: tuple[int, int] | None = None, seed: int = 7) -> Model:
    """The model of a labelled sample; ``totals`` are the (clean, toxic) rows it was drawn from, for calibration."""
    leans = Leans()
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        untaught = not any(label and words_of(t) for t, label in zip(texts, labels, strict=True))
        return Model(leans, fresh_weights(seed), constant=(sum(labels) + 1) / (len(labels) + 2), untaught=untaught)
    index: dict[str, int] = {}
    numbers = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t in texts]
    if not index:
        return Model(leans, fresh_weights(seed), constant=(sum(labels) + 1) / (len(labels) + 2), untaught=True)
    names = list(index)
    del index
    word = np.zeros(len(names), np.int64)
    many = np.zeros(len(names), np.int64)
    pieces = []
    for part, whole, grams in _buckets(names):
        word[part], many[part] = whole, (grams >= 0).sum(axis=1)
        pieces.append((part, grams[grams >= 0].astype(np.int32)))
    begin = np.zeros(len(names), np.int64)
    flat_grams = np.concatenate([g for _, g in pieces])
    order = np.concatenate([part for part, _ in pieces])
    begin[order] = np.cumsum(many[order]) - many[order]
    length = np.fromiter(map(len, names), np.int64, len(names))
    del names, pieces, order

    def grams_of(which: np.ndarray) -> np.ndarray:
        step = np.arange(max(1, int(many[which].max(initial=1))))
        at = np.minimum(begin[which][:, None] + step, max(0, len(flat_grams) - 1))
        return np.where(step < many[which][:, None], flat_grams[at], -1).astype(np.int64)

    for row, label in zip(numbers, labels, strict=True):
        which = np.unique(row)
        leans.count(label, word[which], grams_of(which))
    counts = np.array([len(row) for row in numbers])
    bases = np.cumsum(counts) - counts
    flat = np.zeros((FEATURES, int(counts.sum())), np.float32)
    feats = [flat[:, a : a + n] for a, n in zip(bases.tolist(), counts.tolist(), strict=True)]
    for row, label, own in zip(numbers, labels, feats, strict=True):
        if len(row):
            which, back = np.unique(row, return_inverse=True)
            own[:] = leans.features_without(word[which], grams_of(which), length[which], label)[:, back]
    del numbers

    weights = fresh_weights(seed)
    model = Model(leans, weights)
    adam = Adam(weights, RATE)
    rng = np.random.default_rng(seed)
    class_weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum())).astype(np.float32)
    for round_ in range(ROUNDS):
        # a toxic text is taught by its most suspicious window, a clean one by that and another
        picks: list[tuple[int, int]] = []
        for i, n in enumerate(counts.tolist()):
            starts = window_starts(n)
            if round_ == 0:
                suspicion = feats[i][0] + feats[i][2]
                best = int(suspicion.argmax()) if n else 0
                picks.append((i, int(np.clip(best - rng.integers(0, WINDOW), 0, max(n - WINDOW, 0)))))
            else:
                local = forward(weights, *gather(feats[i], starts, np.minimum(WINDOW, n - starts)))
                picks.append((i, int(starts[int(local.argmax())])))
            if y[i] == 0 and len(starts) > 1:
                picks.append((i, int(rng.choice(starts))))
        chosen = np.array(picks)
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // BATCH)):
                doc, start = chosen[part, 0], chosen[part, 1]
                x, mask = gather(flat, bases[doc] + start, np.minimum(WINDOW, counts[doc] - start))
                logit, kept = forward(weights, x, mask, keep=True)
                d_logit = ((_sigmoid(logit) - y[doc]) * class_weight[doc] / len(part)).astype(np.float32)
                adam.apply(backward(weights, x, mask, kept, d_logit))
        adam.rate *= 0.5
    logits = model.document_logits(flat, counts)
    clean, toxic = totals or (int((y == 0).sum()), int((y == 1).sum()))
    share = np.where(y == 1, toxic / (y == 1).sum(), clean / (y == 0).sum())
    model.slope, model.offset = _calibrated(logits, y, share / share.mean())
    return model


class Scorer:
    """A model with the features of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.tables = model.leans.tables()
        self.index: dict[str, int] = {}
        self.feats = np.zeros((FEATURES, 0), np.float32)

    def __call__(self, texts: list[str]) -> np.ndarray:
        token_lists = [words_of(t) for t in texts]
        if len(self.index) > KNOWN_WORDS:
            self.index, self.feats = {}, np.zeros((FEATURES, 0), np.float32)
        new = [w for w in dict.fromkeys(chain.from_iterable(token_lists)) if w not in self.index]
        if new:
            fresh = np.zeros((FEATURES, len(new)), np.float32)
            size = np.fromiter(map(len, new), np.int64, len(new))
            for part, word, grams in _buckets(new):
                lean_w, support_w, lean_g, support_g = self.tables
                fresh[:, part] = _combined(lean_w[word], support_w[word], lean_g[grams], support_g[grams], size[part])
            base = len(self.index)
            self.index.update(zip(new, range(base, base + len(new)), strict=True))
            self.feats = np.concatenate([self.feats, fresh], axis=1)
        counts = np.fromiter(map(len, token_lists), np.int64, len(token_lists))
        where = np.fromiter(map(self.index.__getitem__, chain.from_iterable(token_lists)), np.int64, int(counts.sum()))
        return self.model.scores(self.model.document_logits(self.feats[:, where], counts))


def _scored(batches: Iterator[pa.RecordBatch], model, at: int, chars: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches, each of a little over ``chars`` characters in column ``at``, the text, with the scores of their rows.

    Only a slice's texts are held as strings.
    """
    scorer = Scorer(model.value)
    for batch in batches:
        first, texts, size = 0, [], 0
        for i in range(0, batch.num_rows, GROUP_ROWS):
            for text in batch.column(at).slice(i, GROUP_ROWS).to_pylist():
                texts.append(text or "")
                size += len(texts[-1])
                if size > chars:
                    yield batch.slice(first, len(texts)), scorer(texts)
                    first, texts, size = first + len(texts), [], 0
        if texts:
            yield batch.slice(first, len(texts)), scorer(texts)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """The last column, the text, gives way to its score."""
    for part, scores in _scored(batches, model, -1, GROUP_CHARS):
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64())], [*part.schema.names[:-1], "score"])


def _below(batches: Iterator[pa.RecordBatch], model, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows whose text, column ``at``, scores below the threshold."""
    for part, scores in _scored(batches, model, at, STAGE_CHARS):
        yield part.filter(pa.array(scores < threshold))


def fold(key: Column, folds: int) -> Column:
    """crc32 of an id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % folds


def fit_labelled(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of at most ``sample_rows`` rows of each class of labels(doc_id, toxic), drawn by a hash of their ids.

    Rows of labels with null ids or labels other than 0 and 1, and texts over SAMPLE_BYTES bytes, are not drawn.
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).distinct()
    totals = {r["_toxic"]: r["count"] for r in usable.groupBy("_toxic").count().collect()}
    drawn = [usable.where(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows) for c in (0, 1)]
    ids = F.broadcast(drawn[0].union(drawn[1]))  # 2 * sample_rows rows at most
    texts = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select(F.col("doc_id").cast("long").alias("_id"), "text")
    found = texts.join(ids, "_id").groupBy("_id", "_toxic").agg(F.min("text").alias("text"))
    rows = sorted((r["_id"], r["_toxic"], r["text"]) for r in found.collect())
    return fit([r[2] for r in rows], [r[1] for r in rows], (totals.get(0, 1), totals.get(1, 1)))


def score_documents(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """(keep..., score): the toxicity of every row's whole text from 0 to 1; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, "text")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(partial(_score, model=shared), f"{ddl}, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of documents whose score is below the threshold, as they are; the model learns from all given labels.

    Where no labels are drawn, or only clean ones, or only texts without words, nothing toxic is known and all rows are kept.
    """
    model = fit_labelled(docs, labels)
    if model.untaught:
        return docs
    # rows go through as they are, each text once, since a batch of them is held on both sides of the worker
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_below, model=shared, at=docs.columns.index("text"), threshold=threshold), docs.schema)
