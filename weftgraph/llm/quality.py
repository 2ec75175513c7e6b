"""Quality classification by a factorisation machine.

Features of a document: its hashed words (share of each bucket), the hashed
shapes of its words (letters, digits and signs in outline), structure statistics
(shares of character classes, repetition, word and line lengths) and metadata
(stated length against the length found). The machine adds to the linear terms
all pairwise interactions, whose weights are products of low-rank factors; by the
sum-of-squares identity, half of (sum of v x) squared less the sum of (v x)
squared, a document is scored in time linear in its features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_out, type_of
from .subwords import Adagrad, WordTable, labelled

LOG2, RANK = 15, 4
WORDS, SHAPES = 1 << LOG2, 1 << 10
#: Bound of the sample to fit on, by label.
SAMPLE = {0: 2000, 1: 3000}
FOLDS, FOLD = 5, 0
#: Classes of bytes: lower case, upper case, digit, line end, blank, sentence mark, other sign, beyond ASCII.
CLASSES = 8
CLASS = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b == 10 else 4 if b in (9, 11, 12, 13, 32) else 5 if b in b".,;:!?'\"-()" else 7 if b >= 128 else 6 for b in range(256)], np.uint8)
STATS = CLASSES + 8
SHAPE = bytes(b"aA0__.#a"[c] for c in CLASS.tolist())


def shape(word: bytes) -> bytes:
    """The word's classes of bytes, repeats once."""
    out = word.translate(SHAPE)
    short = bytearray(out[:1])
    for b in out[1:]:
        if b != short[-1]:
            short.append(b)
    return bytes(short)


def word_rows(words: list[bytes]) -> np.ndarray:
    """Bucket of the word, bucket of its shape, length."""
    return np.array([(zlib.crc32(w) * 2654435761 >> 16 & WORDS - 1, WORDS + (zlib.crc32(shape(w)) & SHAPES - 1), len(w)) for w in words], np.int64).reshape(-1, 3)


def features(table: WordTable, texts: list[str | None], stated: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse (document, feature, share), ascending by document, and the dense statistics."""
    number, ends = table.numbers(texts)
    n = np.diff(ends)
    doc = np.repeat(np.arange(len(texts)), n)
    size = max(1, len(table.held))
    pair, count = np.unique(doc * size + number, return_counts=True)
    owner, word = pair // size, pair % size
    rows = table.held[word]
    stats = np.zeros((len(texts), STATS))
    top = np.zeros(len(texts))
    np.maximum.at(top, owner, count)
    different = np.bincount(owner, minlength=len(texts))
    length = np.bincount(owner, rows[:, 2] * count, len(texts))
    some = np.maximum(n, 1)
    for i, t in enumerate(texts):
        raw = t.encode() if t else b""
        if raw:
            stats[i, :CLASSES] = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=CLASSES) / len(raw)
        chars = len(t) if t else 0
        stats[i, CLASSES] = np.log1p(len(raw)) / 10
        stats[i, CLASSES + 1] = 0 if stated[i] is None else 1 if stated[i] == chars else -1
        stats[i, CLASSES + 2] = np.log1p(len(raw) / (raw.count(b"\n") + 1)) / 10
    stats[:, CLASSES + 3] = different / some
    stats[:, CLASSES + 4] = top / some
    stats[:, CLASSES + 5] = np.minimum(length / some, 40) / 10
    stats[:, CLASSES + 6] = np.log1p(n) / 10
    stats[:, CLASSES + 7] = n == 0
    # the shapes of a document's words, added up by bucket
    shapes = owner * SHAPES + (rows[:, 1] - WORDS)
    held, back = np.unique(shapes, return_inverse=True)
    shares = np.bincount(back, count, len(held))
    buckets = owner * WORDS + rows[:, 0]
    own, back = np.unique(buckets, return_inverse=True)
    tf = np.bincount(back, count, len(own))
    d = np.concatenate([own // WORDS, held // SHAPES])
    f = np.concatenate([own % WORDS, WORDS + held % SHAPES])
    x = np.concatenate([tf, shares]) / some[d]
    order = np.argsort(d, kind="stable")
    return d[order], f[order], x[order], stats


@dataclass
class QualityModel:
    linear: np.ndarray  # of all sparse features, then the statistics
    factors: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def _dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def logits(self, d: np.ndarray, f: np.ndarray, x: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the sums of v x by document and factor."""
        docs, dense = len(stats), self._dense(stats)
        a, v = len(self.linear) - STATS, self.factors[f]
        y = self.bias + np.bincount(d, self.linear[f] * x, docs) + dense @ self.linear[a:]
        sums = np.stack([np.bincount(d, v[:, k] * x, docs) for k in range(RANK)], 1) + dense @ self.factors[a:]
        squares = np.bincount(d, (v * v).sum(1) * x * x, docs) + (dense * dense) @ (self.factors[a:] ** 2).sum(1)
        return y + 0.5 * ((sums**2).sum(1) - squares), sums

    def scores(self, table: WordTable, texts: list[str | None], stated: list[int | None]) -> np.ndarray:
        logit, _ = self.logits(*features(table, texts, stated))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def split(text: str) -> list[bytes]:
    return text.encode().split()


def fit_texts(texts: list[str], stated: list[int | None], labels: list[int], epochs: int = 70, seed: int = 5) -> QualityModel:
    """Without examples of both labels the model gives the label it saw, or 0, to all."""
    width = WORDS + SHAPES + STATS
    rng = np.random.default_rng(seed)
    model = QualityModel(np.zeros(width), rng.normal(0, 0.02, (width, RANK)), 0.0, np.zeros(STATS), np.ones(STATS))
    if len(set(labels)) < 2:
        model.factors[:] = 0
        model.bias = 30.0 if labels and labels[0] else -30.0
        return model
    y = np.array(labels, float)
    d, f, x, stats = features(WordTable(split, word_rows), texts, stated)
    model.mean, model.scale = stats.mean(0), stats.std(0) + 1e-3
    dense, a, fit, bias = model._dense(stats), WORDS + SHAPES, Adagrad(0.1), np.zeros(1)
    weight = 1 / len(y)
    for _ in range(epochs):
        logit, sums = model.logits(d, f, x, stats)
        slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight
        linear, factors = np.zeros(width), np.zeros((width, RANK))
        sx = slope[d] * x
        linear[:a] = np.bincount(f, sx, a)
        linear[a:] = slope @ dense
        for k in range(RANK):
            factors[:a, k] = np.bincount(f, sx * (sums[d, k] - model.factors[f, k] * x), a)
        factors[a:] = dense.T @ (slope[:, None] * sums) - (slope @ (dense * dense))[:, None] * model.factors[a:]
        fit.step("linear", model.linear, linear + 1e-6 * model.linear)
        fit.step("factors", model.factors, factors + 1e-6 * model.factors)
        bias[0] = model.bias
        fit.step("bias", bias, np.array([slope.sum()]))
        model.bias = float(bias[0])
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", sample: dict | None = None) -> QualityModel:
    """Fits on a sample, bounded by label, of the rows that aren't held out, whole texts; rows with a null label, id or text aren't used."""
    rows = labelled(docs, labels, label, sample or SAMPLE, lambda i: ~held_out(i, FOLDS, FOLD), id_col, text_col, (chars_col,))
    return fit_texts([r[0] for r in rows], [r[2] for r in rows], [int(r[1]) for r in rows])


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """One row per row of docs: doc_id (as given, null too), score (0 to 1).

    Null text counts as empty; a null stated length is unknown. Texts of any length
    are scored whole. Rows that repeat an id are scored each. Other columns are not
    read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(split, word_rows)
        for batch in batches:
            for part in chunks(batch):
                scores = shared.value.scores(table, part.column(1).to_pylist(), part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(chars_col).cast("long").alias("chars")).mapInArrow(run, f"doc_id {type_of(docs, id_col)}, score double")
