"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its hashed byte n-grams and of itself, so
an unseen misspelling shares vectors with the word it comes from. A window is
the mean of its words, a linear softmax scores it. A document is scored by its
most toxic window of neighbouring words, which slides by one: a few toxic words in a long text aren't averaged away. Fitting
begins with means of whole documents, then takes each document's most toxic
window at that point, for either label (multiple-instance learning).

As the softmax is linear, the difference of its two logits over a window is a
mean of one number a word, which a worker computes once for each different word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_out, type_of
from .subwords import Adagrad, WordTable, labelled, means, ngrams, scatter

WINDOW = 2
LOG2, DIM, LO, HI = 16, 8, 3, 5
#: Bound of the sample to fit on, by label.
SAMPLE = {1: 1000, 0: 2000}
FOLDS, FOLD = 5, 0
KEPT = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split(text: str) -> list[bytes]:
    return text.lower().encode().translate(KEPT).split()


def windows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of WINDOW neighbouring words, or of all words of a text that has fewer, and the number of windows of each text."""
    n = np.diff(ends)
    count = np.where(n > 0, np.maximum(n - WINDOW + 1, 1), 0)
    first = np.cumsum(count) - count
    return np.repeat(ends[:-1], count) + np.arange(int(count.sum())) - np.repeat(first, count), count


def sizes(ends: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Words of each window."""
    return np.repeat(np.minimum(np.diff(ends), WINDOW), count)


def totals(values: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of values over windows, of WINDOW terms at most each."""
    held = np.append(values, np.zeros(WINDOW))
    return sum((np.where(k < size, held[starts + k], 0) for k in range(1, WINDOW)), held[starts])


def once(number: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without repeats of the word before in the same text, which would fill windows with one word."""
    stays = np.ones(len(number), bool)
    stays[1:] = number[1:] != number[:-1]
    stays[ends[:-1][np.diff(ends) > 0]] = True
    return number[stays], np.concatenate([[0], np.cumsum(stays)])[ends]


@dataclass
class ToxicityModel:
    weights: np.ndarray  # difference of the logits by bucket
    bias: float

    def rows(self, words: list[bytes]) -> np.ndarray:
        at, n = ngrams(words, LO, HI, LOG2)
        return means(self.weights, at, n)

    def scores(self, table: WordTable, texts: list[str | None]) -> np.ndarray:
        number, ends = once(*table.numbers(texts))
        per_word = table.held[number]
        top = np.full(len(texts), self.bias)
        starts, count = windows(ends)
        if len(starts):
            size = sizes(ends, count)
            logit = totals(per_word, starts, size) / size + self.bias
            top[count > 0] = np.maximum.reduceat(logit, (np.cumsum(count) - count)[count > 0])
        return 1 / (1 + np.exp(-np.clip(top, -30, 30)))


def fit_texts(texts: list[str], labels: list[int], epochs: tuple[int, int] = (6, 20), seed: int = 7) -> ToxicityModel:
    """Without examples of both labels the model gives the label it saw, or 0, to all."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return ToxicityModel(np.zeros(1 << LOG2), 30.0 if labels and labels[0] else -30.0)
    table = WordTable(split, lambda words: np.zeros(len(words)))
    number, ends = once(*table.numbers(texts))
    at, n = ngrams(table.words.since(0), LO, HI, LOG2)
    first = np.cumsum(n) - n
    rng = np.random.default_rng(seed)
    embed, soft, bias = rng.normal(0, 0.1, (1 << LOG2, DIM)), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    fit = Adagrad(0.15)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    starts, count = windows(ends)
    some = np.flatnonzero(count)
    top = (np.cumsum(count) - count)[some]

    def step(tokens: np.ndarray, size: np.ndarray, docs: np.ndarray) -> None:
        nonlocal embed, soft, bias
        used, back = np.unique(tokens, return_inverse=True)
        gather = np.repeat(first[used] - (np.cumsum(n[used]) - n[used]), n[used]) + np.arange(int(n[used].sum()))
        buckets, m = at[gather], n[used]
        word = means(embed, buckets, m)
        x = means(word, back, size)
        z = x @ soft + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(docs)), y[docs]] -= 1
        dz = p * weight[docs][:, None]
        dx = dz @ soft.T
        dword = scatter(dx, back, size, len(used))
        fit.step("embed", embed, scatter(dword, buckets, m, len(embed)))
        fit.step("soft", soft, x.T @ dz + 1e-5 * soft)
        fit.step("bias", bias, dz.sum(0))

    # the first rounds take every text's words once, whatever their number
    whole = np.diff(ends)
    for _ in range(epochs[0]):
        step(number, whole[some], some)
    size = sizes(ends, count)
    for _ in range(epochs[1]):
        v = means(embed @ (soft[:, 1] - soft[:, 0]), at, n)
        logit = totals(v[number], starts, size) / size
        best = _argmax(logit, top, len(starts))
        n_best = size[best]
        tokens = number[np.repeat(starts[best] - (np.cumsum(n_best) - n_best), n_best) + np.arange(int(n_best.sum()))]
        step(tokens, n_best, some)
    return ToxicityModel(embed @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


def _argmax(values: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """Position of the first greatest value in each run from a start to the next."""
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, total)))
    order = np.lexsort((np.arange(total), -values, run))
    return order[starts]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: dict | None = None) -> ToxicityModel:
    """Fits on a sample, bounded by label, of the rows that aren't held out, whole texts; rows with a null label, id or text aren't used."""
    rows = labelled(docs, labels, label, sample or SAMPLE, lambda i: ~held_out(i, FOLDS, FOLD), id_col, text_col)
    return fit_texts([r[0] for r in rows], [int(r[1]) for r in rows])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id (as given, null too), score (0 to 1).

    A text without words, null or empty, has the score of the bias. Texts of any
    length are scored whole. Rows that repeat an id are scored each. Other columns
    are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(split, shared.value.rows)
        for batch in batches:
            for part in chunks(batch):
                scores = shared.value.scores(table, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {type_of(docs, id_col)}, score double")
