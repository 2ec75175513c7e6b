"""Language identification by error-correcting output codes.

Each language has a codeword of bits; a binary classifier over hashed byte
n-grams of words predicts each bit. Up to five languages get the exhaustive
code (every split of the languages into two sides); more get the best of some
random codes by least distance between codewords and between columns. Decoding
adds up, for each language, the logistic losses of its bits against the margins;
the language of least loss wins. A decision is ambiguous if the margins lie
between codewords: the runner-up's loss is within a small gap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_out, type_of
from .subwords import Adagrad, WordTable, labelled, means, ngrams, scatter

LOG2, LO, HI = 15, 1, 4
#: Bounds of the sample to fit on: documents of a language, and of all languages together (one of each at least).
PER_LANGUAGE, SAMPLE = 300, 20_000
FOLDS, FOLD = 4, 2
UNKNOWN = "und"
#: Gap of loss a bit under which a decision is ambiguous.
GAP = 0.02
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LETTER = regex.compile(r"\p{L}")


def split(text: str) -> list[bytes]:
    return text.lower().encode().translate(LETTERS).split()


def codewords(k: int, seed: int = 3) -> np.ndarray:
    """k rows of -1 and 1."""
    if k <= 5:
        bits = max(1, 2 ** (k - 1) - 1)
        return np.array([[1 if c == 0 else 1 - 2 * ((b + 1) >> (c - 1) & 1) for b in range(bits)] for c in range(k)])
    bits, rng, best, most = math.ceil(10 * math.log2(k)), np.random.default_rng(seed), None, -1.0
    # of many languages fewer codes are tried, as comparing codewords costs the square of their number
    for _ in range(max(1, min(50, 10**7 // k**2))):
        code = rng.choice([-1, 1], (k, bits))
        columns = np.abs(code.T @ code)
        np.fill_diagonal(columns, 0)
        far = (bits - _nearest(code)) / 2 + (k - columns.max()) / (2 * k)
        if abs(code.sum(0)).max() < k and far > most:
            best, most = code, far
    return code if best is None else best


def _nearest(code: np.ndarray, step: int = 512) -> int:
    """The greatest product of two codewords."""
    most = -code.shape[1]
    floats = code.astype(np.float32)
    for a in range(0, len(code), step):
        rows = floats[a : a + step] @ floats.T
        rows[np.arange(len(rows)), a + np.arange(len(rows))] = most
        most = max(most, int(rows.max()))
    return most


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray

    def rows(self, words: list[bytes]) -> np.ndarray:
        at, n = ngrams(words, LO, HI, LOG2)
        return means(self.weights, at, n)

    def predict(self, table: WordTable, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and whether a decision is ambiguous."""
        none = np.array([not t or not LETTER.search(t) for t in texts])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        number, ends = table.numbers(texts)
        margin = means(table.held, number, np.diff(ends)) + self.bias
        # a bit's loss is that of either sign, so no array of documents by languages by bits is needed
        plus, minus = np.logaddexp(0, -margin), np.logaddexp(0, margin)
        loss = plus @ (self.code == 1).T + minus @ (self.code == -1).T
        order = np.argsort(loss, axis=1, kind="stable")
        least = np.take_along_axis(loss, order[:, :1], 1)
        score = 1 / np.exp(least - loss).sum(1)
        vague = np.zeros(len(texts), bool)
        if len(self.languages) > 1:
            vague = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - least[:, 0] < GAP * self.code.shape[1]
        names = [UNKNOWN if x else self.languages[k] for x, k in zip(none, order[:, 0], strict=True)]
        return names, np.where(none, 0.0, score), vague & ~none


def fit_texts(texts: list[str], languages: list[str], epochs: int = 20) -> LanguageModel:
    names = sorted(set(languages))
    code = codewords(max(1, len(names)))
    weights, bias = np.zeros((1 << LOG2, code.shape[1])), np.zeros(code.shape[1])
    model = LanguageModel(names, code, weights, bias)
    if len(names) < 2:
        return model
    owner = np.array([names.index(x) for x in languages])
    target = code[owner]
    weight = (1 / np.bincount(owner))[owner] / len(names)
    table = WordTable(split, lambda words: np.zeros(len(words)))
    number, ends = table.numbers(texts)
    size = np.diff(ends)
    at, n = ngrams(table.words.since(0), LO, HI, LOG2)
    fit = Adagrad(1.0)
    for _ in range(epochs):
        margin = means(means(weights, at, n), number, size) + bias
        slope = -target / (1 + np.exp(np.clip(target * margin, -30, 30))) * weight[:, None]
        fit.step("weights", weights, scatter(scatter(slope, number, size, len(n)), at, n, len(weights)))
        fit.step("bias", bias, slope.sum(0))
    return model


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fits on at most per_language documents of each language and about SAMPLE of all, of those not held out, whole texts.

    Null languages, ids and texts aren't used. Without any, every document is `und`.
    The model has a codeword for each language, of any number of them.
    """
    some = docs.filter(F.col(lang_col).isNotNull())
    names = some.select(F.count_distinct(lang_col)).first()[0]
    rows = labelled(docs, some, lang_col, min(per_language, max(1, SAMPLE // max(1, names))), lambda i: ~held_out(i, FOLDS, FOLD), id_col, text_col)
    return fit_texts([r[0] for r in rows], [r[1] for r in rows])


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id (as given, null too), lang_pred, score, ambiguous, and the columns named in keep (none of these four).

    lang_pred is `und`, with score 0, if a text is null or has no letter. Of languages
    of equal loss the first by name wins. Texts of any length are read whole. Rows that
    repeat an id are predicted each. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    aliases = [f"_{k}" for k in range(len(keep))]
    others = [c for c in keep if c != text_col]
    at = [1 if c == text_col else 2 + others.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(split, shared.value.rows)
        for batch in batches:
            for part in chunks(batch):
                names, score, vague = shared.value.predict(table, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(vague), *(part.column(k) for k in at)], ["doc_id", "lang_pred", "score", "ambiguous", *aliases])

    kinds = "".join(f", {a} {docs.schema[c].dataType.simpleString()}" for a, c in zip(aliases, keep, strict=True))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *(F.col(c).alias(f"__{k}") for k, c in enumerate(others)))
    out = rows.mapInArrow(run, f"doc_id {type_of(docs, id_col)}, lang_pred string, score double, ambiguous boolean" + kinds)
    return out.withColumnsRenamed(dict(zip(aliases, keep, strict=True))) if keep else out
