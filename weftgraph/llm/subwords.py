"""Words of texts as numbers, their hashed byte n-grams, and labelled samples to fit on."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import VOCAB_CHARS, Vocab, sample_near

MAX_WORDS = 200_000
#: Characters of texts whose words are numbered at a time.
SLICE = 2_000_000
#: n-grams that are in memory as vectors at a time.
BLOCK = 400_000


class Words:
    """Splits texts and numbers the different words, to be forgotten when they are over MAX_WORDS or VOCAB_CHARS."""

    def __init__(self, split):
        self.split, self.vocab = split, Vocab()

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of all texts together; where each text's words end, after a first 0."""
        words: list[bytes] = []
        parts, before, size = [], 0, 0
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts, 1):
            if t:
                words += self.split(t)
                size += len(t)
            ends[i] = before + len(words)
            if size > SLICE:
                parts.append(self.vocab.numbers(words))
                words, before, size = [], before + len(words), 0
        return np.concatenate([*parts, self.vocab.numbers(words)]), ends

    def since(self, n: int) -> list[bytes]:
        return list(self.vocab)[n:]

    def full(self) -> bool:
        return self.vocab.full(MAX_WORDS, VOCAB_CHARS)


class WordTable:
    """A row of numbers for each word, computed once by `rows` for new words."""

    def __init__(self, split, rows):
        self.split, self.rows = split, rows
        self.words = Words(split)
        self.held = rows([])

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if self.words.full():
            self.words, self.held = Words(self.split), self.rows([])
        number, ends = self.words.numbers(texts)
        new = self.words.since(len(self.held))
        if new:
            self.held = np.concatenate([self.held, self.rows(new)])
        return number, ends


def ngrams(words: list[bytes], lo: int, hi: int, buckets_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams of lo to hi bytes, the word being framed by < and >, and of the word itself; number of buckets of each word."""
    parts, at, size = [], 0, 0
    for i, w in enumerate(words, 1):
        size += len(w)
        if size > BLOCK // 8 or i == len(words):
            parts.append(_ngrams(words[at:i], lo, hi, buckets_log2))
            at, size = i, 0
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _ngrams(words: list[bytes], lo: int, hi: int, buckets_log2: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) + 2 for w in words], np.int64)
    raw = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    ends = np.cumsum(size)
    left = np.repeat(ends, size) - np.arange(len(raw))  # bytes from here to the word's end
    owner = np.repeat(np.arange(len(words)), size)
    shift = np.uint64(64 - buckets_log2)
    mix = np.uint64(0x9E3779B97F4A7C15)
    rows, found = [np.arange(len(words))], [(np.array([zlib.crc32(w) for w in words], np.uint64) * mix) >> shift]
    h = np.zeros(len(raw), np.uint64)
    for n in range(1, hi + 1):
        h[: len(raw) - n + 1] = h[: len(raw) - n + 1] * np.uint64(0x100000001B3) + raw[n - 1 :] + np.uint64(1)
        if n >= lo:
            at = np.flatnonzero(left >= n)
            rows.append(owner[at])
            found.append(((h[at] ^ np.uint64(n)) * mix) >> shift)
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return np.concatenate(found).astype(np.int32)[order], np.bincount(row, minlength=len(words))


def means(table: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Means of the rows of table at consecutive runs of n positions; 0 for an empty run."""
    out = np.zeros((len(n), *table.shape[1:]), table.dtype)
    ends = np.cumsum(n)
    # as many runs at a time as hold about BLOCK positions, at least one
    a = 0
    while a < len(n):
        begin = ends[a] - n[a]
        b = max(a + 1, int(np.searchsorted(ends, begin + BLOCK, side="right")))
        some = n[a:b] > 0
        if some.any():
            starts = (ends[a:b] - n[a:b])[some] - begin
            out[a:b][some] = np.add.reduceat(table[at[begin : ends[b - 1]]], starts, axis=0) / n[a:b][some].reshape(-1, *[1] * (table.ndim - 1))
        a = b
    return out


def scatter(grad: np.ndarray, at: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """The gradient of means() for a table of `rows` rows."""
    share = grad / np.maximum(n, 1)[:, None]
    out = np.zeros((rows, grad.shape[1]))
    for k in range(grad.shape[1]):
        out[:, k] = np.bincount(at, np.repeat(share[:, k], n), rows)
    return out


class Adagrad:
    def __init__(self, rate: float):
        self.rate, self.sums = rate, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        held = self.sums.setdefault(name, np.zeros_like(value))
        held += grad * grad
        value -= self.rate * grad / np.sqrt(held + 1e-12)


def labelled(docs: DataFrame, marks: DataFrame, label: str, per_label: dict | int, fit_rows, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> list[tuple]:
    """(text, label, *more) of documents whose id has a label in marks, by ascending id.

    per_label: how many documents of each label at most, those of least hash of the
    id; labels that a dict lacks aren't used. This bounds the rows that reach the
    driver (about 1.25 times as many do), whatever their length. fit_rows: which ids
    may be used. Of an id with several labels the greatest counts; of one with
    several texts that of least hash.
    """
    known = marks.select(F.col(id_col).alias("__id"), F.col(label).alias("__label")).filter(F.col("__label").isNotNull() & F.col("__id").isNotNull() & fit_rows(F.col("__id")))
    known = known.groupBy("__id").agg(F.max("__label").alias("__label"))
    if isinstance(per_label, dict):
        known = known.filter(F.col("__label").isin(list(per_label)))
        n = F.create_map(*(F.lit(x) for pair in per_label.items() for x in pair))[F.col("__label")]
    else:
        n = F.lit(per_label)
    ids = F.broadcast(sample_near(known, "__id", "__label", n))
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *(F.col(c).alias(f"__{k}") for k, c in enumerate(more)))
    row = F.struct(F.xxhash64("__text"), "__at", "__text", "__label", *(f"__{k}" for k in range(len(more))))
    left: dict = {}
    kept = []
    for i, (_, _, *found) in sorted(rows.join(ids, "__id").groupBy("__id").agg(F.min(row).alias("row")).collect(), key=lambda r: (r.row["__at"], r[0])):
        y = found[1]
        left[y] = left.get(y, per_label[y] if isinstance(per_label, dict) else per_label) - 1
        if left[y] >= 0:
            kept.append((i, *found))
    return [tuple(r[1:]) for r in sorted(kept, key=lambda r: r[0])]
