"""Byte-level BPE over length-bucketed padded numpy matrices.

A text is split by the vocabulary's pattern; each different piece that a worker
meets is encoded once. Pieces of like length form a padded matrix of token ids,
one row a piece. In a round every row merges its leftmost pair of least rank:
ranks of adjacent pairs come from a hash table of all pairs whose bytes together
are a token, the merged token replaces its left part, the columns behind move up
by one (compaction), and only the two pairs beside it are looked up anew. Rows
without a mergeable pair leave the matrix.

A piece of more than LONG bytes (a run of one character class without spaces) is a
matrix of one row. Its rounds merge all pairs of the least rank that don't overlap,
leftmost first: where each token's own bytes merge to this token (checked once), no
merge makes a pair of its rank or a lesser one, since the bytes of such a pair would
have merged before. So there are as many rounds as different ranks, not as merges.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import VOCAB_CHARS, Vocab, chunks, ragged, type_of
from .pairtable import PairTable

NONE = 1 << 30
LONG = 2048
CELLS = 1_000_000
MAX_PIECES = 300_000


def read_ranks(raw: bytes) -> list[bytes]:
    """Token bytes by rank, from lines of base64 and rank; ranks are 0 to n - 1."""
    ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in raw.splitlines() if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks aren't 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


class Bpe:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = [(self.rank[t[:k]], self.rank[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        left, right, whole = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        self.pairs = PairTable(left << 32 | right, whole, NONE)
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.forget()

    def forget(self) -> None:
        self.vocab = Vocab()
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)

    @cached_property
    def regular(self) -> bool:
        """Does each token's own bytes merge to this token."""
        buckets: dict[int, list[bytes]] = {}
        for t in self.rank:
            if len(t) > 1:
                buckets.setdefault(len(t), []).append(t)
        return all(len(x) == 1 for n, same in buckets.items() for x in self._matrix(same, n))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = np.where((left < 0) | (right < 0), 0, left << 32 | right)
        return np.where((left < 0) | (right < 0), NONE, self.pairs.get(keys.ravel()).reshape(keys.shape))

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        size = np.array([len(p) for p in pieces], np.int64)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.full((len(pieces), width), -1, np.int64)
        ids[np.arange(width) < size[:, None]] = self.byte[flat]
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        row = np.arange(len(pieces))
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(row):
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            rank = np.take_along_axis(ranks, best[:, None], 1)[:, 0] if ranks.shape[1] else np.full(len(row), NONE)
            done = rank == NONE
            if done.any():
                for r, x, n in zip(row[done].tolist(), ids[done], size[done].tolist(), strict=True):
                    out[r] = x[:n]
                row, ids, ranks, size, best, rank = (x[~done] for x in (row, ids, ranks, size, best, rank))
                if not len(row):
                    break
            every = np.arange(len(row))
            ids[every, best] = rank
            size = size - 1
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > best[:, None]), 1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= best[:, None]), 1)
            before = every[best > 0]
            ranks[before, best[before] - 1] = self._ranks(ids[before, best[before] - 1], ids[before, best[before]])
            after = every[best < ranks.shape[1]]
            ranks[after, best[after]] = self._ranks(ids[after, best[after]], ids[after, best[after] + 1])
        return out

    def _row(self, piece: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        ranks = self._ranks(ids[:-1], ids[1:])
        while len(ranks):
            rank = ranks.min()
            if rank == NONE:
                break
            at = np.flatnonzero(ranks == rank)
            # of a run of neighbouring pairs, every second one from the first
            first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            at = at[nth % 2 == 0]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids[at] = rank
            ids = ids[stays]
            # the pair behind a merged one goes with its right part
            ranks = np.append(ranks, NONE)[stays][: len(ids) - 1]
            at = at - np.arange(len(at))
            anew = np.unique(np.concatenate([at, at - 1]))
            anew = anew[(anew >= 0) & (anew < len(ranks))]
            ranks[anew] = self._ranks(ids[anew], ids[anew + 1])
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.rank.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int64)
            elif len(p) > LONG and self.regular:
                out[i] = self._row(p)
            else:
                buckets.setdefault(len(p) if len(p) < 16 else -(-len(p) // 8) * 8, []).append(i)
        for width, at in buckets.items():
            step = max(1, CELLS // width)
            for k in range(0, len(at), step):
                part = at[k : k + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts together, and the number of ids of each."""
        if self.vocab.full(MAX_PIECES, VOCAB_CHARS):
            self.forget()
        pieces: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts, 1):
            if t:
                pieces += self.split(t)
            ends[i] = len(pieces)
        known = len(self.vocab)
        number = self.vocab.numbers(pieces)
        if len(self.vocab) > known:
            new = self.encode_pieces([p.encode() for p in list(self.vocab)[known:]])
            n = np.array([len(x) for x in new], np.int64)
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
            self.n = np.concatenate([self.n, n])
            self.ids = np.concatenate([self.ids, np.concatenate(new).astype(np.uint32)])
        n = self.n[number]
        ids = self.ids[ragged(self.at[number], n)]
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(total[ends])

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The bytes of consecutive runs of n ids each."""
        size = self.size[ids]
        raw = self.raw[ragged(self.start[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])].tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


_held: dict[tuple, Bpe] = {}


def _bpe(key: tuple, tokens: list[bytes], pattern: str) -> Bpe:
    """One for each vocabulary and worker."""
    if key not in _held:
        _held.clear()
        _held[key] = Bpe(tokens, pattern)
    return _held[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode_back: bool = False) -> DataFrame:
    """One row per row of docs: doc_id (as given, null too), n_tokens, ids (binary: little-endian unsigned 32-bit), and with decode_back the bytes that these ids decode to.

    vocabulary: a file of ranks, which the driver reads; executors get its
    tokens. Null and empty texts have no tokens. A pattern that leaves out
    characters drops them, as the public library does. Texts and pieces of any length
    are encoded whole; rows that repeat an id are encoded each. Other columns are not
    read; an empty table gives an empty result.
    """
    with open(vocabulary, "rb") as f:
        tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(f.read()))
    key = (vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(key, tokens.value, pattern)
        for batch in batches:
            for part in chunks(batch):
                ids, n = bpe.encode(part.column(1).to_pylist())
                raw, ends = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(n)])).tolist()
                columns = {"doc_id": part.column(0), "n_tokens": pa.array(n), "ids": pa.array([raw[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary())}
                if decode_back:
                    columns["decoded"] = pa.array(bpe.decode(ids, n), pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {type_of(docs, id_col)}, n_tokens long, ids binary" + ", decoded binary" * decode_back)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (binary) of rows with ids as encode() writes them; null ids decode to no bytes."""
    with open(vocabulary, "rb") as f:
        tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe((vocabulary, ""), tokens.value, "")
        for batch in batches:
            rows = [np.frombuffer(x or b"", "<u4") for x in batch.column(1).to_pylist()]
            out = [bpe.decode(x, np.array([len(x)]))[0] for x in rows]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "decoded": pa.array(out, pa.binary())})

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {type_of(encoded, id_col)}, decoded binary")
