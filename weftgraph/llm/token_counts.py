"""Token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links with precomputed numbers of popped
tokens: where the walk of a word can't go on by a byte, it adds the number of
greedy longest-match tokens that the failure link pops and goes on from the
link's state, so a word's number of pieces comes from one linear walk and no
piece is built. A worker walks each different word once, all new words of a
chunk at a time, one column of bytes after the other.

Words are runs without ASCII white space, walked with a space before them, as
the vocabularies of byte-level tokenizers mark word starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import VOCAB_CHARS, Vocab, chunks, type_of
from .pairtable import PairTable

MAX_WORDS = 200_000
CELLS = 4_000_000
#: Fewer words than this go on byte by byte.
FEW = 24


class LongestMatch:
    """Over a vocabulary that holds every single byte, so each word has a match."""

    def __init__(self, tokens: list[bytes]):
        child: list[dict[int, int]] = [{}]
        ends = [False]
        for t in tokens:
            at = 0
            for b in t:
                to = child[at].get(b)
                if to is None:
                    to = child[at][b] = len(child)
                    child.append({})
                    ends.append(False)
                at = to
            ends[at] = True
        if any(b not in child[0] or not ends[child[0][b]] for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        fail, pops = [0] * len(child), [0] * len(child)
        level = [0]
        while level:
            below = []
            for u in level:
                for b, v in child[u].items():
                    below.append(v)
                    if ends[v]:
                        fail[v], pops[v] = 0, 1
                        continue
                    z, n = fail[u], pops[u]
                    while b not in child[z]:
                        n += pops[z]
                        z = fail[z]
                    fail[v], pops[v] = child[z][b], n
            level = below
        self.fail, self.pops = np.array(fail), np.array(pops)
        self.steps: dict[int, int] | None = None  # the edges again, made by a worker that needs them
        self.links: tuple[list[int], list[int]] = [], []
        edges = [(u << 8 | b, v) for u, to in enumerate(child) for b, v in to.items()]
        self.edges = PairTable(np.array([k for k, _ in edges], np.int64), np.array([v for _, v in edges], np.int64), -1)

    def _walk(self, words: list[bytes]) -> np.ndarray:
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = (np.cumsum(size) - size)[order]
        longest = size[order]
        state, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for j in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-longest, -j, side="left"))
            if live < FEW:
                for k in range(live):
                    self._go_on(state, count, k, flat[start[k] + j : start[k] + longest[k]].tolist())
                break
            byte = flat[start[:live] + j]
            to = self.edges.get(state[:live] << 8 | byte)
            left = np.flatnonzero(to < 0)
            while len(left):
                count[left] += self.pops[state[left]]
                state[left] = self.fail[state[left]]
                to[left] = self.edges.get(state[left] << 8 | byte[left])
                left = left[to[left] < 0]
            state[:live] = to
        left = np.flatnonzero(state)
        while len(left):
            count[left] += self.pops[state[left]]
            state[left] = self.fail[state[left]]
            left = left[state[left] > 0]
        out = np.zeros(len(words), np.int64)
        out[order] = count
        return out

    def _go_on(self, state: np.ndarray, count: np.ndarray, k: int, rest: list[int]) -> None:
        """The walk of one word's other bytes, byte by byte: few long words aren't worth a column each."""
        if self.steps is None:
            held = self.edges.keys >= 0
            self.steps = dict(zip(self.edges.keys[held].tolist(), self.edges.values[held].tolist(), strict=True))
            self.links = self.fail.tolist(), self.pops.tolist()
        steps, (fail, pops) = self.steps, self.links
        at, n = int(state[k]), int(count[k])
        for b in rest:
            to = steps.get(at << 8 | b)
            while to is None:
                n += pops[at]
                at = fail[at]
                to = steps.get(at << 8 | b)
            at = to
        state[k], count[k] = at, n

    def count(self, words: list[bytes]) -> np.ndarray:
        """Number of greedy longest-match tokens of each word."""
        out, at, size = [], 0, 0
        for i, w in enumerate(words):
            size += len(w)
            if size > CELLS:
                out.append(self._walk(words[at : i + 1]))
                at, size = i + 1, 0
        return np.concatenate([*out, self._walk(words[at:])])


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id (as given, null too), n_words, n_tokens.

    Null and empty texts have none. Texts and words of any length are read whole.
    Rows that repeat an id are counted each. Other columns are not read; an empty
    table gives an empty result.
    """
    with open(vocabulary, "rb") as f:
        automaton = docs.sparkSession.sparkContext.broadcast(LongestMatch(read_ranks(f.read())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, vocab, counts = automaton.value, Vocab(), np.zeros(0, np.int64)
        for batch in batches:
            for part in chunks(batch):
                if vocab.full(MAX_WORDS, VOCAB_CHARS):
                    vocab, counts = Vocab(), np.zeros(0, np.int64)
                words: list[bytes] = []
                ends = np.zeros(part.num_rows + 1, np.int64)
                for i, t in enumerate(part.column(1).to_pylist(), 1):
                    if t:
                        words += t.encode().split()
                    ends[i] = len(words)
                number = vocab.numbers(words)
                if len(vocab) > len(counts):
                    counts = np.concatenate([counts, match.count([b" " + w for w in list(vocab)[len(counts) :]])])
                total = np.concatenate([[0], np.cumsum(counts[number])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends)), pa.array(np.diff(total[ends]))], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {type_of(docs, id_col)}, n_words long, n_tokens long")
