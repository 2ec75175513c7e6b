"""Benchmark decontamination with a generalised suffix automaton.

Items and documents are normalised alike: A-Z in lower case, words of digits,
letters a-z and characters beyond ASCII. The automaton is built over the word
sequences of all items and holds every run of words that any item holds. A document's words stream through it, which
tracks the length of the longest run ending at each word that some item holds.
Where that length reaches the window, the last `window` words are a window of
the items of the state reached by suffix links; an item shorter than the window
counts as a whole. Hit words are those inside any occurrence.

Words that no item holds reset the automaton, so only stretches of known words
at least as long as the shortest window are streamed: others can't match.

A test set of more than PASS_WORDS words is read in several passes, each with an
automaton of some of the items: a pass hands on the hit spans of the documents that
it hits, and the spans of all passes are united. So neither the driver nor a worker
holds more than one automaton, whatever the number of items; an item longer than
that is split into parts that overlap by a window less one word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ensure_checkpoint_dir, type_of

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A-Z to a-z; bytes that no word holds to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of the items of one automaton, which takes about a kilobyte for each.
PASS_WORDS = 200_000


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised over items: (id as string, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.items = sorted({i for i, w in items if w})
        number = {i: n for n, i in enumerate(self.items)}
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        owners: list[set[int]] = [set()]
        shorts: list[tuple[int, int, int]] = []
        self.shortest = window
        for name, ws in items:
            state, item = 0, number.get(name, -1)
            for w in ws:
                state = self._extend(state, self.words.setdefault(w, len(self.words)), owners)
                owners[state].add(item)
            if ws and len(ws) < window:
                shorts.append((state, len(ws), item))
                self.shortest = min(self.shortest, len(ws))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for s in order:
            if self.link[s] > 0:
                owners[self.link[s]] |= owners[s]
        # the state, itself or reached by suffix links, of the last `window` words of a run that ends in a state
        self.full: list[int] = [0] * len(self.link)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        own: dict[int, set[tuple[int, int]]] = {}
        for s, n, item in shorts:
            while self.length[self.link[s]] >= n:
                s = self.link[s]
            own.setdefault(s, set()).add((n, item))
        for s in reversed(order):
            up = self.link[s]
            self.full[s] = 0 if self.length[s] < window else s if self.length[up] < window else self.full[up]
            self.short[s] = tuple(sorted({*self.short[up], *own.get(s, ())}))
        self.owners = [frozenset(x) for x in owners]

    def _extend(self, last: int, w: int, owners: list[set[int]]) -> int:
        def copy(p: int, q: int) -> int:
            """A state of q's shorter runs, which end at p's length plus one word."""
            self.next.append(dict(self.next[q]))
            self.link.append(self.link[q])
            self.length.append(self.length[p] + 1)
            owners.append(set())
            c = len(self.link) - 1
            self.link[q] = c
            while p >= 0 and self.next[p].get(w) == q:
                self.next[p][w] = c
                p = self.link[p]
            return c

        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else copy(last, q)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        owners.append(set())
        new, p = len(self.link) - 1, last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else copy(p, q)
        return new

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [from, to) of hit words of a document, disjoint and ascending, and the items that occur. ids: word numbers, -1 if no item holds the word."""
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        begins, ends = known[::2], known[1::2]
        wide = ends - begins >= self.shortest
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for begin, end in zip(begins[wide].tolist(), ends[wide].tolist(), strict=True):
            state = n = 0
            for at, w in enumerate(ids[begin:end].tolist(), begin + 1):
                to = nxt[state].get(w)
                while to is None and state:
                    state = link[state]
                    n = length[state]
                    to = nxt[state].get(w)
                if to is None:
                    continue
                state, n = to, n + 1
                reach = 0
                if n >= window:
                    reach = window
                    # the state of the last `window` words: at or above this one
                    up = self.full[state] if length[link[state]] >= window else state
                    found |= self.owners[up]
                for short, item in self.short[state]:
                    if short <= n:
                        reach = max(reach, short)
                        found.add(item)
                if reach:
                    a = at - reach
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                    spans.append((a, at))
        return spans, found


def passes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10, limit: int = PASS_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items by ascending id, in lists of up to about limit words: (id as string, words). The driver holds one list, and reads one partition of items at a time."""
    held: list[tuple[str, list[bytes]]] = []
    total = 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull()).orderBy("id", "text")
    for name, text in rows.toLocalIterator():
        ws = words(text)
        # parts of a long item hold each of its windows once
        for at in range(0, max(1, len(ws) - window + 1), max(1, limit)):
            part = ws[at : at + limit + window - 1]
            if held and total + len(part) > limit + window - 1:
                yield held
                held, total = [], 0
            held.append((name, part))
            total += len(part)
    if held:
        yield held


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def _numbers(automaton: SuffixAutomaton, text: str | None) -> np.ndarray:
    ws = words(text)
    number = automaton.words.get
    return np.fromiter((number(w, -1) for w in ws), np.int64, len(ws))


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _hits(rows: DataFrame, items: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    """__id, __mark, spans, items of the rows that items hit; rows has __id, __mark and __text."""
    automaton = rows.sparkSession.sparkContext.broadcast(SuffixAutomaton(items, window))
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sa = automaton.value
        for batch in batches:
            for part in chunks(batch, 2):
                at, ends, names = [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    spans, found = sa.scan(_numbers(sa, text))
                    if spans:
                        at.append(i)
                        ends.append([x for span in spans for x in span])
                        names.append(sorted(sa.items[k] for k in found))
                keep = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array(ends, kind), pa.array(names, pa.list_(pa.string()))], ["__id", "__mark", "spans", "items"])

    return rows.select("__id", "__mark", "__text").mapInArrow(run, f"__id {type_of(rows, '__id')}, __mark long, spans array<long>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, max_coverage: float = 0.8, keep: tuple[str, ...] = (), pass_words: int = PASS_WORDS) -> DataFrame:
    """One row per row of docs: doc_id (as given), n_words, n_hit, items (ids of items with occurring windows, ascending as strings), text without hit spans, dropped, and the columns named in keep (none of these six).

    A span is hit from one window on (the length limit); dropped: hit words are
    over max_coverage of all words, so the whole text goes (the coverage limit).
    Null text has no words and stays null. Items with a null id or no words
    never occur; items of one id are one item. Without items nothing is hit.
    Texts of any length are read whole; rows that repeat an id are read each.
    Other columns are not read; an empty table gives an empty result.
    """
    aliases = [f"_{k}" for k in range(len(keep))]
    mark = F.xxhash64(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("__id"), mark.alias("__mark"), F.col(text_col).alias("__text"), *(F.col(c).alias(a) for c, a in zip(keep, aliases, strict=True)))
    lists = passes(benchmark, window=window, limit=pass_words)
    first, second = next(lists, []), next(lists, None)
    whole = None
    if second is None:
        whole = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(first, window))
        found = rows.withColumns({"__spans": F.lit(None).cast("array<array<long>>"), "__items": F.lit(None).cast("array<array<string>>")})
    else:
        ensure_checkpoint_dir(docs.sparkSession)
        hits = None
        for items in chain([first, second], lists):
            own = _hits(rows, items, window).checkpoint()
            hits = own if hits is None else hits.unionByName(own)
        # a row's key holds its text's hash, so rows that repeat an id meet the hits of their text
        hits = hits.distinct().groupBy(F.col("__id").alias("__i"), F.col("__mark").alias("__m")).agg(F.collect_list("spans").alias("__spans"), F.collect_list("items").alias("__items"))
        found = rows.join(hits, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__mark") == F.col("__m")), "left")
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_())
    names = ["doc_id", "n_words", "n_hit", "items", "text", "dropped", *aliases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sa = whole.value if whole is not None else None
        for batch in batches:
            for part in chunks(batch):
                out: list[list] = [[], [], [], [], []]
                for text, own, named in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    if sa is not None:
                        numbers = _numbers(sa, text)
                        n = len(numbers)
                        spans, at = sa.scan(numbers)
                        items = sorted(sa.items[k] for k in at)
                    else:
                        n = len(words(text))
                        spans = _united([(x[k], x[k + 1]) for x in own or () for k in range(0, len(x), 2)])
                        items = sorted({i for x in named or () for i in x})
                    hit = sum(b - a for a, b in spans)
                    drop = hit > max_coverage * n if n else False
                    for column, value in zip(out, (n, hit, items, _cut(text, spans) if spans else text, drop), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, out, kinds), *part.columns[4:]], names)

    more = "".join(f", {a} {docs.select(F.col(c)).schema[0].dataType.simpleString()}" for a, c in zip(aliases, keep, strict=True))
    result = found.select("__id", "__text", "__spans", "__items", *aliases).mapInArrow(run, f"doc_id {type_of(docs, id_col)}, n_words long, n_hit long, items array<string>, text string, dropped boolean" + more)
    return result.withColumnsRenamed(dict(zip(aliases, keep, strict=True))) if keep else result
