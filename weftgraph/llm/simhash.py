"""SimHash near-duplicate detection with Golay-code fuzzy hashing.

Fingerprints: the XXH64 (seed 42) of every word shingle votes on 64 bits.

Search: a fingerprint has three segments of 22, 21 and 21 bits. Of two that
differ in at most 2 bits, some segment is equal (pigeonhole) and the next one
differs in at most 2 bits. A segment, padded to 23 bits, is decoded by the
perfect binary Golay code: the index of its nearest codeword, and where that is
3 bits away also those of the five codewords 4 bits away. Two words at most 2
bits apart share an index, for these reasons: codewords are 7 bits or more
apart; if neither word is 3 bits from its codeword, the codewords are the same;
otherwise one word's codeword lies within 4 bits of the other, or the bits
outside the error pattern fall into a common codeword at distance 4. So an equal
segment with an index of the next segment is a key (33 or 34 bits), about 16 a
fingerprint, and every link shares a key.

Links: only different fingerprints are joined, by key, and verified by counting
differing bits. A key with more than `bucket` fingerprints isn't joined with
itself, but split by the indices of the third segment, of which a link shares one as
well. What is crowded still is alike in all segments, and links by way of centres. Two differ in at most 2 bits
exactly if some 64-bit word lies within 1 bit of both, so each emits itself and
its 64 one-bit changes, and all that share a centre link to its least one. This
is exact, needs 65 rows a fingerprint however many are alike, and no pairs.

Groups: components of the links of different fingerprints, by one task if they are
few (counted), else by alternating large-star and small-star rounds with a
checkpoint a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Named, chunks, compact, ensure_checkpoint_dir, few_ids, join_hot, type_of

BUCKET = 32
#: So many edges one task unites.
SMALL = 500_000
#: Fingerprints that differ in at most so many bits link; the keys and the centres are made for this number.
BITS = 2
#: (shift, bits) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
GENERATOR = 0b110001110101
BLOCK = 255


def _spread() -> np.ndarray:
    """A byte's bits, the highest first, as eight counters of 8 bits."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return np.ascontiguousarray(bits).view("<u8")[:, 0]


SPREAD = _spread()


def votes_of(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bits set in over half of consecutive runs of n > 0 hashes (eight bytes each, the highest first)."""
    spread = SPREAD[hashes].reshape(-1, 8)
    starts = np.cumsum(n) - n
    # counters of 8 bits hold at most 255 votes, so longer runs are added up block by block
    blocks = -(-n // BLOCK)
    first = np.cumsum(blocks) - blocks
    at = np.repeat(starts, blocks) + BLOCK * (np.arange(int(blocks.sum())) - np.repeat(first, blocks))
    sums = np.add.reduceat(spread, at, axis=0)
    counts = np.ascontiguousarray(sums).view(np.uint8).reshape(len(at), 64).astype(np.int64)
    counts = np.add.reduceat(counts, first, axis=0)
    return np.packbits((2 * counts > n[:, None]).astype(np.uint8), axis=1).view(">u8")[:, 0]


def fingerprints(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """64-bit fingerprints; a text without words has 0."""
    n = np.zeros(len(texts), np.int64)
    digests: list[bytes] = []
    for i, text in enumerate(texts):
        words = text.encode().lower().split() if text else []
        if len(words) >= shingle:
            grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
            own = list(map(xxhash.xxh64_digest, grams, repeat(42)))
            digests += own
            n[i] = len(own)
        elif words:
            digests.append(xxhash.xxh64_digest(b" ".join(words), 42))
            n[i] = 1
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    out[some] = votes_of(np.frombuffer(b"".join(digests), np.uint8), n[some])
    return out


class Golay:
    """Syndromes of the (23, 12) code, the patterns of weight 3 or less, and those of weight 4 beside a weight of 3."""

    def __init__(self):
        def remainder(x: int) -> int:
            for k in range(22, 10, -1):
                if x >> k & 1:
                    x ^= GENERATOR << (k - 11)
            return x

        unit = [remainder(1 << k) for k in range(23)]
        self.low, self.high = (self._linear(u) for u in (unit[:12], unit[12:]))
        self.near = np.zeros(2048, np.int64)
        self.far = np.full((2048, 5), -1, np.int64)
        seen = np.zeros(2048, np.int64)
        for weight in range(1, 5):
            for at in combinations(range(23), weight):
                s = 0
                for k in at:
                    s ^= unit[k]
                pattern = sum(1 << k for k in at)
                if weight < 4:
                    self.near[s] = pattern
                else:
                    self.far[s, seen[s]] = pattern
                    seen[s] += 1

    @staticmethod
    def _linear(unit: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for u in unit:
            out = np.concatenate([out, out ^ u])
        return out

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in words, codeword index): 1 or 6 for each 23-bit word."""
        s = self.low[words & 0xFFF] ^ self.high[words >> 12]
        patterns = np.concatenate([self.near[s][:, None], self.far[s]], axis=1)
        row, column = np.nonzero(patterns >= 0)
        return row, (words[row] ^ patterns[row, column]) >> 11


@cache
def golay() -> Golay:
    return Golay()


def segment(prints: np.ndarray, k: int) -> np.ndarray:
    shift, bits = SEGMENTS[k]
    return (prints >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in prints, key) of uint64 fingerprints."""
    rows, keys = [], []
    for k in range(3):
        row, index = golay().indices(segment(prints, (k + 1) % 3))
        rows.append(row)
        keys.append((np.int64(k) << 34) | (segment(prints, k)[row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                prints = fingerprints(part.column(1).to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {type_of(docs, id_col)}, fp long")


def _keys(prints: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            row, key = golay_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key long, fp long")


def _finer_keys(held: DataFrame) -> DataFrame:
    """key, fp of rows key, fp: the key with each index of the segment that has no part in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp = (batch.column(k).to_numpy() for k in (0, 1))
            for k in range(3):
                some = np.flatnonzero(key >> 34 == k)
                row, index = golay().indices(segment(fp[some].view(np.uint64), (k + 2) % 3))
                yield pa.RecordBatch.from_arrays([pa.array(key[some][row] << 12 | index), pa.array(fp[some][row])], ["key", "fp"])

    return held.select("key", "fp").mapInArrow(run, "key long, fp long")


def _met(keyed: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Of rows key, fp: the pairs a, b under keys of at most bucket fingerprints that differ in at most BITS bits, and the rows of other keys."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = keyed.join(sizes, "key").checkpoint()
    few = held.filter(F.col("n") <= bucket).select("key", "fp")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "key").filter((F.col("a") < F.col("b")) & (differ <= BITS)).select("a", "b")
    return pairs, held.filter(F.col("n") > bucket).select("key", "fp")


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between different fingerprints (column fp, no repeats) that connect all at most BITS bits apart, and no others."""
    ensure_checkpoint_dir(prints.sparkSession)
    pairs, crowded = _met(_keys(prints), bucket)
    finer, many = _met(_finer_keys(crowded), bucket)
    many = many.select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)))
    centres = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    # a centre has 65 fingerprints at most
    stars = centres.withColumn("a", F.min("fp").over(Window.partitionBy("centre"))).filter("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(finer).unionByName(stars).distinct()


def _united(edges: DataFrame) -> DataFrame:
    """Components of edges u, v, all in one task."""
    kind = type_of(edges, "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(up.setdefault(u, u)), root(up.setdefault(v, v))
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field(0).type) for x in (nodes, [root(x) for x in nodes])] if nodes else [pa.array([], pa.null())] * 2, ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """node, root (the least node reachable) of edges a, b; nodes without an edge don't appear.

    Up to small edges are united by one task; more go through rounds until nothing changes.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges, n = compact(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if not n:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if n <= small:
        return _united(edges)
    seen = None
    while True:
        # large-star: larger neighbours meet the least of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small-star: smaller neighbours and the node itself meet the least one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = small.checkpoint()
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id reachable over links, itself included).

    Null and empty texts have fingerprint zero and link like any other. Rows
    that repeat an id are each a member. A component whose ids are all null has
    a null component_id. Other columns are not read; an empty table gives an
    empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    # the only pass over texts; later steps read these two values a row from the shared folder
    rows = simhash(docs, id_col, text_col, shingle).checkpoint()
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).checkpoint()
    found = components(links(prints, bucket))
    rooted = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    # a component may hold most fingerprints, so its least id is found apart and dealt out
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints")).checkpoint()
    classes = join_hot(rooted, groups, ["root"], "prints", ["fp"]).select("fp", "n", "component_id").checkpoint()
    return join_hot(rows, classes, ["fp"], "n", ["doc_id"]).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns; rows with a null id stay only in components without ids."""
    named = Named(docs)
    found = near_duplicates(named.rows, named.at(id_col), named.at(text_col), shingle)
    # those that go are few, so texts needn't be dealt out
    gone = found.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).filter("not stays").select("__id").checkpoint()
    return named.back(named.rows.join(few_ids(gone), F.col(named.at(id_col)).eqNullSafe(F.col("__id")), "left_anti"))
