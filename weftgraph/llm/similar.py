"""Near copies by similarity of word shingles: every pair of 0.8 or more (Jaccard, five words), found exactly.

Search: a text's shingles, as 64-bit hashes, stand in one order for all texts:
those that a sample of texts shares come last, else by hash. The sample is a share of
all texts, so a shingle of some hundred texts is known in a table of any size. Of two sets at least
4/5 similar, each has 4/5 of its members in common with the other, so the first n -
ceil(4n/5) + 1 of each set's n members share one. These are the keys. The first
common key of two sets also bounds what follows it, so pairs whose sizes or places
under a key leave too little in common go by four numbers. The sample only shapes
the order; any order finds all pairs.

Crowded keys: under each key all meet its least and its greatest id, which have then
met all others and leave it; a key whose members are in one component is settled. Of
the rest, members outside a key's most frequent component meet all of other
components; those of one component never meet again. So a crowd of copies costs rows
in proportion to its size, and no pair is left out. Keys that a sample shares are
dealt out by id, so none is one task's.

Texts are met last. Candidates are first held against each other by the parities of
their members' counts in 1024 bins: every bin whose parity differs needs a member that
only one set has, and sets that are 4/5 similar have at most a ninth of both sizes of
these. Pairs that pass, and whose sets fill these bins, are held against each other
in 16384. So this, too, leaves out no pair; the rest have their whole sets compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Named, chunks, compact, ensure_checkpoint_dir, few_ids, join_hot, type_of
from .simhash import components

SHINGLE = 5
#: Similarity as a fraction.
NUM, DEN = 4, 5
#: A shingle of at least COMMON texts of the sample, one text of EACH and SAMPLE at least, comes late in the order; MAX_COMMON of them are known at most.
EACH, SAMPLE, COMMON, MAX_COMMON = 25, 2000, 4, 1_000_000
#: Bins of the parities, first and for pairs that pass; powers of two, at least 64.
BINS, MANY_BINS = 1024, 16384
#: Sets of at least so many members fill BINS.
FULL = 512
#: Parts of a key that a sample shares.
PARTS = 256


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Different hashes of the shingles of a text, ascending; A-Z count as lower case, and a shorter text is one."""
    words = text.encode().lower().split() if text else []
    if len(words) > size:
        grams = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
        return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(42))), ">u8").astype(np.uint64))
    return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and DEN * both >= NUM * (len(a) + len(b) - both)


def held_in(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which members of s are among known, which ascends and may be much longer."""
    return known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s if len(known) else np.zeros(len(s), bool)


def _common(rows: DataFrame, size: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = [shingles(t, size) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["h"])

    share = max(1, min(EACH, rows.count() // SAMPLE))
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
    counts = some.select("id", "text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    top = counts.orderBy(F.col("n").desc(), "h").limit(MAX_COMMON).select("h").toPandas()["h"]
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def _keyed(rows: DataFrame, common: np.ndarray, size: int) -> DataFrame:
    """key, part (of the keys that a sample shares, else 0), id, n (members of the set), left (members from the key on), late (is it such a key)."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                at, keys, n, left, common_ones = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    s = shingles(text, size)
                    if not len(s):
                        continue
                    late = held_in(s, shared.value)
                    first = np.concatenate([s[~late], s[late]])[: len(s) - -(-NUM * len(s) // DEN) + 1]
                    keys.append(first)
                    at.append(np.full(len(first), i))
                    n.append(np.full(len(first), len(s), np.int32))
                    left.append(len(s) - np.arange(len(first), dtype=np.int32))
                    common_ones.append(np.arange(len(first)) >= len(s) - late.sum())
                if keys:
                    columns = [pa.array(np.concatenate(keys).view(np.int64)), part.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(n)), pa.array(np.concatenate(left)), pa.array(np.concatenate(common_ones))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "id", "n", "left", "late"])

    keyed = rows.select("id", "text").mapInArrow(run, f"key long, id {type_of(rows, 'id')}, n int, left int, late boolean")
    return keyed.withColumn("part", F.when(F.col("late"), F.pmod(F.xxhash64("id"), F.lit(PARTS))).otherwise(0).cast("int"))


def parities(s: np.ndarray, bins: int = BINS) -> np.ndarray:
    counts = np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _sketches(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, n, bins (parities) of the texts of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = [shingles(t, size) for t in part.column(1).to_pylist()]
                bins = pa.array([parities(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int32()), bins], ["id", "n", "bins"])

    return rows.join(few_ids(ids), "id", "left_semi").select("id", "text").mapInArrow(run, f"id {type_of(rows, 'id')}, n int, bins array<long>")


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs a, b whose parities allow the similarity."""
    left, right = sketches.toDF("a", "na", "pa"), sketches.toDF("b", "nb", "pb")
    differ = sum((F.bit_count(F.col("pa")[k].bitwiseXOR(F.col("pb")[k])) for k in range(BINS // 64)), F.lit(0))
    return pairs.join(left, "a").join(right, "b").filter(differ * (NUM + DEN) <= (F.col("na") + F.col("nb")) * (DEN - NUM)).select("a", "b").distinct()


def _finer(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs whose parities in MANY_BINS bins allow the similarity; smaller sets than FULL have none and pass."""
    kind = type_of(texts, "id")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = [shingles(t, size) for t in part.column(1).to_pylist()]
                bins = [parities(s, MANY_BINS).tobytes() if len(s) >= FULL else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(bins, pa.binary())], ["id", "n", "bins"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (n, m, x, y) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)):
                if x is None or y is None or int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum()) * (NUM + DEN) <= (n + m) * (DEN - NUM):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).take(pa.array(keep, pa.int64()))

    sketches = texts.select("id", "text").mapInArrow(sketch, f"id {kind}, n int, bins binary").checkpoint()
    rows = pairs.join(sketches.toDF("a", "na", "pa"), "a").join(sketches.toDF("b", "nb", "pb"), "b")
    return compact(rows.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, f"a {kind}, b {kind}").distinct())[0]


def _verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """a, b of pairs that are similar; texts has id, text. An id with several texts is similar by any of them."""
    kind = type_of(texts, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for i, (left, right) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                one = right.as_py()
                if one != last:
                    last, held = one, shingles(one, size)
                if alike(shingles(left.as_py(), size), held):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).take(pa.array(keep, pa.int64()))

    wanted, _ = compact(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    few = texts.join(few_ids(wanted), "id", "left_semi")
    pairs = _finer(pairs, few, size)
    left, right = few.select(F.col("id").alias("a"), F.col("text").alias("ta")), few.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _met(rows: DataFrame, common: np.ndarray, size: int) -> DataFrame:
    """key, id, n, left of keys that different ids have, and the row (id, n, left) of the least and the greatest of these."""
    row, part = F.struct("id", "n", "left"), Window.partitionBy("key", "part")
    held = _keyed(rows, common, size).withColumns({"lo": F.min(row).over(part), "hi": F.max(row).over(part)}).filter("late OR lo.id < hi.id").drop("part").checkpoint()
    late = held.filter("late")
    keys = late.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo.id < hi.id").checkpoint()
    dealt = join_hot(late.drop("lo", "hi"), keys, ["key"], "rows", ["id"]).drop("rows")
    return held.filter("NOT late").unionByName(dealt).drop("late").checkpoint()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, component_id (the smallest id reachable over links) of documents that resemble another; others don't appear.

    Rows with a null id, and texts without words, resemble nothing. Texts of any
    length are read whole; of rows that repeat an id each text may resemble another
    id's. Other columns are not read; an empty table gives an empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    met = _met(rows, _common(rows, shingle), shingle)
    ids, n = compact(met.select("id").distinct())
    if not n:
        return ids.select(F.col("id").alias("doc_id"), F.col("id").alias("component_id"))
    sketches = _sketches(rows, ids, shingle).checkpoint()
    fits = (F.least("n", "m") * DEN >= F.greatest("n", "m") * NUM) & (F.least("left", "mleft") * (NUM + DEN) >= (F.col("n") + F.col("m")) * NUM)
    pair = (F.least("id", "mid").alias("a"), F.greatest("id", "mid").alias("b"))
    own = F.struct("id", "n", "left")
    ends = met.withColumn("r", F.explode(F.array("lo", "hi"))).withColumns({"mid": F.col("r.id"), "m": F.col("r.n"), "mleft": F.col("r.left")})
    pairs, _ = compact(_possible(ends.filter((F.col("id") != F.col("mid")) & fits).select(*pair).distinct(), sketches))
    links, _ = compact(_verified(pairs, rows, shingle))
    found = components(links).checkpoint()
    # a row of an end's id with another text stays
    rest = met.filter((own != F.col("lo")) & (own != F.col("hi"))).select("key", "id", "n", "left")
    rooted = rest.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")).checkpoint()
    roots = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
    unsettled = roots.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("rows", "root")).alias("most")).filter("roots > 1").select("key", F.col("most.root").alias("most"))
    last, n = compact(rooted.join(unsettled, "key"))
    if n:
        others = last.select("key", F.col("id").alias("mid"), F.col("n").alias("m"), F.col("left").alias("mleft"), F.col("root").alias("mroot"))
        apart = (F.col("root") != F.col("mroot")) & ((F.col("mroot") == F.col("most")) | (F.col("id") < F.col("mid")))
        pairs, n = compact(_possible(last.filter("root <> most").join(others, "key").filter(apart & fits).select(*pair).distinct(), sketches))
        if n:
            found = components(links.unionByName(_verified(pairs, rows, shingle)))
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs without those that resemble a document of smaller id in their component, with all their columns, of any names."""
    named = Named(docs)
    gone = similar_groups(named.rows, named.at(id_col), named.at(text_col), shingle).filter("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct().checkpoint()
    return named.back(named.rows.join(few_ids(gone), F.col(named.at(id_col)) == F.col("__id"), "left_anti"))
