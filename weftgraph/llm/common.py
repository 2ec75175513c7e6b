"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import ensure_checkpoint_dir as ensure_checkpoint_dir

#: A worker takes texts in slices of about this many bytes, so its memory doesn't follow the Arrow batch.
CHUNK_BYTES = 1_000_000
#: Words or pieces that a worker keeps together have at most about so many characters.
VOCAB_CHARS = 16_000_000
#: join_hot deals out keys with over one of SHARE parts of all rows.
SHARE = 1024
#: Rows of ids and numbers that a partition holds easily.
PART_ROWS = 250_000
#: So many ids are broadcast at most.
MAX_BROADCAST = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str | Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo folds, is fold. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % folds == fold, F.lit(False))


def type_of(rows: DataFrame, column: str) -> str:
    """The column's type, as a schema names it."""
    return rows.select(F.col(column)).schema[0].dataType.simpleString()


def chunks(batch: pa.RecordBatch, column: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text in the column; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        yield batch.slice(a, b - a)
        a = b


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat indices of the slices [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Vocab(dict):
    """Numbers its keys in order of first look-up; size: their length together."""

    def __init__(self):
        self.size = 0

    def __missing__(self, key):
        n = self[key] = len(self)
        self.size += len(key)
        return n

    def full(self, keys: int, size: int) -> bool:
        return len(self) > keys or self.size > size

    def numbers(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


class Named:
    """rows: a table under names of its own, so none can clash; back(): its columns under theirs again."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.rows = docs.toDF(*(f"_c{k}" for k in range(len(self.names))))

    def at(self, name: str) -> str:
        return f"_c{self.names.index(name)}"

    def back(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.rows.columns).toDF(*self.names)


def sample_ids(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most n ids, those of least hash: the same for any order or partitioning of the rows."""
    return rows.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(n)


def sample_near(marks: DataFrame, id_col: str, label_col: str, n: Column) -> DataFrame:
    """marks with __at, the hash of the id, of about 1.25 n ids of each label, those of least hash; marks has each id once.

    A label's rows are counted, and a range of hashes is taken that holds so many;
    so nothing is sorted, and no task sees a whole label. Only the labels, which a
    model holds, are broadcast.
    """
    counts = marks.groupBy(label_col).agg(F.count(F.lit(1)).alias("__count"))
    at = F.pmod(F.xxhash64(id_col), F.lit(1 << 31))
    rows = marks.join(F.broadcast(counts), label_col).withColumn("__at", at)
    return rows.filter(F.col("__at") * F.col("__count") < n.cast("double") * 1.25 * (1 << 31)).drop("__count")


def compact(rows: DataFrame) -> tuple[DataFrame, int]:
    """A checkpoint of the rows in no more partitions than their number asks for, and their number."""
    held = rows.checkpoint()
    n = held.count()
    return held.coalesce(-(-n // PART_ROWS) or 1), n


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, by: list[str], share: int = SHARE) -> DataFrame:
    """rows joined with their groups, one row for each key; groups is a checkpoint and says in size how many rows a key has.

    Keys with over one of share parts of all rows, of which there are fewer than
    share, are dealt out by the columns `by`, their group being repeated.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(groups.filter(F.col(size) * share > total).select(*keys, (F.col(size) * share / (total or 1)).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(0))
    salted = groups.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts))).drop("__salts")
    dealt = rows.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(F.lit(3), *by), salts + 1).cast("int")).drop("__salts")
    return dealt.join(salted, [*keys, "__salt"]).drop("__salt")


def few_ids(ids: DataFrame) -> DataFrame:
    """ids, broadcast if they are few; ids must be a checkpoint, as they are counted."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids
