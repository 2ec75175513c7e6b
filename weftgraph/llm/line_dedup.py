"""Line deduplication over levelled sorted runs of line hashes (DataFrame operations only).

A line's key is the line without white space at both ends and with A-Z lower
cased; keys of at least `min_chars` code points count, by a 128-bit hash. One pass
over the texts writes a row for each such line: document, position, hash.

Documents come in batches by descending id. A batch is aggregated to a sorted
run: key, number of documents, largest id. Each new batch is merged by an
anti-join with the runs so far: keys in none of them are new, and since ids
descend their largest id in this batch is the largest of the corpus, the
document that keeps the line; keys that a run holds only add to its count. The
batch's own run is then added at level 0; `fan` runs of a level are compacted
into one of the next (counts add up, the one keeper stays). Compacted runs are
checkpoints in the shared folder, so a lost executor costs no recomputation.

After the last batch all runs are compacted; keys in at least `min_docs`
documents meet the lines in a join. The keys that have over one of `share` parts of
all lines (so fewer than `share` keys) carry a salt there, as many as they have
such parts. What meets is the positions to drop. Texts are shuffled once, split, to
lose these positions; each step is linear in the number of lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHARE, ensure_checkpoint_dir, join_hot, sample_ids

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCHES, FAN = 4, 2
CUT_SAMPLE = 1000
HASH = ["h1", "h2"]


def line_key(bare: Column) -> Column:
    # lower() changes letters beyond A-Z; a line of single-byte characters has none
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, mark, pos, and the hash of each line that counts; rows has doc_id, mark and text."""
    each = rows.select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    bare = each.select("doc_id", "mark", "pos", F.btrim("line", F.lit(BLANK)).alias("bare")).filter(F.length("bare") >= min_chars)
    key = line_key(F.col("bare"))
    return bare.select("doc_id", "mark", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def _compact(runs: list[DataFrame]) -> DataFrame:
    both = reduce(DataFrame.unionByName, runs)
    return both.groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("keep_id").alias("keep_id"))


def common_lines(lines: DataFrame, min_docs: int = 5, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """h1, h2, n_docs (different ids; null is one), keep_id of the keys in at least min_docs documents; lines has doc_id, h1, h2 and is a checkpoint."""
    # cuts only shape the batches: at quantiles of a sample of ids, of any type that sorts
    some = [r[0] for r in sample_ids(lines.filter(F.col("doc_id").isNotNull()), "doc_id", CUT_SAMPLE).orderBy(F.desc("doc_id")).collect()]
    cuts = [some[len(some) * (i + 1) // batches] for i in range(batches - 1)] if some else []
    batch = reduce(lambda n, cut: n + F.when(F.col("doc_id") >= cut, 0).otherwise(1), cuts, F.lit(0))
    runs = (
        lines.select("doc_id", *HASH)
        .distinct()
        .withColumn("batch", F.coalesce(batch, F.lit(batches - 1)))
        .groupBy("batch", *HASH)
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep_id"))
        .checkpoint()
    )
    levels: list[list[DataFrame]] = [[]]
    for b in range(batches):
        own = runs.filter(F.col("batch") == b).drop("batch")
        held = [r for level in levels for r in level]
        if held:
            fresh = reduce(lambda d, r: d.join(r.select(*HASH), HASH, "left_anti"), held, own)
            seen = own.join(reduce(DataFrame.unionByName, [r.select(*HASH) for r in held]), HASH, "left_semi")
            own = fresh.unionByName(seen.withColumn("keep_id", F.lit(None).cast(own.schema["keep_id"].dataType)))
        levels[0].append(own)
        k = 0
        while len(levels[k]) >= fan:
            if k + 1 == len(levels):
                levels.append([])
            levels[k + 1].append(_compact(levels[k]).checkpoint())
            levels[k] = []
            k += 1
    left = [r for level in levels for r in level]
    whole = left[0] if len(left) == 1 else _compact(left)
    return whole.filter(F.col("n_docs") >= min_docs)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES, fan: int = FAN, share: int = SHARE) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text: the texts without lines that other documents keep; one row per row of docs.

    A key found in at least min_docs documents loses all its lines except in
    the document of the largest id holding it. Null or empty text is one empty
    line. Documents are told apart by id: rows that repeat an id are one document
    when documents are counted, each loses its own lines, and all of them keep the
    lines of which their id is the keeper. Rows with a null id are together one
    document, which keeps a line only if no other holds it. A document may have any
    number of lines. Other columns are not read. An empty table gives an empty
    result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # rows of one id are told apart by their text; equal ones lose the same lines
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    lines = _lines(rows, min_chars).checkpoint()
    common = common_lines(lines, min_docs, batches, fan).checkpoint()
    drops = (
        join_hot(lines, common, HASH, "n_docs", ["doc_id", "mark"], share)
        .filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy(F.col("doc_id").alias("drop_id"), F.col("mark").alias("drop_mark"))
        .agg(F.collect_set("pos").alias("drops"))
    )
    # split before the join: behind it, the array is a column and no expression that each look-up would evaluate again
    split = rows.select("doc_id", "mark", F.split("text", "\n").alias("lines"))
    joined = split.join(drops, split["doc_id"].eqNullSafe(drops["drop_id"]) & (split["mark"] == drops["drop_mark"]), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get(F.col("lines"), i)))
    n_lines = F.size("lines").cast("long")
    return joined.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"))
