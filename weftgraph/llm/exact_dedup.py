"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame operations only).

Every row gets a 64-bit digest (the sort key of a run) and the SHA-256 of its
text (the verification: a merge unites entries only if both agree), a checkpoint
that all later steps read. Rows are dealt to runs by the hash of their id. A run holds one entry for each
text: the id that stays and the number of rows. Then runs exchange entries in
rounds: in a round, the runs whose numbers agree above the next `bits` bits
merge, which is `bits` rounds of a binomial tree done as one multiway merge;
log2(runs) / bits rounds leave one run. The buffer of the merge is a struct,
so Spark executes it as a sort-based aggregate: entries are sorted by digest
before and after the exchange.

Entries travel back by way of the first level: a group of copies has at most
one entry in each run there, so the final join has keys (run, digest), over
which even a text that a third of all rows hold spreads evenly. Texts are never
shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Named, ensure_checkpoint_dir

#: At least 2 ** RUNS_LOG2 runs, and so many that one has about RUN_ROWS rows.
RUNS_LOG2, RUN_ROWS = 6, 1 << 20
BITS = 3
KEY = ["run", "digest", "text_sha256"]


def _entries(rows: DataFrame, id_col: str, text_col: str, least_log2: int | None) -> tuple[DataFrame, int]:
    """doc_id, digest, text_sha256 (binary) and run of each row, from one pass over the texts; the number of runs as a power of 2."""
    ensure_checkpoint_dir(rows.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    entries = rows.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), F.unhex(F.sha2(text, 256)).alias("text_sha256")).checkpoint()
    runs_log2 = max(RUNS_LOG2, (entries.count() // RUN_ROWS).bit_length()) if least_log2 is None else least_log2
    run = F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id"), 64 - runs_log2) if runs_log2 else F.lit(0).cast("long")
    return entries.withColumn("run", run), runs_log2


def _merge(level: DataFrame, keep: str) -> DataFrame:
    pick = F.max if keep == "largest" else F.min
    return level.groupBy(*KEY).agg(pick("best").alias("best"), F.sum("size").alias("size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", runs_log2: int | None = None, bits: int = BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. keep: of equal texts
    the row with the "largest" or "smallest" id stays. A null id never wins
    against another id. Rows that repeat both id and text are one group; one of
    them is kept. Other columns of docs are not read, so their names can't
    clash; an empty table gives an empty result. runs_log2: the number of runs, which
    otherwise grows with the rows.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    rows, runs_log2 = _entries(docs, id_col, text_col, runs_log2)
    absent = F.col("doc_id").isNull()
    best = F.struct((~absent if keep == "largest" else absent).alias("rank"), F.col("doc_id").alias("id"))
    first = _merge(rows.withColumns({"best": best, "size": F.lit(1).cast("long")}), keep)
    level, left = first, runs_log2
    while left > 0:
        step = min(bits, left)
        left -= step
        level = _merge(level.withColumn("run", F.shiftright("run", step)), keep)
    whole = level.select("digest", "text_sha256", F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"))
    by_run = first.select(*KEY).join(whole, ["digest", "text_sha256"])
    again = Window.partitionBy(*KEY, "doc_id").orderBy("doc_id")
    return (
        rows.join(by_run, KEY)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(again) == 1))
        .select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_sha256")).alias("text_sha256"))
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, with all their columns; rows that repeat id and text leave one.

    Ids name the rows that stay, so a row goes when another row of its text has
    the id that is kept. Texts are shuffled once, by id.
    """
    named = Named(docs)
    id_col, text_col = named.at(id_col), named.at(text_col)
    key = lambda sha, i: F.concat(F.unhex(sha), F.encode(F.coalesce(F.col(i).cast("string"), F.lit("null")), "utf-8")).alias("key")
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    marks = exact_dedup(named.rows, id_col, text_col, keep).filter("kept").select(key(F.col("text_sha256"), "doc_id"))
    rows = named.rows.withColumn("key", key(sha, id_col)).join(marks, "key", "left_semi")
    # the join has sorted by key, so the window adds no exchange and no sort
    again = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return named.back(rows.withColumn("again", again).filter("again = 1"))
