"""Upkeep of the call graph's tables: upsert, invalidation, stub resolution, staleness, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EDGE_KEY, is_stub, stub_name


def first_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def upsert(symbols: DataFrame, edges: DataFrame, new_symbols: DataFrame, new_edges: DataFrame, paths: DataFrame, relink: bool = False) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges after the files in paths (column path) were extracted anew.

    Edges that leave the files' old symbols go; edges that enter go only where
    their target is gone. As ids hold lines, a shifted symbol is another one;
    with relink, edges to it follow a symbol of the same file and name.
    """
    old = symbols.join(paths.select("path"), "path", "left_semi")
    kept_symbols = symbols.join(paths.select("path"), "path", "left_anti").unionByName(new_symbols)
    own = edges.join(old.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    gone = old.join(new_symbols.select("id"), "id", "left_anti")
    if relink:
        now = first_of(new_symbols.select("path", "name", F.col("id").alias("__new")), ["path", "name"], F.col("__new"))
        moved = gone.join(now, ["path", "name"]).select(F.col("id").alias("target_id"), "__new")
        own = own.join(moved, "target_id", "left").withColumn("target_id", F.coalesce("__new", "target_id")).drop("__new").select(*edges.columns)
    own = own.join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return kept_symbols, own.select(*edges.columns).unionByName(new_edges.select(*edges.columns)).dropDuplicates(EDGE_KEY)


def invalidate(symbols: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the symbols of the files in paths and every edge that touches them."""
    gone = symbols.join(paths.select("path"), "path", "left_semi").select("id")
    left = edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return symbols.join(paths.select("path"), "path", "left_anti"), left.select(*edges.columns)


def stub_candidates(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Each stub edge with its best symbol, resolved_id: of the caller's language and the stub's name, the one with
    the most leading directories in common, then exported, then indexed last, then of least id.

    Every definition stands in each directory above it, of which the best definition of a name is kept; callers take it from
    the deepest of their directories that has one. So a name that many files define costs a row for each of its directories,
    and not one for each definition and caller.
    """
    stubs = edges.filter(is_stub(F.col("target_id"))).withColumn("name", stub_name(F.col("target_id")))
    sources = symbols.select(F.col("id").alias("source_id"), "lang", _directories(F.col("path")).alias("__dirs"))
    rank = F.struct(~F.coalesce("is_exported", F.lit(False)), -F.coalesce("indexed_at", F.lit(0)), F.col("id"))
    above = symbols.select("name", "lang", F.posexplode(_directories(F.col("path"))).alias("__level", "__dir"), F.col("id"), rank.alias("__rank"))
    best = above.groupBy("name", "lang", "__level", "__dir").agg(F.min_by("id", "__rank").alias("resolved_id"))
    asked = stubs.join(sources, "source_id")
    # callers of one directory share their best symbol
    wanted = asked.select("name", "lang", "__dirs").distinct().withColumn("__own", F.col("__dirs"))
    tried = wanted.select("name", "lang", "__own", F.posexplode("__dirs").alias("__level", "__dir")).join(best, ["name", "lang", "__level", "__dir"])
    found = tried.groupBy("name", "lang", "__own").agg(F.max_by("resolved_id", "__level").alias("resolved_id")).withColumnRenamed("__own", "__dirs")
    return asked.join(found, ["name", "lang", "__dirs"], "left").select(*edges.columns, "resolved_id")


def _directories(path: Column) -> Column:
    """Directories above a path by level: none, the first part, and so on down to its own."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def resolve_stubs(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with stubs replaced by their best symbol; stubs without one are left out; an edge that exists already stays single."""
    real = edges.filter(~is_stub(F.col("target_id"))).withColumn("__rank", F.lit(0))
    found = stub_candidates(symbols, edges).filter(F.col("resolved_id").isNotNull()).withColumn("target_id", F.col("resolved_id")).withColumn("__rank", F.lit(1)).drop("resolved_id")
    return first_of(real.unionByName(found), EDGE_KEY, F.col("__rank"), F.col("source_line")).drop("__rank")


def resolution_counts(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """before, resolved (stubs with a candidate, repeats of real edges too), deleted."""
    stubs = edges.filter(is_stub(F.col("target_id")))
    found = stub_candidates(symbols, edges).filter(F.col("resolved_id").isNotNull())
    return stubs.agg(F.count(F.lit(1)).alias("before")).crossJoin(found.agg(F.count(F.lit(1)).alias("resolved"))).withColumn("deleted", F.col("before") - F.col("resolved"))


def unresolved(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Stubs without a candidate, to be tried again when definitions come."""
    return stub_candidates(symbols, edges).filter(F.col("resolved_id").isNull()).drop("resolved_id")


def mark_cycles(edges: DataFrame, cyclic: DataFrame, sources: DataFrame) -> DataFrame:
    """is_cyclic set for the pairs in cyclic (source_id, target_id), whatever the relation; other edges of sources (source_id) are reset."""
    pairs = cyclic.select("source_id", "target_id").distinct().withColumn("__c", F.lit(True))
    again = sources.select("source_id").distinct().withColumn("__r", F.lit(True))
    flag = F.when(F.col("__c"), True).when(F.col("__r"), False).otherwise(F.col("is_cyclic"))
    return edges.join(pairs, ["source_id", "target_id"], "left").join(again, "source_id", "left").withColumn("is_cyclic", flag).select(*edges.columns)


def changed_files(listing: DataFrame, files: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
    """path of listed files (path, lang, mtime) that aren't indexed as they are now, or were before their language's rules changed (lang, cutoff)."""
    known = files.select("path", "last_modified", "indexed_at")
    rows = listing.join(known, "path", "left")
    limit = F.lit(0).cast("long")
    if cutoffs is not None:
        rows = rows.join(cutoffs, "lang", "left")
        limit = F.coalesce("cutoff", F.lit(0))
    fresh = (F.col("last_modified") >= F.col("mtime")) & (F.col("indexed_at") >= limit)
    return rows.filter(~F.coalesce(fresh, F.lit(False))).select("path")


def file_record(files: DataFrame, path: str) -> DataFrame:
    """The record of one file, or no row."""
    return files.filter(F.col("path") == path)


def stale(hashes: DataFrame, now: DataFrame) -> DataFrame:
    """path, state (stale or missing) of indexed files (path, mtime, size) that differ from now, or aren't there."""
    rows = hashes.select("path", "mtime", "size").join(now.select("path", F.col("mtime").alias("__m"), F.col("size").alias("__s")), "path", "left")
    state = F.when(F.col("__m").isNull(), "missing").when((F.col("mtime") != F.col("__m")) | (F.col("size") != F.col("__s")), "stale")
    return rows.withColumn("state", state).filter("state IS NOT NULL").select("path", "state")


def validate_index(hashes: DataFrame, now: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """One row: total, stale, missing, and valid if at most that share of files differs."""
    bad = stale(hashes, now).agg(F.count_if(F.col("state") == "stale").alias("stale"), F.count_if(F.col("state") == "missing").alias("missing"))
    return hashes.agg(F.count(F.lit(1)).alias("total")).crossJoin(bad).withColumn("valid", F.col("stale") + F.col("missing") <= tolerance * F.col("total"))


def evicted(files: DataFrame, n: int) -> DataFrame:
    """path of the n files that were indexed first."""
    return files.orderBy("indexed_at", "path").limit(n).select("path")


def eviction_size(n_files: int, size_mb: float, limit_mb: float = 256, share: float = 0.1) -> int:
    """How many files to evict: none up to the limit, else a tenth, at least one."""
    return 0 if size_mb <= limit_mb or not n_files else max(1, -int(-n_files * share // 1))


def dependants(deps: DataFrame, deleted: DataFrame) -> DataFrame:
    """path of files whose dependencies point to a deleted one (column path)."""
    return deps.join(deleted.select(F.col("path").alias("target")), "target", "left_semi").select(F.col("source").alias("path")).distinct()
