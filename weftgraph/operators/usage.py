"""Reverse look-up, callers, usage of imports, and dead exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import in_ignored_directory, is_source_file
from ..plans.runtime import settled, unguessed
from ..sources.imports import extract_imports
from .store import first_of


def one_per_pair(deps: DataFrame) -> DataFrame:
    """Of a source's dependencies on one target, the last by line and module."""
    return first_of(deps, ["source", "target"], F.col("line").desc(), F.col("module").desc())


def referencing_files(deps: DataFrame, targets: DataFrame) -> DataFrame:
    """target, source, type, line, module of what refers to targets (column path)."""
    wanted = deps.join(unguessed(targets.select(F.col("path").alias("target"))), "target", "left_semi")
    return one_per_pair(wanted).select("target", "source", "type", "line", "module")


def caller_counts(deps: DataFrame) -> DataFrame:
    """target, n_callers: different sources."""
    return deps.filter(F.col("target").isNotNull()).select("source", "target").distinct().groupBy("target").agg(F.count(F.lit(1)).alias("n_callers"))


def index_stats(deps: DataFrame) -> DataFrame:
    """indexed_files (with a dependency), target_files, total_references (pairs)."""
    pairs = deps.filter(F.col("target").isNotNull()).select("source", "target").distinct()
    return pairs.agg(F.count_distinct("source").alias("indexed_files"), F.count_distinct("target").alias("target_files"), F.count(F.lit(1)).alias("total_references"))


def lookup(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """References of a partial index completed by a scan; where both have a pair the index wins."""
    both = primary.withColumn("__p", F.lit(0)).unionByName(fallback.withColumn("__p", F.lit(1)))
    return first_of(both, ["target", "source"], F.col("__p"), F.col("line"), F.col("module")).drop("__p")


def replaced(deps: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """deps with those of sources (column path) replaced by fresh ones, one for each source and target, the last by line and module."""
    kept = deps.join(sources.select(F.col("path").alias("source")), "source", "left_anti").select(*deps.columns)
    return kept.unionByName(one_per_pair(fresh).select(*deps.columns))


WORD = r"[\w$]+"


def scan_candidates(files: DataFrame, targets: DataFrame) -> DataFrame:
    """path, target of files whose text holds the target's base name without extension, to be analysed.

    Texts are cut into words once, which meet the longest word of each name; names
    of several words (a-b) are then looked for whole.
    """
    base = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    names = targets.select(F.col("path").alias("target"), base.alias("__name")).distinct()
    longest = F.array_sort(F.regexp_extract_all("__name", F.lit(f"({WORD})"), 1), lambda a, b: F.coalesce(F.length(b) - F.length(a), F.lit(0)))
    names = names.withColumn("__word", F.coalesce(F.get(longest, F.lit(0)), F.lit("")))
    held = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1))).alias("__word"))
    found = held.join(unguessed(names), "__word").filter(F.col("path") != F.col("target"))
    whole = found.filter(F.col("__name") == F.col("__word")).select("path", "target")
    parts = found.filter(F.col("__name") != F.col("__word")).join(unguessed(files.select("path", "text")), "path").filter(F.col("text").contains(F.col("__name"))).select("path", "target")
    return whole.unionByName(parts)


def scan_references(files: DataFrame, targets: DataFrame, resolve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """target, source, type, line, module of what refers to targets (column path), from the texts of files (path, lang, text) without an index.

    Only candidates are analysed. resolve: from imports (source, module) to targets (source, module, target).
    """
    asked = settled(files.join(unguessed(scan_candidates(files, targets).select("path").distinct()), "path", "left_semi"))
    found = settled(extract_imports(asked).filter("error IS NULL"))
    deps = found.select("source", "module", "type", "line").join(unguessed(resolve(found.select("source", "module"))), ["source", "module"])
    return referencing_files(deps, targets)


def symbol_callers(deps: DataFrame, mode: str = "all") -> DataFrame:
    """target_symbol_id, source_symbol_id, is_type_only, one row a pair (the last by line); mode: all, runtime or type-only."""
    if mode not in ("all", "runtime", "type-only"):
        raise ValueError("mode is all, runtime or type-only")
    rows = first_of(deps, ["target_symbol_id", "source_symbol_id"], F.col("line").desc(), F.col("is_type_only"))
    if mode != "all":
        rows = rows.filter(F.coalesce("is_type_only", F.lit(False)) == (mode == "type-only"))
    return rows.select("target_symbol_id", "source_symbol_id", "is_type_only")


def symbol_stats(deps: DataFrame) -> DataFrame:
    """target_symbols, caller_symbols, total_references, caller_files."""
    pairs = deps.select("target_symbol_id", "source_symbol_id", "source_path").distinct()
    return pairs.agg(
        F.count_distinct("target_symbol_id").alias("target_symbols"), F.count_distinct("source_symbol_id").alias("caller_symbols"),
        F.count_distinct("target_symbol_id", "source_symbol_id").alias("total_references"), F.count_distinct("source_path").alias("caller_files"),
    )


def symbol_dependents(deps: DataFrame, path: str, name: str) -> DataFrame:
    """source_symbol_id, source_path of what other files refer to the symbol with."""
    return deps.filter((F.col("target_symbol_id") == f"{path}:{name}") & (F.col("source_path") != path)).select("source_symbol_id", "source_path").distinct()


def external_callers(symbols: DataFrame, edges: DataFrame, path: str | None = None, names: list[str] | None = None, limit: int | None = 50) -> DataFrame:
    """caller_name, caller_path, caller_start_line, target_name: callers in other files of symbols that aren't methods, by target name and caller path."""
    targets = symbols.filter("type <> 'method'")
    if path is not None:
        targets = targets.filter(F.col("path") == path)
    if names is not None:
        targets = targets.filter(F.col("name").isin(*names))
    targets = targets.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("path").alias("__path"))
    sources = symbols.select(F.col("id").alias("source_id"), F.col("name").alias("caller_name"), F.col("path").alias("caller_path"), F.col("start_line").alias("caller_start_line"))
    found = edges.join(targets, "target_id").join(sources, "source_id").filter("caller_path <> __path").select("caller_name", "caller_path", "caller_start_line", "target_name")
    return found if limit is None else found.orderBy("target_name", "caller_path", "caller_name", "caller_start_line").limit(limit)


def incoming(deps: DataFrame, calls: DataFrame, path: str) -> DataFrame:
    """source_symbol_id, target_symbol_id, origin: dependencies that enter a file, and calls (same ids) that aren't among them."""
    own = deps.filter((F.col("target_path") == path) & (F.col("source_path") != path)).select("source_symbol_id", "target_symbol_id").distinct().withColumn("origin", F.lit("symbols"))
    more = calls.filter((F.col("target_path") == path) & (F.col("source_path") != path)).select("source_symbol_id", "target_symbol_id").distinct()
    return own.unionByName(more.join(own, ["source_symbol_id", "target_symbol_id"], "left_anti").withColumn("origin", F.lit("calls")))


def used_exports(symbols: DataFrame, deps: DataFrame, export_graph: DataFrame) -> DataFrame:
    """id of exported symbols that another file uses, and those they mention, and so on.

    symbols: id, path, is_exported; deps: source_path, target_symbol_id, target_path; export_graph: src mentions dst.
    """
    from .traverse import reach

    exported = symbols.filter("is_exported").select("id")
    direct = deps.filter("source_path <> target_path").select(F.col("target_symbol_id").alias("id")).distinct().join(exported, "id", "left_semi")
    inner = export_graph.select("src", "dst").join(exported.withColumnRenamed("id", "src"), "src", "left_semi").join(exported.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return reach(settled(inner), direct.withColumnRenamed("id", "node")).select(F.col("node").alias("id"))


def unused_exports(symbols: DataFrame, deps: DataFrame, export_graph: DataFrame) -> DataFrame:
    """Exported symbols that nothing outside their file reaches."""
    return symbols.filter("is_exported").join(used_exports(symbols, deps, export_graph), "id", "left_anti")


def dead_code(symbols: DataFrame, deps: DataFrame, export_graph: DataFrame, max_files: int | None = 500) -> DataFrame:
    """path, n_unused, n_exported of the files with unused exports, among the first max_files source files by path."""
    sources = symbols.filter(is_source_file(F.col("path")))
    if max_files is not None:
        sources = sources.join(sources.select("path").distinct().orderBy("path").limit(max_files), "path", "left_semi")
    unused = unused_exports(sources, deps, export_graph).groupBy("path").agg(F.count(F.lit(1)).alias("n_unused"))
    return unused.join(sources.filter("is_exported").groupBy("path").agg(F.count(F.lit(1)).alias("n_exported")), "path")


def edge_usage(pairs: DataFrame, deps: DataFrame, analysed: DataFrame) -> DataFrame:
    """source, target, is_used of import edges.

    Used: a target in an ignored directory; a source without symbol analysis (not
    .ts, .tsx, .mts, .cts, .js, .jsx, .mjs, .cjs, .py, .pyi, .rs or .swift, or not in `analysed`, column path);
    else a symbol dependency (source_path, target_path) from source to target.
    """
    real = deps.select(F.col("source_path").alias("source"), F.col("target_path").alias("target")).distinct().withColumn("__d", F.lit(True))
    known = analysed.select(F.col("path").alias("source")).distinct().withColumn("__k", F.lit(True))
    supported = F.col("source").rlike(r"\.([mc]?[tj]s|[tj]sx|pyi?|rs|swift)$")
    used = F.col("__d").isNotNull() | in_ignored_directory(F.col("target")) | ~supported | F.col("__k").isNull()
    return pairs.select("source", "target").distinct().join(real, ["source", "target"], "left").join(known, "source", "left").select("source", "target", used.alias("is_used"))


def over_cap(pairs: DataFrame, cap: int) -> bool:
    """Whether unused_edges leaves its result empty because of the cap."""
    return bool(cap) and pairs.select("source", "target").distinct().limit(cap + 1).count() > cap


def unused_edges(pairs: DataFrame, deps: DataFrame, analysed: DataFrame, cap: int = 0) -> DataFrame:
    """source, target of edges that aren't used; none if a cap above 0 is exceeded by the number of edges, as over_cap() tells."""
    pairs = pairs.select("source", "target").distinct()
    if over_cap(pairs, cap):
        return pairs.limit(0)
    return edge_usage(pairs, deps, analysed).filter("NOT is_used").select("source", "target")


def with_parent_counts(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """nodes (column path) with parent_count, null where nothing refers to them."""
    return nodes.join(caller_counts(deps).select(F.col("target").alias("path"), F.col("n_callers").alias("parent_count")), "path", "left")


def call_order(edges: DataFrame) -> DataFrame:
    """source_id, target_id, call_order of CALLS edges from 1 by line; equal lines by target."""
    w = Window.partitionBy("source_id").orderBy("source_line", "target_id")
    return edges.filter("type_relation = 'CALLS'").select("source_id", "target_id", F.row_number().over(w).alias("call_order"))


def match_targets(deps: DataFrame, targets: DataFrame) -> DataFrame:
    """deps with target_path replaced by the file it resolves to (source, module, target), where it isn't a file's normal path itself."""
    from ..functions.paths import normalize

    found = targets.select(F.col("source").alias("source_path"), F.col("module").alias("target_path"), F.col("target").alias("__t"))
    return deps.join(found, ["source_path", "target_path"], "left").withColumn("target_path", F.coalesce("__t", normalize(F.col("target_path")))).select(*deps.columns)
