"""Shapes of graphs for display: compounds, merges, filters, clusters, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import file_name, name_of_symbol, path_of_symbol
from .store import first_of

LINES = 64


def compounds(symbols: DataFrame) -> DataFrame:
    """id, label, level, parent of the folders and files of symbols."""
    folders = symbols.select(F.col("folder").alias("id")).distinct().select("id", F.col("id").alias("label"), F.lit("folder").alias("level"), F.lit(None).cast("string").alias("parent"))
    files = symbols.select("path", "folder").distinct().select(F.col("path").alias("id"), file_name(F.col("path")).alias("label"), F.lit("file").alias("level"), F.col("folder").alias("parent"))
    return folders.unionByName(files)


def symbols_at(symbols: DataFrame, cursors: DataFrame) -> DataFrame:
    """path, line, id: the symbol around each cursor (path, line) that starts last, else the file's first one.

    A range join: both sides are cut into blocks of LINES lines and meet by block.
    """
    spans = symbols.select("path", "id", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / LINES), F.floor(F.greatest("start_line", "end_line") / LINES))).alias("block"))
    asked = cursors.select("path", "line").distinct()
    inside = asked.withColumn("block", F.floor(F.col("line") / LINES)).join(spans, ["path", "block"]).filter("line BETWEEN start_line AND end_line")
    best = first_of(inside, ["path", "line"], F.col("start_line").desc(), F.col("id")).select("path", "line", F.col("id").alias("__in"))
    first = symbols.groupBy("path").agg(F.min_by("id", F.struct("start_line", "id")).alias("__first"))
    return asked.join(best, ["path", "line"], "left").join(first, "path").select("path", "line", F.coalesce("__in", "__first").alias("id"))


def merge_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges of both, once each."""
    return left.unionByName(right).distinct()


def merge_nodes(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Nodes of both; the right one's columns win."""
    return first_of(left.withColumn("__p", F.lit(1)).unionByName(right.withColumn("__p", F.lit(0))), [key], F.col("__p")).drop("__p")


def filter_to(edges: DataFrame, files: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Edges (source, target) with both ends among files (column path) or current. No files at all: no filter, if they are None; an empty table filters everything."""
    keep = files.select("path") if current is None else files.select("path").unionByName(current.select("path"))
    keep = keep.distinct()
    return edges.join(keep.withColumnRenamed("path", "source"), "source", "left_semi").join(keep.withColumnRenamed("path", "target"), "target", "left_semi").select(*edges.columns)


def caller_files(deps: DataFrame, symbol_id: str) -> DataFrame:
    """path of the files that refer to a symbol."""
    return deps.filter(F.col("target_symbol_id") == symbol_id).select(F.col("source_path").alias("path")).distinct()


def expand_all(edges: DataFrame, current: str) -> DataFrame:
    """node of every edge's source, and the current file."""
    return edges.select(F.col("source").alias("node")).unionByName(edges.sparkSession.createDataFrame([(current,)], "node string")).distinct()


def shown(symbols: DataFrame, edges: DataFrame, types: list[str] | None = None, hidden_folders: list[str] | None = None, hidden_directions: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges (with direction) after the legend's filters.

    A hidden folder hides all below it. Outgoing and incoming hide CALLS only,
    lateral hides every relation. Edges need both ends shown.
    """
    nodes = symbols if types is None else symbols.filter(F.col("type").isin(*types))
    for f in hidden_folders or ():
        nodes = nodes.filter((F.col("folder") != f) & ~F.col("folder").startswith(f.rstrip("/") + "/"))
    hidden = hidden_directions or []
    off = F.col("direction").isin(*hidden) & ((F.col("direction") == "lateral") | (F.col("type_relation") == "CALLS")) if hidden else F.lit(False)
    ids = nodes.select("id")
    kept = edges.filter(~off).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return nodes, kept.select(*edges.columns)


def add_referencing(nodes: DataFrame, edges: DataFrame, references: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (path, label) and edges with the files that refer to target (column source) added, but not itself."""
    new = references.filter(F.col("source") != target).select("source").distinct()
    more = new.select(F.col("source").alias("path"), file_name(F.col("source")).alias("label")).join(nodes, "path", "left_anti")
    return nodes.select("path", "label").unionByName(more), merge_edges(edges.select("source", "target"), new.withColumn("target", F.lit(target)))


def unused_shown(edges: DataFrame, unused: DataFrame, mode: str = "dim") -> DataFrame:
    """Edges with a flag is_unused (dim), or without the unused ones (hide)."""
    if mode == "hide":
        return edges.join(unused.select("source", "target"), ["source", "target"], "left_anti")
    flags = unused.select("source", "target", F.lit(True).alias("__u")).distinct()
    return edges.join(flags, ["source", "target"], "left").withColumn("is_unused", F.coalesce("__u", F.lit(False))).drop("__u")


def clusters(file_symbols: DataFrame) -> DataFrame:
    """id, type, symbol_ids, child_ids: a namespace for each file, a class for each class symbol with members.

    file_symbols: id, path, name, category, parent_symbol_id.
    """
    members = file_symbols.filter("parent_symbol_id IS NOT NULL").groupBy(F.col("parent_symbol_id").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("symbol_ids"))
    classes = file_symbols.filter("category = 'class'").select("id", "path", "name").join(members, "id")
    of_class = classes.select(F.concat_ws(":", "path", "name").alias("id"), F.lit("class").alias("type"), "symbol_ids", F.array().cast("array<string>").alias("child_ids"), "path")
    top = file_symbols.filter("parent_symbol_id IS NULL").groupBy("path").agg(F.array_sort(F.collect_list("id")).alias("symbol_ids"))
    children = of_class.groupBy("path").agg(F.array_sort(F.collect_list("id")).alias("child_ids"))
    of_file = top.join(children, "path", "left").select(F.col("path").alias("id"), F.lit("namespace").alias("type"), "symbol_ids", F.coalesce("child_ids", F.array().cast("array<string>")).alias("child_ids"))
    return of_file.unionByName(of_class.drop("path"))


def visible_symbols(clustered: DataFrame, open_ids: DataFrame) -> DataFrame:
    """id of the symbols in open clusters (column id)."""
    return clustered.join(open_ids.select("id"), "id", "left_semi").select(F.explode("symbol_ids").alias("id")).distinct()


def symbol_payload(file_symbols: DataFrame, deps: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a file's symbol graph: the file to its top symbols, parents to members, dependencies; targets elsewhere are nodes."""
    own = file_symbols.filter(F.col("path") == path)
    top = own.filter("parent_symbol_id IS NULL").select(F.lit(path).alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"))
    inner = own.filter("parent_symbol_id IS NOT NULL").select(F.col("parent_symbol_id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"))
    uses = deps.filter(F.col("source_path") == path).select(F.col("source_symbol_id").alias("source"), F.col("target_symbol_id").alias("target"), F.lit("uses").alias("kind")).distinct()
    edges = top.unionByName(inner).unionByName(uses)
    nodes = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    return nodes.withColumns({"label": name_of_symbol(F.col("id")), "is_external": path_of_symbol(F.col("id")) != path}), edges


def drill_down(symbol_id: Column) -> Column:
    """Struct of the path and the symbol name, null for a plain path."""
    path = path_of_symbol(symbol_id)
    return F.struct(path.alias("path"), F.when(path != symbol_id, name_of_symbol(symbol_id)).alias("symbol"))


def listed_symbols(file_symbols: DataFrame) -> DataFrame:
    """Symbols for a list, without types and interfaces."""
    return file_symbols.filter(~F.col("category").isin("type", "interface"))


def dependency_tree(file_symbols: DataFrame, deps: DataFrame) -> DataFrame:
    """id, name, parent, rank, depends_on, used_by (distinct, ascending, comma-joined); classes first, then by name, under their parent."""
    out = deps.groupBy(F.col("source_symbol_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("target_symbol_id")), ",").alias("depends_on"))
    into = deps.groupBy(F.col("target_symbol_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("source_symbol_id")), ",").alias("used_by"))
    unique = first_of(file_symbols, ["id"], F.col("line"))
    rank = F.row_number().over(Window.partitionBy("path", "parent_symbol_id").orderBy((F.col("category") != "class").cast("int"), "name", "id"))
    rows = unique.withColumn("rank", rank).join(out, "id", "left").join(into, "id", "left")
    return rows.select("id", "name", F.col("parent_symbol_id").alias("parent"), "rank", F.coalesce("depends_on", F.lit("")).alias("depends_on"), F.coalesce("used_by", F.lit("")).alias("used_by"))


def intra_file(symbols: DataFrame, calls: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, kind) and call edges within one file, from an editor's call tables.

    symbols: id, path, name, lsp_kind, container_name; calls: source_id, target_id, line.
    Kinds come down to class, function and variable; an unnamed callback takes its container's name.
    """
    own = symbols.filter(F.col("path") == path)
    kind = F.when(F.col("lsp_kind").isin("Class", "Interface", "Struct", "Enum"), "class").when(F.col("lsp_kind").isin("Function", "Method", "Constructor"), "function").otherwise("variable")
    unnamed = F.col("name").rlike(r"^(<.*>|\(anonymous.*|.*\bcallback)$")
    name = F.when(unnamed & F.col("container_name").isNotNull(), F.concat("container_name", F.lit("() callback"))).otherwise(F.col("name"))
    ids = own.select("id")
    edges = calls.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return own.select("id", name.alias("name"), kind.alias("kind")), edges.select("source_id", "target_id").distinct()


def apply_update(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, same_file: bool, refresh: bool, reason: str) -> tuple[DataFrame, DataFrame]:
    """The graph after an update: merged if it refreshes the same file while indexing goes on, else replaced."""
    if same_file and refresh and reason == "indexing":
        return merge_nodes(nodes, new_nodes), merge_edges(edges, new_edges)
    return new_nodes, new_edges
