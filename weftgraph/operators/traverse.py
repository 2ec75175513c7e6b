"""Bounded and unbounded traversal as loops of frontier joins.

A hop joins the edges with the frontier only, takes distinct new nodes and
anti-joins what has been seen; each hop's frontier is a checkpoint, so plans stay
short and a lost executor costs one hop. Frontiers are counted: few nodes are
broadcast, so a hop reads the edges without dealing them out. Nodes may be of any
type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import few, settled
from ..schema import is_stub


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None, barrier: Column | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """node, depth (least number of hops) of all nodes that seeds (column node) reach over edges (src, dst).

    depth: the most hops, None for no bound. barrier: a condition on `node` for
    nodes that aren't entered; seeds always are. blocked: nodes (column node)
    that are reached but not left.
    """
    if depth is not None and depth < 0:
        raise ValueError("depth is 0 or more")
    frontier = settled(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    visited, hop = frontier, 0
    n = total = frontier.count()
    pairs = edges.select("src", F.col("dst").alias("node"))
    while (depth is None or hop < depth) and n:
        hop += 1
        leave = frontier if blocked is None else frontier.join(blocked, "node", "left_anti")
        step = pairs.join(few(leave.select(F.col("node").alias("src")), n), "src").select("node").distinct()
        if barrier is not None:
            step = step.filter(~barrier)
        frontier = settled(step.join(few(visited, total), "node", "left_anti").withColumn("depth", F.lit(hop)))
        n = frontier.count()
        total += n
        visited = visited.unionByName(frontier)
        if hop % 8 == 0:
            visited = settled(visited)
    return visited


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def call_pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))


def clamp_depth(depth: float) -> int:
    """A depth that a user asked for, rounded half up, 1 to 5."""
    return max(1, min(5, int(depth + 0.5)))


def _seed(symbols: DataFrame, root) -> DataFrame:
    """The root as a column node; empty if no symbol has this id. root: an id, or a DataFrame with a column id."""
    found = symbols.select("id").filter(F.col("id") == root) if not isinstance(root, DataFrame) else symbols.join(root.select("id"), "id", "left_semi").select("id")
    return found.select(F.col("id").alias("node"))


def neighbourhood_nodes(symbols: DataFrame, edges: DataFrame, root, depth: int = 2) -> DataFrame:
    """node, depth within so many hops of the root, both ways; stubs aren't entered; nothing without the root."""
    return reach(both_ways(call_pairs(edges)), _seed(symbols, root), depth, is_stub(F.col("node")))


def induced_edges(edges: DataFrame, nodes: DataFrame, src: str = "source_id", dst: str = "target_id") -> DataFrame:
    """Edges with both ends among nodes (column node; a checkpoint, as it is counted)."""
    n = nodes.count()
    return edges.join(few(nodes.select(F.col("node").alias(src)), n), src, "left_semi").join(few(nodes.select(F.col("node").alias(dst)), n), dst, "left_semi")


def direction(source: Column, target: Column, root: Column) -> Column:
    """Relative to the root; a loop at the root is outgoing."""
    return F.when(source == root, "outgoing").when(target == root, "incoming").otherwise("lateral")


def neighbourhood(symbols: DataFrame, edges: DataFrame, root, depth: int = 2) -> DataFrame:
    """Edges around the root: source_id, target_id, type_relation, direction, is_cyclic (by pair, over all relations but USES)."""
    from .cycles import cycle_edges

    near = settled(neighbourhood_nodes(symbols, edges, root, depth))
    own = settled(induced_edges(edges.select("source_id", "target_id", "type_relation"), near))
    calls = own.filter("type_relation <> 'USES'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    cyclic = cycle_edges(calls).select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit(True).alias("__c"))
    roots = near.filter("depth = 0").select(F.col("node").alias("__root"))
    marked = own.join(cyclic, ["source_id", "target_id"], "left").crossJoin(F.broadcast(roots.limit(1)))
    return marked.select("source_id", "target_id", "type_relation", direction(F.col("source_id"), F.col("target_id"), F.col("__root")).alias("direction"), F.coalesce("__c", F.lit(False)).alias("is_cyclic"))


def crawl(deps: DataFrame, start: DataFrame, depth: int = 50, leaf: Column | None = None) -> DataFrame:
    """Nodes (node, depth) of a crawl over source -> target from start (column node).

    A node at the greatest depth still shows its dependencies, so nodes reach one
    hop further. Depth is the least number of hops: a node that a depth-first
    crawl first meets at its limit, and so doesn't expand, is expanded here if a
    shorter way exists. leaf: a condition on `node` for nodes that aren't expanded.
    """
    edges = deps.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    blocked = edges.select(F.col("src").alias("node")).distinct().filter(leaf) if leaf is not None else None
    return reach(edges, start, depth + 1, blocked=blocked)


def crawl_graph(deps: DataFrame, start: DataFrame, depth: int = 50, leaf: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of a crawl, and the distinct edges that it walks."""
    nodes = settled(crawl(deps, start, depth, leaf))
    inner = nodes.filter(F.col("depth") <= depth)
    inner = inner if leaf is None else inner.filter(~leaf)
    edges = deps.select("source", "target").distinct().join(inner.select(F.col("node").alias("source")), "source", "left_semi")
    return nodes, edges


def crawl_from(deps: DataFrame, start: DataFrame, known: DataFrame, extra_depth: int = 10) -> DataFrame:
    """What a crawl from start adds to known nodes (column node)."""
    return crawl(deps, start, extra_depth).join(known.select("node").distinct(), "node", "left_anti")


def related(pairs: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of start's weak component, and the edges (src, dst) that touch them."""
    nodes = settled(reach(both_ways(pairs), start))
    return nodes, pairs.join(few(nodes.select(F.col("node").alias("src")), nodes.count()), "src", "left_semi")


def direct(pairs: DataFrame, node) -> DataFrame:
    """Edges at a node."""
    return pairs.filter((F.col("src") == node) | (F.col("dst") == node))


def visible(pairs: DataFrame, root: DataFrame, expanded: DataFrame, with_parents: bool = False) -> DataFrame:
    """node of the root, all reached through expanded nodes (column node), and with_parents those with an edge to the root."""
    leaving = pairs.join(expanded.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    nodes = reach(leaving, root).select("node")
    if with_parents:
        nodes = nodes.unionByName(pairs.join(root.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")))
    return nodes.distinct()


def capped(nodes: DataFrame, edges: DataFrame, max_nodes: int = 400, max_edges: int = 1500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes by depth and id up to a cap, drawn edges up to a cap, and one row of flags for what was cut."""
    shown = settled(nodes.orderBy("depth", "node").limit(max_nodes))
    inner = induced_edges(edges, shown, "src", "dst")
    cut = nodes.agg((F.count(F.lit(1)) > max_nodes).alias("nodes_cut")).crossJoin(inner.agg((F.count(F.lit(1)) > max_edges).alias("edges_cut")))
    return shown, inner.orderBy("src", "dst").limit(max_edges), cut


def trace_rows(deps: DataFrame, start: DataFrame, known: DataFrame, max_depth: int = 10) -> DataFrame:
    """The rows of trace() with resolved, the file of what is called (known: id, path; null for others), and max_depth_reached, alike in all rows: whether something known is called from below the last depth."""
    rows = settled(trace(deps, start, max_depth))
    files = known.select(F.col("id").alias("called"), F.col("path").alias("resolved"))
    callers = rows.select(F.col("caller").alias("node")).distinct()
    deeper = rows.filter(F.col("depth") == max_depth).select(F.col("called").alias("node")).distinct().join(callers, "node", "left_anti")
    cut = not deeper.join(files.select(F.col("called").alias("node")), "node", "left_semi").join(deps.select(F.col("src").alias("node")), "node", "left_semi").isEmpty()
    return rows.join(files, "called", "left").select("depth", "caller", "called", "resolved", F.lit(cut).alias("max_depth_reached"))


def trace(deps: DataFrame, start: DataFrame, max_depth: int = 10) -> DataFrame:
    """depth, caller, called of calls from start (column node), each caller once, at its least depth; deps has src, dst."""
    callers = reach(deps, start, max_depth - 1) if max_depth > 0 else start.select("node").limit(0).withColumn("depth", F.lit(0))
    return deps.join(callers.withColumnRenamed("node", "src"), "src").select((F.col("depth") + 1).alias("depth"), F.col("src").alias("caller"), F.col("dst").alias("called")).distinct()
