"""Cycles: an edge is on one if both its ends are in the same strongly connected component, or if it is a loop.

Nodes without incoming or outgoing edges are trimmed first; in call graphs little
is left. A small core (its size is counted) goes to one task as numbers, which finds
the components by an iterative depth-first search. A larger one is coloured: the
greatest node that reaches a node is its colour; nodes that reach their colour's
node within the colour form a component, which leaves; then the rest is trimmed
and coloured again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import few, settled

SMALL_CORE = 1_000_000
#: Rows that a task hands on at once.
ROWS = 100_000


def trim(pairs: DataFrame) -> tuple[DataFrame, int]:
    """Edges (src, dst) whose source is entered and whose target is left, repeatedly; and their number."""
    core = settled(pairs)
    n = core.count()
    while n:
        # there are at most n ends
        entered, left = core.select(F.col("dst").alias("src")).distinct(), core.select(F.col("src").alias("dst")).distinct()
        ends = core.select(F.count_distinct("src"), F.count_distinct("dst")).first()
        core = settled(core.join(few(entered, ends[1]), "src", "left_semi").join(few(left, ends[0]), "dst", "left_semi").select("src", "dst"))
        m = core.count()
        if m == n:
            break
        n = m
    return core, n


def strong_components(edges: list[tuple]) -> dict:
    """Node to the least node of its component, of all nodes of the edges."""
    out: dict = {}
    for a, b in sorted(edges):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict = {}
    low: dict = {}
    path: list = []
    on_path: set = set()
    root: dict = {}
    for start in out:
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        path.append(start)
        on_path.add(start)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in index:
                    index[to] = low[to] = len(index)
                    path.append(to)
                    on_path.add(to)
                    work.append((to, iter(out[to])))
                    break
                if to in on_path:
                    low[node] = min(low[node], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        x = path.pop()
                        on_path.discard(x)
                        members.append(x)
                        if x == node:
                            break
                    least = min(members)
                    root.update(dict.fromkeys(members, least))
    return root


def numbered(batches: Iterator[pd.DataFrame]) -> tuple[list, list[tuple[int, int]]]:
    """Nodes in ascending order, and the edges src, dst between their numbers: strings are held once."""
    number: dict = {}
    parts = [np.array([[number.setdefault(x, len(number)) for x in rows[c]] for c in ("src", "dst")], np.int64) for rows in batches]
    names = sorted(number)
    place = np.empty(len(names), np.int64)
    place[[number[x] for x in names]] = np.arange(len(names))
    edges = place[np.concatenate([np.zeros((2, 0), np.int64), *parts], 1)]
    return names, list(zip(*edges.tolist(), strict=True))


def _small(core: DataFrame) -> DataFrame:
    kind = core.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, edges = numbered(batches)
        root = strong_components(edges)
        yield pd.DataFrame({"node": [names[x] for x in root], "component": [names[x] for x in root.values()]})

    return core.coalesce(1).mapInPandas(run, f"node {kind}, component {kind}")


def _coloured(core: DataFrame) -> DataFrame:
    found = None
    core, n = trim(core)
    while n:
        nodes = core.select(F.col("src").alias("node")).unionByName(core.select(F.col("dst").alias("node"))).distinct()
        colour = settled(nodes.withColumn("colour", F.col("node")))
        while True:
            most = core.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("m"))
            new = settled(colour.join(most, "node", "left").select("node", F.greatest("colour", "m").alias("new"), "colour"))
            moved = new.filter("new <> colour").count()
            colour = settled(new.select("node", F.col("new").alias("colour")))
            if not moved:
                break
        inner = (
            core.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src")
            .join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst")
            .filter("c1 = c2")
            .select("src", "dst")
        )
        inner = settled(inner)
        members = frontier = settled(colour.filter("node = colour"))
        back = inner.select(F.col("dst"), F.col("src").alias("node"))
        while not frontier.isEmpty():
            step = back.join(frontier.withColumnRenamed("node", "dst"), "dst").select("node", "colour").distinct()
            frontier = settled(step.join(members, "node", "left_anti"))
            members = settled(members.unionByName(frontier))
        found = members if found is None else settled(found.unionByName(members))
        rest = inner.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti")
        core, n = trim(rest)
    if found is None:
        return core.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    least = found.groupBy("colour").agg(F.min("node").alias("component"))
    return found.join(least, "colour").select("node", "component")


def components(pairs: DataFrame, small_core: int = SMALL_CORE) -> DataFrame:
    """node, component (its least node) of nodes that may share a component; all others are alone."""
    core, n = trim(pairs.select("src", "dst").filter("src <> dst").distinct())
    if not n:
        return core.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return _small(core) if n <= small_core else _coloured(core)


def cycle_edges(pairs: DataFrame, small_core: int = SMALL_CORE) -> DataFrame:
    """Distinct src, dst of pairs that lie on a cycle."""
    pairs = settled(pairs.select("src", "dst").distinct())
    comp = settled(components(pairs, small_core))
    n = comp.count()
    same = (
        pairs.filter("src <> dst")
        .join(few(comp.select(F.col("node").alias("src"), F.col("component").alias("a")), n), "src")
        .join(few(comp.select(F.col("node").alias("dst"), F.col("component").alias("b")), n), "dst")
        .filter("a = b")
        .select("src", "dst")
    )
    return same.unionByName(pairs.filter("src = dst"))


def capped_cycle_edges(pairs: DataFrame, cap: int = 0) -> DataFrame:
    """cycle_edges, or none if there are more than cap pairs (0: no cap)."""
    pairs = pairs.select("src", "dst").distinct()
    return pairs.limit(0) if cap and pairs.limit(cap + 1).count() > cap else cycle_edges(pairs)


def cycle_nodes(pairs: DataFrame) -> DataFrame:
    """node of those on a cycle."""
    found = cycle_edges(pairs)
    return found.select(F.col("src").alias("node")).unionByName(found.select(F.col("dst").alias("node"))).distinct()


def edges_between_cycle_nodes(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with both ends on cycles, bridges between cycles included."""
    nodes = settled(cycle_nodes(pairs))
    return pairs.select("src", "dst").distinct().join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def cycle_types(pairs: DataFrame) -> DataFrame:
    """component, n_nodes, cycle_type of each component with a cycle: one node with a loop, two nodes, or more."""
    pairs = settled(pairs.select("src", "dst").distinct())
    nodes = settled(cycle_nodes(pairs))
    comp = components(pairs)
    sized = nodes.join(comp, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.count(F.lit(1)).alias("n_nodes"))
    kind = F.when(F.col("n_nodes") == 1, "self-recursive").when(F.col("n_nodes") == 2, "mutual-recursive").otherwise("complex")
    return sized.withColumn("cycle_type", kind)


def _depth_first(key: np.ndarray, n: int) -> np.ndarray:
    """Of the edges src * n + dst, ascending, those along the stack of a back edge: a mark for each. Places and marks stand in arrays, about 30 bytes an edge or node."""
    first = np.searchsorted(key, np.arange(n + 1) * n)
    ends, to, found = memoryview(first[1:].copy()), memoryview((key % n).astype(np.int32 if n < 1 << 31 else np.int64)), np.zeros(len(key), np.uint8)
    at, state, marks = memoryview(first[:-1].copy()), memoryview(np.full(n, -1)), memoryview(found)
    for start in range(n):
        if state[start] != -1:
            continue
        # state: the place on the path, -1 before, -2 after; reach: the lowest place that a back edge from here or above it has met; via: the edge that led here
        path, reach, via = [start], [0], [-1]
        state[start] = 0
        while path:
            node = path[-1]
            e = at[node]
            if e < ends[node]:
                at[node] = e + 1
                place = state[to[e]]
                if place == -1:
                    state[to[e]] = len(path)
                    reach.append(len(path))
                    path.append(to[e])
                    via.append(e)
                elif place >= 0:
                    marks[e] = 1
                    reach[-1] = min(reach[-1], place)
            else:
                path.pop()
                low, e = reach.pop(), via.pop()
                state[node] = -2
                if low < len(path):
                    marks[e] = 1
                    reach[-1] = min(reach[-1], low)
    return found.view(bool)


def dfs_cycle_edges(pairs: DataFrame) -> DataFrame:
    """src, dst along the stack of each back edge of a depth-first search that takes nodes and edges in ascending order.

    The result depends on that order and misses edges whose cycles close over
    nodes already left; cycle_edges is complete. Such an order can't be divided, so
    one task searches what trimming leaves, as numbers of eight bytes an edge.
    """
    core, m = trim(pairs.select("src", "dst").distinct())
    if not m:
        return core
    nodes = core.select(F.col("src").alias("node")).distinct()
    number = settled(nodes.withColumn("k", F.row_number().over(Window.orderBy("node")).cast("long") - 1))
    n = number.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)])
        key.sort()
        key = key[_depth_first(key, n)]
        for k in range(0, len(key), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(key[k : k + ROWS] // n), pa.array(key[k : k + ROWS] % n)], ["s", "d"])

    # every node of the core has edges both ways
    keys = core.join(few(number.toDF("src", "s"), n), "src").join(few(number.toDF("dst", "d"), n), "dst").select((F.col("s") * n + F.col("d")).alias("key"))
    found = settled(settled(keys).coalesce(1).mapInArrow(run, "s long, d long")).repartition("s")
    return found.join(few(number.toDF("src", "s"), n), "s").join(few(number.toDF("dst", "d"), n), "d").select("src", "dst")
