"""Traversal and cycles on graphs small enough to answer by hand, and against brute force."""

import inspect
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import cycles, traverse


def pairs(spark, text):
    return spark.createDataFrame([tuple(e) for e in text.split()], "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def calls(spark, edges):
    """Symbols and edges; a relation is CALLS unless a third word names it."""
    e = [(x + ("CALLS",))[:3] for x in edges]
    ids = sorted({i for x in e for i in x[:2] if not i.startswith("@@")})
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(e, "source_id string, target_id string, type_relation string")


def test_chain_by_depth(spark, rows):
    s, e = calls(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert rows(traverse.neighbourhood_nodes(s, e, "b", 1)) == {("b", 0), ("a", 1), ("c", 1)}
    assert rows(traverse.neighbourhood_nodes(s, e, "b", 2)) == {("b", 0), ("a", 1), ("c", 1), ("d", 2)}
    assert rows(traverse.neighbourhood_nodes(s, e, "b", 0)) == {("b", 0)}


def test_missing_root_gives_nothing(spark):
    s, e = calls(spark, [("a", "b")])
    assert traverse.neighbourhood(s, e, "zz").count() == 0
    assert traverse.neighbourhood_nodes(s, e, "zz").count() == 0


def test_stubs_are_not_entered(spark, rows):
    s, e = calls(spark, [("a", "@@external:x"), ("b", "@@external:x"), ("a", "c")])
    assert rows(traverse.neighbourhood_nodes(s, e, "a", 3), "node") == {("a",), ("c",)}


def test_direction_and_cycle_flags(spark, rows):
    s, e = calls(spark, [("a", "a"), ("a", "b"), ("b", "a", "USES"), ("b", "c"), ("c", "b"), ("c", "b", "USES")])
    assert rows(traverse.neighbourhood(s, e, "a", 2)) == {
        ("a", "a", "CALLS", "outgoing", True),
        ("a", "b", "CALLS", "outgoing", False),
        ("b", "a", "USES", "incoming", False),
        ("b", "c", "CALLS", "lateral", True),
        ("c", "b", "CALLS", "lateral", True),
        ("c", "b", "USES", "lateral", True),
    }


def test_clamp():
    assert [traverse.clamp_depth(x) for x in (-3, 0, 1.4, 2.5, 9)] == [1, 1, 1, 3, 5]


def test_negative_depth(spark):
    with pytest.raises(ValueError):
        traverse.reach(pairs(spark, "ab"), nodes(spark, "a"), -1)


def deps(spark, text):
    return pairs(spark, text).toDF("source", "target")


def test_crawl_uses_least_depth(spark, rows):
    d = deps(spark, "sa sx ax xy yz")
    assert rows(traverse.crawl(d, nodes(spark, "s"), 2)) == {("s", 0), ("a", 1), ("x", 1), ("y", 2), ("z", 3)}
    assert rows(traverse.crawl_graph(d, nodes(spark, "s"), 1)[1]) == {("s", "a"), ("s", "x"), ("a", "x"), ("x", "y")}


def test_crawl_stops_at_leaves_and_cycles(spark, rows):
    d = deps(spark, "ab bc ca cl lm")
    assert rows(traverse.crawl(d, nodes(spark, "a"), 50, F.col("node") == "l"), "node") == {(x,) for x in "abcl"}


def test_crawl_from_known(spark, rows):
    assert rows(traverse.crawl_from(deps(spark, "ab bc cd"), nodes(spark, "b"), nodes(spark, "a", "b")), "node") == {("c",), ("d",)}


def test_related_and_direct(spark, rows):
    p = pairs(spark, "ab cb cd xy")
    n, e = traverse.related(p, nodes(spark, "a"))
    assert rows(n, "node") == {(x,) for x in "abcd"}
    assert rows(e) == {("a", "b"), ("c", "b"), ("c", "d")}
    assert rows(traverse.direct(p, "b")) == {("a", "b"), ("c", "b")}


def test_visible(spark, rows):
    p = pairs(spark, "rb bc cd pr")
    assert rows(traverse.visible(p, nodes(spark, "r"), nodes(spark, "r", "b"))) == {("r",), ("b",), ("c",)}
    assert rows(traverse.visible(p, nodes(spark, "r"), nodes(spark, "r"), with_parents=True)) == {("r",), ("b",), ("p",)}


def test_caps(spark):
    p = pairs(spark, "ra rb rc ab")
    n, e, cut = traverse.capped(traverse.reach(p, nodes(spark, "r")), p, 3, 1)
    assert n.count() == 3 and e.count() == 1
    assert tuple(cut.first()) == (True, True)


def test_trace(spark, rows):
    p = pairs(spark, "ab bc ca cd")
    assert rows(traverse.trace(p, nodes(spark, "a"), 2)) == {(1, "a", "b"), (2, "b", "c")}
    assert rows(traverse.trace(p, nodes(spark, "a"))) == {(1, "a", "b"), (2, "b", "c"), (3, "c", "a"), (3, "c", "d")}
    assert traverse.trace(p, nodes(spark, "a"), 0).count() == 0


def test_triangle_with_chord(spark, rows):
    p = pairs(spark, "ab bc ca ac")
    assert len(rows(cycles.cycle_edges(p))) == 4
    assert rows(cycles.dfs_cycle_edges(p)) == {("a", "b"), ("b", "c"), ("c", "a")}


def test_bridge(spark, rows):
    p = pairs(spark, "ab ba bc cd dc ee ef")
    assert rows(cycles.cycle_edges(p)) == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "e")}
    assert ("b", "c") in rows(cycles.edges_between_cycle_nodes(p))
    assert rows(cycles.cycle_types(p)) == {("a", 2, "mutual-recursive"), ("c", 2, "mutual-recursive"), ("e", 1, "self-recursive")}


def test_no_cycles(spark):
    assert cycles.cycle_edges(pairs(spark, "ab bc")).count() == 0
    assert cycles.dfs_cycle_edges(pairs(spark, "ab bc")).count() == 0
    assert cycles.cycle_edges(spark.createDataFrame([], "src string, dst string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_both_ways_to_components_agree_with_reachability(spark, rows, seed):
    r = random.Random(seed)
    edges = {(r.randrange(16), r.randrange(16)) for _ in range(26)}
    reach = {a: {a} for a in range(16)}
    for _ in range(16):
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    on_cycle = {(a, b) for a, b in edges if a in reach[b]}
    p = spark.createDataFrame(sorted(edges), "src long, dst long")
    assert rows(cycles.cycle_edges(p)) == on_cycle
    assert rows(cycles.cycle_edges(p, small_core=0)) == on_cycle


def test_depth_first_cycles_have_no_limit_of_edges(spark, rows):
    """Against the search written down node by node; a limit of edges would have to be given by hand."""
    assert "most" not in inspect.signature(cycles.dfs_cycle_edges).parameters
    r = random.Random(3)
    for n, m in ((6, 14), (30, 70), (60, 240)):
        edges = sorted({(f"n{r.randrange(n):02}", f"n{r.randrange(n):02}") for _ in range(m)})
        out, left, found = {}, set(), set()
        for a, b in edges:
            out.setdefault(a, []).append(b)

        def visit(path):
            for to in out.get(path[-1], ()):
                if to in path:
                    loop = [*path[path.index(to) :], to]
                    found.update(zip(loop, loop[1:], strict=False))
                elif to not in left:
                    visit([*path, to])
            left.add(path[-1])

        for start in sorted(out):
            if start not in left:
                visit([start])
        assert rows(cycles.dfs_cycle_edges(spark.createDataFrame(edges, "src string, dst string"))) == found
