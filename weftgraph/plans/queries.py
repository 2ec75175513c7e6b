"""The registered queries of the code-graph operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, misc, paths
from ..operators import cycles, diff, resolve, store, traverse, usage, views
from ..sources import callgraph, imports, signatures
from ..streaming import changes as feed
from . import fixtures as fx
from .runtime import settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _pairs(e: DataFrame) -> DataFrame:
    return traverse.call_pairs(e)


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return settled(_pairs(fx.edges(spark, d).filter("type_relation <> 'USES'")))


def _file_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _deps(spark, d).select(F.col("source").alias("src"), F.col("target").alias("dst"))


def _deps(spark: SparkSession, d: str) -> DataFrame:
    """The derived graph as a stored table, as loops read it more than once."""
    return settled(fx.deps(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return settled(fx.edges(spark, d))


# Traversal

NEAR = (
    "WITH RECURSIVE"
    + fx.EDGES
    + """,
both_ways AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
near AS (SELECT id AS node, 0 AS depth FROM root UNION SELECT b, depth + 1 FROM near JOIN both_ways ON a = node WHERE depth < 2),
nodes AS (SELECT node, min(depth) AS depth FROM near GROUP BY node),
own AS (SELECT source_id, target_id, type_relation FROM edges WHERE source_id IN (SELECT node FROM nodes) AND target_id IN (SELECT node FROM nodes)),
walk AS (
  SELECT source_id AS a, target_id AS b FROM own WHERE type_relation <> 'USES'
  UNION SELECT w.a, o.target_id FROM walk w JOIN own o ON o.source_id = w.b AND o.type_relation <> 'USES')"""
)


@query(
    "g1_neighbourhood",
    NEAR
    + """
SELECT o.source_id, o.target_id, o.type_relation,
  CASE WHEN o.source_id = id THEN 'outgoing' WHEN o.target_id = id THEN 'incoming' ELSE 'lateral' END AS direction,
  (EXISTS (SELECT 1 FROM own c WHERE c.type_relation <> 'USES' AND c.source_id = o.source_id AND c.target_id = o.target_id)
    AND EXISTS (SELECT 1 FROM walk w WHERE w.a = o.target_id AND w.b = o.source_id)) AS is_cyclic
FROM own o, root""",
)
def g1(spark: SparkSession, d: str) -> DataFrame:
    return traverse.neighbourhood(fx.symbols(spark, d), _edges(spark, d), fx.root(spark, d), 2)


@query("g1_neighbourhood_nodes", NEAR + " SELECT node, depth FROM nodes")
def g1_nodes(spark: SparkSession, d: str) -> DataFrame:
    return traverse.neighbourhood_nodes(fx.symbols(spark, d), _edges(spark, d), fx.root(spark, d), 2)


@query("g3_node_rows", NEAR + " SELECT id, name, type, lang, path, folder, start_line, end_line, is_exported FROM symbols WHERE id IN (SELECT node FROM nodes)")
def g3(spark: SparkSession, d: str) -> DataFrame:
    ids = g1_nodes(spark, d).select(F.col("node").alias("id"))
    return fx.symbols(spark, d).join(ids, "id", "left_semi").select("id", "name", "type", "lang", "path", "folder", "start_line", "end_line", "is_exported")


@query(
    "g5_compounds",
    "WITH" + fx.SYMBOLS + """
SELECT DISTINCT folder AS id, folder AS label, 'folder' AS level, CAST(NULL AS VARCHAR) AS parent FROM symbols
UNION ALL SELECT DISTINCT path, regexp_extract(path, '[^/]+$'), 'file', folder FROM symbols""",
)
def g5(spark: SparkSession, d: str) -> DataFrame:
    return views.compounds(fx.symbols(spark, d))


@query(
    "g6_symbol_at_line",
    "WITH" + fx.EDGES + """,
cursors AS (SELECT DISTINCT source_path AS path, source_line AS line FROM edges),
inside AS (SELECT c.path, c.line, s.id, s.start_line FROM cursors c JOIN symbols s ON s.path = c.path AND c.line BETWEEN s.start_line AND s.end_line),
best AS (SELECT path, line, id FROM inside QUALIFY row_number() OVER (PARTITION BY path, line ORDER BY start_line DESC, id) = 1),
firsts AS (SELECT path, id FROM symbols QUALIFY row_number() OVER (PARTITION BY path ORDER BY start_line, id) = 1)
SELECT c.path, c.line, coalesce(b.id, f.id) AS id FROM cursors c LEFT JOIN best b USING (path, line) JOIN firsts f ON f.path = c.path""",
)
def g6(spark: SparkSession, d: str) -> DataFrame:
    cursors = fx.symbol_deps(spark, d).select(F.col("source_path").alias("path"), "line").distinct()
    return views.symbols_at(fx.symbols(spark, d), cursors)


@query(
    "g8_external_callers",
    "WITH" + fx.EDGES + """
SELECT s.name AS caller_name, s.path AS caller_path, s.start_line AS caller_start_line, t.name AS target_name
FROM edges e JOIN symbols t ON t.id = e.target_id JOIN symbols s ON s.id = e.source_id
WHERE t.type <> 'method' AND s.path <> t.path AND t.path = (SELECT s2.path FROM root JOIN symbols s2 USING (id))
ORDER BY target_name, caller_path, caller_name, caller_start_line LIMIT 50""",
)
def g8(spark: SparkSession, d: str) -> DataFrame:
    s = fx.symbols(spark, d)
    here = s.join(fx.root(spark, d), "id", "left_semi").first()["path"]
    return usage.external_callers(s, fx.edges(spark, d), here)


CRAWL = (
    "WITH RECURSIVE"
    + fx.DEPS
    + """,
walk AS (SELECT node, 0 AS depth FROM start UNION SELECT target, depth + 1 FROM walk JOIN deps ON source = node WHERE depth < {hops}),
nodes AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"""
)


@query("g9_crawl", CRAWL.replace("{hops}", "3") + " SELECT node, depth FROM nodes")
def g9(spark: SparkSession, d: str) -> DataFrame:
    return traverse.crawl(_deps(spark, d), fx.root_file(spark, d), 2)


@query("g9_crawl_edges", CRAWL.replace("{hops}", "2") + " SELECT source, target FROM deps WHERE source IN (SELECT node FROM nodes WHERE depth <= 1)")
def g9_edges(spark: SparkSession, d: str) -> DataFrame:
    return traverse.crawl_graph(_deps(spark, d), fx.root_file(spark, d), 1)[1]


@query("g10_crawl_from", CRAWL.replace("{hops}", "3") + " SELECT node, depth FROM nodes WHERE node NOT IN (SELECT target FROM deps JOIN start ON source = node) AND node NOT IN (SELECT node FROM start)")
def g10(spark: SparkSession, d: str) -> DataFrame:
    dep, start = _deps(spark, d), fx.root_file(spark, d)
    known = settled(dep.join(start.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).unionByName(start))
    return traverse.crawl_from(dep, start, known, 2)


@query(
    "g13_related",
    "WITH RECURSIVE" + fx.EDGES + """,
both_ways AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
near AS (SELECT id AS node FROM root UNION SELECT b FROM near JOIN both_ways ON a = node)
SELECT DISTINCT source_id AS src, target_id AS dst FROM edges WHERE source_id IN (SELECT node FROM near)""",
)
def g13(spark: SparkSession, d: str) -> DataFrame:
    return traverse.related(settled(_pairs(fx.edges(spark, d)).distinct()), fx.root(spark, d).select(F.col("id").alias("node")))[1]


@query("g14_direct", "WITH" + fx.EDGES + " SELECT DISTINCT source_id AS src, target_id AS dst FROM edges, root WHERE source_id = id OR target_id = id")
def g14(spark: SparkSession, d: str) -> DataFrame:
    return traverse.direct(_pairs(fx.edges(spark, d)).distinct(), fx.root(spark, d).first()["id"])


@query(
    "g15_visible",
    "WITH RECURSIVE" + fx.DEPS + """,
walk AS (SELECT node FROM start UNION SELECT target FROM walk JOIN deps ON source = node WHERE contains(source, 'brand#1') OR contains(source, 'brand1') OR source IN (SELECT node FROM start))
SELECT node FROM walk UNION SELECT source FROM deps WHERE target IN (SELECT node FROM start)""",
)
def g15(spark: SparkSession, d: str) -> DataFrame:
    pairs, start = _file_pairs(spark, d), fx.root_file(spark, d)
    expanded = pairs.select(F.col("src").alias("node")).filter(F.col("node").contains("brand1")).unionByName(start)
    return traverse.visible(pairs, start, expanded, with_parents=True)


@query("g16_capped", CRAWL.replace("{hops}", "3") + " SELECT node, depth FROM nodes ORDER BY depth, node LIMIT 40")
def g16(spark: SparkSession, d: str) -> DataFrame:
    nodes = settled(traverse.crawl(_deps(spark, d), fx.root_file(spark, d), 2))
    return traverse.capped(nodes, _file_pairs(spark, d), 40, 100)[0]


@query("g17_depth", CRAWL.replace("{hops}", "50") + " SELECT depth, count(*) AS n_nodes FROM nodes GROUP BY depth")
def g17(spark: SparkSession, d: str) -> DataFrame:
    return traverse.crawl(_deps(spark, d), fx.root_file(spark, d), 49).groupBy("depth").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(
    "g18_trace",
    "WITH RECURSIVE" + fx.EDGES + """,
walk AS (SELECT id AS node, 0 AS depth FROM root UNION SELECT target_id, depth + 1 FROM walk JOIN edges ON source_id = node WHERE depth < 3),
callers AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
SELECT DISTINCT depth + 1 AS depth, source_id AS caller, target_id AS called FROM callers JOIN edges ON source_id = node WHERE depth < 4""",
)
def g18(spark: SparkSession, d: str) -> DataFrame:
    return traverse.trace(_pairs(_edges(spark, d)), fx.root(spark, d).select(F.col("id").alias("node")), 4)


@query("g20_merge", "WITH" + fx.EDGES + " SELECT DISTINCT source_id AS source, target_id AS target FROM edges")
def g20(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    old, new = (e.filter(c).select(F.col("source_id").alias("source"), F.col("target_id").alias("target")) for c in ("type_relation <> 'USES'", "type_relation <> 'CALLS'"))
    return views.merge_edges(old, new)


@query("g22_filter", "WITH" + fx.DEPS + ", f AS (SELECT DISTINCT source_path AS path FROM edges JOIN root ON target_id = id UNION SELECT s.path FROM symbols s JOIN root USING (id)) SELECT source, target FROM deps WHERE source IN (SELECT path FROM f) AND target IN (SELECT path FROM f)")
def g22(spark: SparkSession, d: str) -> DataFrame:
    root = fx.root(spark, d).first()["id"]
    here = fx.symbols(spark, d).filter(F.col("id") == root).select("path")
    return views.filter_to(fx.deps(spark, d).select("source", "target"), views.caller_files(fx.symbol_deps(spark, d), root), here)


@query("g23_expand_all", "WITH" + fx.DEPS + " SELECT source AS node FROM deps UNION SELECT '/ws/main.ts'")
def g23(spark: SparkSession, d: str) -> DataFrame:
    return views.expand_all(fx.deps(spark, d), "/ws/main.ts")


@query(
    "g24_legend",
    "WITH" + fx.EDGES + """,
n AS (SELECT id FROM symbols WHERE type IN ('function', 'class', 'method') AND folder <> '/ws/brand3'),
e AS (SELECT source_id, target_id, type_relation, CASE WHEN source_id = id THEN 'outgoing' WHEN target_id = id THEN 'incoming' ELSE 'lateral' END AS direction FROM edges, root)
SELECT source_id, target_id, type_relation, direction FROM e
WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n) AND NOT (direction = 'outgoing' AND type_relation = 'CALLS')""",
)
def g24(spark: SparkSession, d: str) -> DataFrame:
    root = fx.root(spark, d).first()["id"]
    e = fx.edges(spark, d).select("source_id", "target_id", "type_relation", traverse.direction(F.col("source_id"), F.col("target_id"), F.lit(root)).alias("direction"))
    return views.shown(fx.symbols(spark, d), e, ["function", "class", "method"], ["/ws/brand3"], ["outgoing"])[1]


@query("g28_drill_down", "WITH" + fx.EDGES + " SELECT DISTINCT id, path, CAST(start_line AS VARCHAR) AS symbol FROM symbols")
def g28(spark: SparkSession, d: str) -> DataFrame:
    return fx.symbols(spark, d).select("id", views.drill_down(F.col("id")).alias("x")).select("id", "x.path", "x.symbol").distinct()


# Cycles

CYCLES = (
    "WITH RECURSIVE"
    + fx.EDGES
    + """,
calls AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM edges WHERE type_relation <> 'USES'),
walk AS (SELECT src AS a, dst AS b FROM calls UNION SELECT w.a, c.dst FROM walk w JOIN calls c ON c.src = w.b),
cyclic AS (SELECT src, dst FROM calls WHERE EXISTS (SELECT 1 FROM walk WHERE a = dst AND b = src)),
on_cycle AS (SELECT src AS node FROM cyclic UNION SELECT dst FROM cyclic)"""
)


@query("c1_cycle_edges", CYCLES + " SELECT src, dst FROM cyclic")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return cycles.cycle_edges(_calls(spark, d))


@query("c2_cycle_nodes", CYCLES + " SELECT node FROM on_cycle")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return cycles.cycle_nodes(_calls(spark, d))


@query("c3_between_cycle_nodes", CYCLES + " SELECT src, dst FROM calls WHERE src IN (SELECT node FROM on_cycle) AND dst IN (SELECT node FROM on_cycle)")
def c3(spark: SparkSession, d: str) -> DataFrame:
    return cycles.edges_between_cycle_nodes(_calls(spark, d))


@query(
    "c5_cycle_types",
    CYCLES + """,
comp AS (SELECT o.node, least(o.node, min(CASE WHEN p.node IS NOT NULL THEN p.node END)) AS component
  FROM on_cycle o LEFT JOIN on_cycle p ON EXISTS (SELECT 1 FROM walk WHERE a = o.node AND b = p.node) AND EXISTS (SELECT 1 FROM walk WHERE a = p.node AND b = o.node) GROUP BY o.node)
SELECT component, count(*) AS n_nodes, CASE count(*) WHEN 1 THEN 'self-recursive' WHEN 2 THEN 'mutual-recursive' ELSE 'complex' END AS cycle_type FROM comp GROUP BY component""",
)
def c5(spark: SparkSession, d: str) -> DataFrame:
    return cycles.cycle_types(_calls(spark, d))


@query("c1_cycle_edges_dfs")
def c1_dfs(spark: SparkSession, d: str) -> DataFrame:
    return cycles.dfs_cycle_edges(_calls(spark, d))


@query(
    "c6_mark_cycles",
    CYCLES + " SELECT source_id, target_id, type_relation, EXISTS (SELECT 1 FROM cyclic WHERE src = source_id AND dst = target_id) AS is_cyclic FROM edges",
)
def c6(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    cyclic = cycles.cycle_edges(_pairs(e.filter("type_relation <> 'USES'"))).select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"))
    return store.mark_cycles(e, cyclic, e).select("source_id", "target_id", "type_relation", "is_cyclic")


# Upkeep

CHANGED = "path IN (SELECT path FROM symbols WHERE folder IN ('/ws/brand1', '/ws/brand2'))"


def _changed(s: DataFrame) -> DataFrame:
    return s.filter(F.col("folder").isin("/ws/brand1", "/ws/brand2")).select("path").distinct()


@query(
    "e5_upsert",
    "WITH" + fx.EDGES + f""",
old AS (SELECT * FROM symbols WHERE {CHANGED}),
fresh AS (SELECT * FROM old WHERE type <> 'variable'),
added AS (SELECT source_id, target_id, type_relation FROM edges WHERE source_id IN (SELECT id FROM fresh) AND type_relation = 'CALLS')
SELECT source_id, target_id, type_relation FROM edges WHERE source_id NOT IN (SELECT id FROM old)
  AND target_id NOT IN (SELECT id FROM old WHERE id NOT IN (SELECT id FROM fresh))
UNION SELECT source_id, target_id, type_relation FROM added""",
)
def e5(spark: SparkSession, d: str) -> DataFrame:
    s, e = fx.symbols(spark, d), fx.edges(spark, d)
    changed = _changed(s)
    fresh = s.join(changed, "path", "left_semi").filter("type <> 'variable'").select(*s.columns)
    added = e.join(fresh.select(F.col("id").alias("source_id")), "source_id", "left_semi").filter("type_relation = 'CALLS'")
    return store.upsert(s, e, fresh, added, changed)[1].select("source_id", "target_id", "type_relation")


@query("e6_invalidate", "WITH" + fx.EDGES + f" SELECT source_id, target_id, type_relation FROM edges WHERE source_id NOT IN (SELECT id FROM symbols WHERE {CHANGED}) AND target_id NOT IN (SELECT id FROM symbols WHERE {CHANGED})")
def e6(spark: SparkSession, d: str) -> DataFrame:
    s = fx.symbols(spark, d)
    return store.invalidate(s, fx.edges(spark, d), _changed(s))[1].select("source_id", "target_id", "type_relation")


SHARED = "len(list_filter(range(1, least(len(string_split(s.path, '/')), len(string_split(t.path, '/')))), lambda i: string_split(s.path, '/')[1:i] = string_split(t.path, '/')[1:i]))"
RESOLVED = (
    "WITH"
    + fx.STUBS
    + f""",
ranked AS (
  SELECT x.source_id, x.target_name, x.type_relation, t.id AS target_id,
    row_number() OVER (PARTITION BY x.source_id, x.target_name, x.type_relation ORDER BY {SHARED} DESC, t.is_exported DESC, t.indexed_at DESC, t.id) AS n
  FROM stubs x JOIN symbols s ON s.id = x.source_id JOIN symbols t ON t.name = x.target_name AND t.lang = s.lang)"""
)


def _stubs(spark: SparkSession, d: str) -> DataFrame:
    return fx.stub_edges(spark, d)


@query("e7_resolve_stubs", RESOLVED + " SELECT DISTINCT source_id, target_id, type_relation FROM ranked WHERE n = 1")
def e7(spark: SparkSession, d: str) -> DataFrame:
    return store.resolve_stubs(fx.symbols(spark, d), _stubs(spark, d)).select("source_id", "target_id", "type_relation")


@query("e7_counts", RESOLVED + " SELECT (SELECT count(*) FROM stubs) AS before, (SELECT count(*) FROM ranked WHERE n = 1) AS resolved, (SELECT count(*) FROM stubs) - (SELECT count(*) FROM ranked WHERE n = 1) AS deleted")
def e7_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.resolution_counts(fx.symbols(spark, d), _stubs(spark, d))


def _listing(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents")
    return docs.select(F.concat(F.lit("/ws/d"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), F.col("lang"), (F.col("n_chars") % 100).alias("mtime"), F.col("n_chars").alias("size"), "doc_id")


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    labels = fx.table(spark, d, "labels").select("doc_id", "quality")
    rows = _listing(spark, d).join(labels, "doc_id")
    return rows.select("path", "lang", (F.col("mtime") - F.when(F.col("quality") == 0, 1).otherwise(0)).alias("last_modified"), (F.col("doc_id") % 1000).alias("indexed_at"), "size")


LISTING = """
listing AS (SELECT concat('/ws/d', doc_id, '.ts') AS path, lang, n_chars % 100 AS mtime, n_chars AS size, doc_id FROM documents),
files AS (SELECT l.path, l.lang, mtime - CASE WHEN quality = 0 THEN 1 ELSE 0 END AS last_modified, l.doc_id % 1000 AS indexed_at, size FROM listing l JOIN labels USING (doc_id)),
cutoffs(lang, cutoff) AS (VALUES ('en', 100), ('fr', 500))"""


@query("e10_changed_files", "WITH" + LISTING + " SELECT l.path FROM listing l LEFT JOIN files f USING (path) LEFT JOIN cutoffs c ON c.lang = l.lang WHERE f.path IS NULL OR last_modified < mtime OR indexed_at < coalesce(cutoff, 0)")
def e10(spark: SparkSession, d: str) -> DataFrame:
    cutoffs = spark.createDataFrame([("en", 100), ("fr", 500)], "lang string, cutoff long")
    return store.changed_files(_listing(spark, d).select("path", "lang", "mtime"), _indexed(spark, d), cutoffs)


@query("e11_evict", "WITH" + LISTING + " SELECT path FROM files ORDER BY indexed_at, path LIMIT 25")
def e11(spark: SparkSession, d: str) -> DataFrame:
    return store.evicted(_indexed(spark, d), 25)


STATE = (
    LISTING
    + """,
now AS (SELECT path, mtime, size FROM listing WHERE lang <> 'es'),
states AS (SELECT f.path, CASE WHEN n.path IS NULL THEN 'missing' WHEN f.last_modified <> n.mtime OR f.size <> n.size THEN 'stale' END AS state FROM files f LEFT JOIN now n USING (path))"""
)


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _indexed(spark, d).withColumnRenamed("last_modified", "mtime"), _listing(spark, d).filter("lang <> 'es'")


@query("d5_stale", "WITH" + STATE + " SELECT path, state FROM states WHERE state IS NOT NULL")
def d5(spark: SparkSession, d: str) -> DataFrame:
    return store.stale(*_states(spark, d))


@query("d5_validate", "WITH" + STATE + " SELECT count(*) AS total, count(*) FILTER (WHERE state = 'stale') AS stale, count(*) FILTER (WHERE state = 'missing') AS missing, count(state) <= 0.2 * count(*) AS valid FROM states")
def d5_validate(spark: SparkSession, d: str) -> DataFrame:
    return store.validate_index(*_states(spark, d))


@query("d20_dependants", "WITH" + fx.DEPS + f" SELECT DISTINCT source AS path FROM deps WHERE target IN (SELECT path FROM symbols WHERE {CHANGED})")
def d20(spark: SparkSession, d: str) -> DataFrame:
    return store.dependants(fx.deps(spark, d), _changed(fx.symbols(spark, d)))


# Reverse look-up and usage


@query("d2_referencing", "WITH" + fx.DEPS + " SELECT target, source, type, line, module FROM deps WHERE target IN (SELECT path FROM symbols WHERE folder = '/ws/brand1')")
def d2(spark: SparkSession, d: str) -> DataFrame:
    targets = fx.symbols(spark, d).filter("folder = '/ws/brand1'").select("path").distinct()
    return usage.referencing_files(fx.deps(spark, d), targets)


@query("d3_caller_count", "WITH" + fx.DEPS + " SELECT target, count(DISTINCT source) AS n_callers FROM deps GROUP BY target")
def d3(spark: SparkSession, d: str) -> DataFrame:
    return usage.caller_counts(fx.deps(spark, d))


@query("d3_parent_counts", "WITH" + fx.DEPS + " SELECT p.path, c.n AS parent_count FROM (SELECT DISTINCT path FROM symbols) p LEFT JOIN (SELECT target, count(DISTINCT source) AS n FROM deps GROUP BY target) c ON c.target = p.path")
def d3_parents(spark: SparkSession, d: str) -> DataFrame:
    return usage.with_parent_counts(fx.symbols(spark, d).select("path").distinct(), fx.deps(spark, d))


@query("d4_stats", "WITH" + fx.DEPS + " SELECT count(DISTINCT source) AS indexed_files, count(DISTINCT target) AS target_files, count(*) AS total_references FROM deps")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return usage.index_stats(fx.deps(spark, d))


@query("d4_symbol_stats", "WITH" + fx.EDGES + " SELECT count(DISTINCT target_id) AS target_symbols, count(DISTINCT source_id) AS caller_symbols, count(DISTINCT (target_id, source_id)) AS total_references, count(DISTINCT source_path) AS caller_files FROM edges")
def d4_symbols(spark: SparkSession, d: str) -> DataFrame:
    return usage.symbol_stats(fx.symbol_deps(spark, d))


@query("d7_lookup", "WITH" + fx.DEPS + " SELECT target, source, CASE WHEN target LIKE '%.ts' THEN 'index' ELSE 'scan' END AS module FROM deps")
def d7(spark: SparkSession, d: str) -> DataFrame:
    dep = fx.deps(spark, d)
    found = usage.lookup(dep.filter("target LIKE '%.ts'").withColumn("module", F.lit("index")), dep.withColumn("module", F.lit("scan")))
    return found.select("target", "source", "module")


for _mode, _cond in (("runtime", "NOT "), ("type_only", "")):

    def _d9(spark: SparkSession, d: str, mode: str = _mode) -> DataFrame:
        return usage.symbol_callers(fx.symbol_deps(spark, d), mode.replace("_", "-")).select("target_symbol_id", "source_symbol_id")

    query(f"d9_{_mode}_callers", "WITH" + fx.EDGES + f" SELECT DISTINCT target_id AS target_symbol_id, source_id AS source_symbol_id FROM edges WHERE {_cond}(type_relation = 'USES')")(_d9)


@query("d10_dependents", "WITH" + fx.EDGES + " SELECT DISTINCT source_id AS source_symbol_id, source_path FROM edges JOIN root ON target_id = id JOIN symbols s USING (id) WHERE source_path <> s.path")
def d10(spark: SparkSession, d: str) -> DataFrame:
    path, _, name = fx.root(spark, d).first()["id"].partition(":")
    return usage.symbol_dependents(fx.symbol_deps(spark, d), path, name)


@query(
    "d11_incoming",
    "WITH" + fx.EDGES + """,
here AS (SELECT path FROM root JOIN symbols USING (id)),
enter AS (SELECT DISTINCT source_id AS source_symbol_id, target_id AS target_symbol_id, type_relation = 'USES' AS by_symbol FROM edges, here WHERE target_path = path AND source_path <> path)
SELECT source_symbol_id, target_symbol_id, CASE WHEN bool_or(by_symbol) THEN 'symbols' ELSE 'calls' END AS origin FROM enter GROUP BY 1, 2""",
)
def d11(spark: SparkSession, d: str) -> DataFrame:
    path = fx.root(spark, d).first()["id"].partition(":")[0]
    deps = fx.symbol_deps(spark, d)
    return usage.incoming(deps.filter("is_type_only"), deps, path)


UNUSED = (
    "WITH RECURSIVE"
    + fx.EDGES
    + """,
exported AS (SELECT id, path FROM symbols WHERE is_exported),
used AS (
  SELECT DISTINCT target_id AS id FROM edges WHERE source_path <> target_path AND type_relation = 'USES' AND source_path LIKE '%.go' AND target_id IN (SELECT id FROM exported)
  UNION SELECT e.target_id FROM used u JOIN edges e ON e.source_id = u.id AND e.type_relation = 'INHERITS' AND e.source_path LIKE '%.py' AND e.target_id IN (SELECT id FROM exported)),
unused AS (SELECT id, path FROM exported WHERE id NOT IN (SELECT id FROM used))"""
)


def _usage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # Go files use names as types; exports of Python files mention what they inherit
    mentions = fx.edges(spark, d).filter("type_relation = 'INHERITS' AND source_id LIKE '%.py:%'")
    return fx.symbols(spark, d), fx.symbol_deps(spark, d).filter("is_type_only AND source_path LIKE '%.go'"), _pairs(mentions)


@query("d12_unused_exports", UNUSED + " SELECT id, path FROM unused")
def d12(spark: SparkSession, d: str) -> DataFrame:
    return usage.unused_exports(*_usage(spark, d)).select("id", "path")


@query("d14_dead_code", UNUSED + " SELECT path, count(*) AS n_unused, (SELECT count(*) FROM exported e WHERE e.path = unused.path) AS n_exported FROM unused GROUP BY path")
def d14(spark: SparkSession, d: str) -> DataFrame:
    return usage.dead_code(*_usage(spark, d))


USAGE = (
    "WITH"
    + fx.DEPS
    + """,
sd AS (SELECT DISTINCT source_path, target_path FROM edges WHERE type_relation = 'USES'),
flags AS (
  SELECT d.source, d.target, (sd.source_path IS NOT NULL OR d.source LIKE '%.go') AS is_used
  FROM deps d LEFT JOIN sd ON sd.source_path = d.source AND sd.target_path = d.target)"""
)


def _edge_usage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fx.deps(spark, d), fx.symbol_deps(spark, d).filter("is_type_only"), fx.symbols(spark, d).select("path").distinct()


@query("d16_edge_usage", USAGE + " SELECT source, target, is_used FROM flags")
def d16(spark: SparkSession, d: str) -> DataFrame:
    return usage.edge_usage(*_edge_usage(spark, d))


@query("d17_unused_edges", USAGE + " SELECT source, target FROM flags WHERE NOT is_used")
def d17(spark: SparkSession, d: str) -> DataFrame:
    return usage.unused_edges(*_edge_usage(spark, d))


@query("d18_unused_shown", USAGE + " SELECT source, target, NOT is_used AS is_unused FROM flags")
def d18(spark: SparkSession, d: str) -> DataFrame:
    pairs, deps, known = _edge_usage(spark, d)
    return views.unused_shown(pairs.select("source", "target"), usage.unused_edges(pairs, deps, known))


@query("call_order", "WITH" + fx.EDGES + " SELECT source_id, target_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY source_line, target_id) AS INTEGER) AS call_order FROM edges WHERE type_relation = 'CALLS'")
def call_order(spark: SparkSession, d: str) -> DataFrame:
    return usage.call_order(fx.edges(spark, d))


# Signatures


@query(
    "b3_parameters",
    "WITH" + fx.PARAMS + """,
j AS (
  SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.name, n.name) AS name, o.type AS ot, n.type AS nt, o.is_optional AS oo, n.is_optional AS no, o.symbol IS NOT NULL AS h, n.symbol IS NOT NULL AS t
  FROM olds o FULL JOIN news n ON o.symbol = n.symbol AND o.name = n.name WHERE coalesce(o.symbol, n.symbol) IN (SELECT symbol FROM both_sides))
SELECT symbol, 'parameter-removed' AS change, 'error' AS severity, name AS subject, concat(name, ': ', ot) AS old_value, CAST(NULL AS VARCHAR) AS new_value FROM j WHERE h AND NOT t
UNION ALL SELECT symbol, CASE WHEN no THEN 'parameter-added-optional' ELSE 'parameter-added-required' END, CASE WHEN no THEN 'note' ELSE 'error' END, name, NULL, concat(name, ': ', nt) FROM j WHERE t AND NOT h
UNION ALL SELECT symbol, 'parameter-type-changed', 'error', name, ot, nt FROM j WHERE h AND t AND ot <> nt
UNION ALL SELECT symbol, 'parameter-optional-to-required', 'error', name, NULL, NULL FROM j WHERE h AND t AND oo AND NOT no
UNION ALL SELECT o.symbol, 'parameter-order-changed', 'note', CAST(o.position AS VARCHAR), o.name, n.name FROM olds o JOIN news n ON o.symbol = n.symbol AND o.position = n.position WHERE o.name <> n.name""",
)
def b3(spark: SparkSession, d: str) -> DataFrame:
    return diff.parameter_changes(fx.params(spark, d, True), fx.params(spark, d, False), notes=True)


def _orders(spark: SparkSession, d: str, old: bool) -> DataFrame:
    o = fx.table(spark, d, "orders")
    kind = F.element_at(F.array(F.lit("public"), F.lit("protected"), F.lit("private")), ((F.col("o_orderkey") + (0 if old else F.col("o_custkey"))) % 3 + 1).cast("int"))
    shown = kind if old else F.when(F.col("o_custkey") % 10 != 0, kind)
    # low priority was given up, urgent is new
    return o.filter(F.col("o_orderpriority") != ("1-URGENT" if old else "5-LOW")).select(F.col("o_orderkey").alias("symbol"), (F.col("o_orderstatus") if old else F.substring("o_orderpriority", 1, 1)).alias("return_type"), shown.alias("visibility"))


ORDERS = """
o1 AS (SELECT o_orderkey AS symbol, o_orderstatus AS r, ['public', 'protected', 'private'][o_orderkey % 3 + 1] AS v FROM orders WHERE o_orderpriority <> '1-URGENT'),
o2 AS (SELECT o_orderkey AS symbol, substr(o_orderpriority, 1, 1) AS r, CASE WHEN o_custkey % 10 <> 0 THEN ['public', 'protected', 'private'][(o_orderkey + o_custkey) % 3 + 1] END AS v FROM orders WHERE o_orderpriority <> '5-LOW'),
lv(v, n) AS (VALUES ('public', 3), ('protected', 2), ('private', 1))"""


@query(
    "b4_signatures",
    "WITH" + ORDERS + """
SELECT symbol, 'return-type-changed' AS change, 'error' AS severity, CAST(NULL AS VARCHAR) AS subject, o1.r AS old_value, o2.r AS new_value FROM o1 JOIN o2 USING (symbol) WHERE o1.r <> o2.r
UNION ALL SELECT symbol, 'visibility-reduced', 'error', NULL, o1.v, o2.v FROM o1 JOIN o2 USING (symbol) JOIN lv a ON a.v = o1.v JOIN lv b ON b.v = o2.v WHERE b.n < a.n""",
)
def b4(spark: SparkSession, d: str) -> DataFrame:
    return diff.signature_changes(_orders(spark, d, True), _orders(spark, d, False))


@query(
    "b5_interfaces",
    "WITH" + fx.PARAMS + """,
j AS (
  SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.name, n.name) AS subject, o.type AS ot, n.type AS nt, o.is_optional AS oo, n.is_optional AS no, o.symbol IS NOT NULL AS h, n.symbol IS NOT NULL AS t
  FROM olds o FULL JOIN news n ON o.symbol = n.symbol AND o.name = n.name WHERE coalesce(o.symbol, n.symbol) IN (SELECT symbol FROM both_sides))
SELECT symbol, 'member-removed' AS change, 'error' AS severity, subject, ot AS old_value, CAST(NULL AS VARCHAR) AS new_value FROM j WHERE h AND NOT t
UNION ALL SELECT symbol, 'member-optional-to-required', 'error', subject, NULL, nt FROM j WHERE t AND NOT h AND NOT no
UNION ALL SELECT symbol, 'member-type-changed', 'error', subject, ot, nt FROM j WHERE h AND t AND ot <> nt
UNION ALL SELECT symbol, 'member-optional-to-required', 'error', subject, NULL, NULL FROM j WHERE h AND t AND oo AND NOT no""",
)
def b5(spark: SparkSession, d: str) -> DataFrame:
    return diff.interface_changes(fx.params(spark, d, True), fx.params(spark, d, False))


@query(
    "b6_aliases",
    "WITH" + ORDERS + """
SELECT o1.symbol, CASE WHEN o2.symbol IS NULL THEN 'type-alias-removed' ELSE 'type-alias-changed' END AS change, CASE WHEN o2.symbol IS NULL THEN 'error' ELSE 'warning' END AS severity,
  CAST(NULL AS VARCHAR) AS subject, o1.r AS old_value, o2.r AS new_value
FROM o1 LEFT JOIN o2 USING (symbol) WHERE o2.symbol IS NULL OR o1.r <> o2.r""",
)
def b6(spark: SparkSession, d: str) -> DataFrame:
    old, new = (_orders(spark, d, v).select("symbol", F.col("return_type").alias("type")) for v in (True, False))
    return diff.alias_changes(old, new)


@query("b7_removed", "WITH" + ORDERS + " SELECT symbol, 'member-removed' AS change, 'error' AS severity FROM o1 WHERE symbol NOT IN (SELECT symbol FROM o2)")
def b7(spark: SparkSession, d: str) -> DataFrame:
    return diff.removed(_orders(spark, d, True), _orders(spark, d, False)).select("symbol", "change", "severity")


# Text, paths and codec


@query("i2_imports", "WITH" + fx.IMPORTS + " SELECT source, module, min(line) AS line FROM imports GROUP BY 1, 2")
def i2(spark: SparkSession, d: str) -> DataFrame:
    return store.first_of(fx.imports(spark, d), ["source", "module"], F.col("line")).select("source", "module", "line")


@query("s9_scripts", r"SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script\s*[^>]*>', 1), chr(10)) AS script FROM pages")
def s9(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "pages").select("page_id", misc.scripts(F.col("html")).alias("script"))


@query("s12_line_count", r"SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS BIGINT) AS n_lines FROM documents")
def s12(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", misc.line_count(F.col("text")).alias("n_lines"))


@query("s7_language", "WITH" + fx.SYMBOLS + " SELECT lang, lang AS detected, lang AS call_graph, count(*) AS n FROM symbols GROUP BY lang")
def s7(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.symbols(spark, d).select("lang", paths.language(F.col("path")).alias("detected"), paths.call_graph_language(F.col("path")).alias("call_graph"))
    return rows.groupBy("lang", "detected", "call_graph").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s3_source_files",
    r"""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path,
  regexp_matches(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '\.(ts|tsx|js|jsx|vue|svelte|gql|graphql|py|pyi|rs|toml|cs|csproj|go|java|swift)$') AS is_source,
  len(list_intersect(string_split(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/')[1:-2], ['node_modules', '.git', 'dist', 'build', 'out', 'coverage', '.next', '.nuxt', '__pycache__', '.venv', 'venv', 'target'])) > 0 AS is_ignored
FROM pages""",
)
def s3(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))
    return rows.select("page_id", "path", paths.is_source_file(F.col("path")).alias("is_source"), paths.in_ignored_directory(F.col("path")).alias("is_ignored"))


@query(
    "labels",
    "WITH" + fx.SYMBOLS + """,
p AS (SELECT DISTINCT path, regexp_extract(path, '[^/]+$') AS file, string_split(path, '/')[-2] AS parent FROM symbols)
SELECT path, CASE WHEN count(*) OVER (PARTITION BY file) > 1 THEN concat(parent, '/', file) ELSE file END AS label FROM p""",
)
def labels(spark: SparkSession, d: str) -> DataFrame:
    return paths.labels(fx.symbols(spark, d).select("path").distinct())


@query(
    "r2_resolve",
    "WITH"
    + fx.IMPORTS
    + """,
listing AS (SELECT DISTINCT path FROM (
  SELECT concat('/ws/pages', module, CASE WHEN length(module) % 3 = 0 THEN '.ts' WHEN length(module) % 3 = 1 THEN '.py' ELSE '/index.js' END) AS path FROM imports
  UNION ALL SELECT concat('/ws/pages', module, '.js') FROM imports) WHERE NOT contains(path, '//')),
ends(n, e) AS (VALUES (1, ''), (2, '.ts'), (3, '.tsx'), (4, '.js'), (5, '.jsx'), (6, '.py'), (7, '/index.ts'), (8, '/index.tsx'), (9, '/index.js'), (10, '/index.jsx'), (11, '/index.py')),
asked AS (SELECT DISTINCT source, concat('.', module) AS module FROM imports),
tried AS (SELECT source, module, concat('/ws/pages', module[2:], e) AS path, n FROM asked, ends)
SELECT source, module, arg_min(t.path, n) AS target FROM tried t JOIN listing l ON l.path = t.path GROUP BY 1, 2""",
)
def r2(spark: SparkSession, d: str) -> DataFrame:
    links = settled(fx.imports(spark, d).select("source", "module"))
    n = F.length("module") % 3
    end = F.when(n == 0, ".ts").when(n == 1, ".py").otherwise("/index.js")
    base = F.concat(F.lit("/ws/pages"), "module")
    files = links.select(F.concat(base, end).alias("path")).unionByName(links.select(F.concat(base, F.lit(".js")).alias("path"))).filter(~F.col("path").contains("//")).distinct()
    return resolve.relative(links.select("source", F.concat(F.lit("."), "module").alias("module")), files)


@query(
    "r4_nearest_config",
    "WITH" + fx.SYMBOLS + """,
p AS (SELECT DISTINCT path FROM symbols),
configs AS (SELECT '/ws' AS config_dir UNION SELECT DISTINCT folder FROM symbols WHERE length(folder) % 2 = 0)
SELECT p.path, arg_max(config_dir, length(config_dir)) AS config_dir FROM p JOIN configs ON starts_with(p.path, concat(config_dir, '/')) GROUP BY p.path""",
)
def r4(spark: SparkSession, d: str) -> DataFrame:
    s = fx.symbols(spark, d)
    configs = s.filter(F.length("folder") % 2 == 0).select(F.col("folder").alias("config_dir")).distinct().unionByName(spark.createDataFrame([("/ws",)], "config_dir string"))
    return resolve.nearest(s.select("path").distinct(), configs, "/ws")


@query("r14_dependencies", "WITH" + fx.DEPS + " SELECT source_path AS source, target_path AS target, min(source_line) AS line FROM edges GROUP BY 1, 2")
def r14(spark: SparkSession, d: str) -> DataFrame:
    sd = fx.symbol_deps(spark, d)
    imports = sd.select(F.col("source_path").alias("source"), F.col("target_symbol_id").alias("module"), F.lit("import").alias("type"), "line")
    targets = sd.select(F.col("source_path").alias("source"), F.col("target_symbol_id").alias("module"), F.col("target_path").alias("target")).distinct()
    return resolve.dependencies(imports, targets).select("source", "target", "line")


@query("token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", codec.token_estimate(F.col("text")).alias("tokens"))


@query(
    "toon_rows",
    r"""SELECT concat('[', event_id, ',', event_type, ',', replace(replace(replace(replace(replace(props, '\', '\\'), ',', '\,'), '[', '\['), ']', '\]'), '|', '\|'), ',', event_type, '|', CAST(user_id AS VARCHAR), ']') AS line FROM events""",
)
def toon(spark: SparkSession, d: str) -> DataFrame:
    ev = fx.table(spark, d, "events")
    return codec.write_rows(ev.select("event_id", "event_type", "props", F.array("event_type", F.col("user_id").cast("string")).alias("both")))


@query(
    "t1_coalesce",
    "WITH" + fx.CHANGES + """,
w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, CASE event WHEN 'delete' THEN 3 WHEN 'change' THEN 2 ELSE 1 END AS priority FROM changes)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, path, arg_max(event, (priority, seq)) AS event, max(seq) AS last_seq FROM w GROUP BY w.window_start, path""",
)
def t1(spark: SparkSession, d: str) -> DataFrame:
    windowed = fx.changes(spark, d).withColumn("w", F.window("ts", "6 hours").start)
    return feed.coalesce(windowed, ["w", "path"]).select(F.date_format("w", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "path", "event", "last_seq")


@query(
    "a10_clusters",
    "WITH" + fx.SYMBOLS + """,
fs AS (SELECT id, path, name, type, CASE WHEN type = 'method' THEN (SELECT min(c.id) FROM symbols c WHERE c.path = s.path AND c.type = 'class') END AS parent FROM symbols s)
SELECT path AS id, 'namespace' AS type, count(*) AS n_symbols FROM fs WHERE parent IS NULL GROUP BY path
UNION ALL SELECT concat(c.path, ':', c.name), 'class', count(*) FROM fs c JOIN fs m ON m.parent = c.id GROUP BY c.id, c.path, c.name""",
)
def a10(spark: SparkSession, d: str) -> DataFrame:
    return views.clusters(_file_symbols(spark, d)).select("id", "type", F.size("symbol_ids").cast("long").alias("n_symbols"))


def _file_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = fx.symbols(spark, d)
    first = s.filter("type = 'class'").groupBy("path").agg(F.min("id").alias("__class"))
    parent = F.when(F.col("type") == "method", F.col("__class"))
    return s.join(first, "path", "left").select("id", "path", "name", F.col("type").alias("category"), F.col("start_line").alias("line"), "is_exported", parent.alias("parent_symbol_id"))


@query(
    "a12_tree",
    "WITH" + fx.EDGES + """,
fs AS (SELECT id, path, name, type, CASE WHEN type = 'method' THEN (SELECT min(c.id) FROM symbols c WHERE c.path = s.path AND c.type = 'class') END AS parent FROM symbols s),
o AS (SELECT source_id AS id, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS x FROM edges GROUP BY 1),
i AS (SELECT target_id AS id, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS x FROM edges GROUP BY 1)
SELECT fs.id, name, parent, CAST(row_number() OVER (PARTITION BY path, parent ORDER BY type <> 'class', name, fs.id) AS INTEGER) AS rank, coalesce(o.x, '') AS depends_on, coalesce(i.x, '') AS used_by
FROM fs LEFT JOIN o ON o.id = fs.id LEFT JOIN i ON i.id = fs.id""",
)
def a12(spark: SparkSession, d: str) -> DataFrame:
    return views.dependency_tree(_file_symbols(spark, d), fx.symbol_deps(spark, d))


@query(
    "g19_symbol_payload",
    "WITH" + fx.EDGES + """,
here AS (SELECT path FROM root JOIN symbols USING (id)),
fs AS (SELECT id, s.path, CASE WHEN type = 'method' THEN (SELECT min(c.id) FROM symbols c WHERE c.path = s.path AND c.type = 'class') END AS parent FROM symbols s JOIN here ON here.path = s.path)
SELECT coalesce(parent, path) AS source, id AS target, 'contains' AS kind FROM fs
UNION ALL SELECT DISTINCT source_id, target_id, 'uses' FROM edges, here WHERE source_path = path""",
)
def g19(spark: SparkSession, d: str) -> DataFrame:
    path = fx.root(spark, d).first()["id"].partition(":")[0]
    return views.symbol_payload(_file_symbols(spark, d), fx.symbol_deps(spark, d), path)[1]


@query("layout_layered", CRAWL.replace("{hops}", "3") + " SELECT node, CAST(depth * 260 AS DOUBLE) AS x, CAST((row_number() OVER (PARTITION BY depth ORDER BY node) - 1) * 64 AS DOUBLE) AS y FROM nodes")
def layered(spark: SparkSession, d: str) -> DataFrame:
    return misc.layered(traverse.crawl(_deps(spark, d), fx.root_file(spark, d), 2), order="node").select("node", "x", "y")


@query("node_width", "WITH" + fx.SYMBOLS + " SELECT DISTINCT name, CAST(greatest(120, least(300, length(name) * 7 + 24)) AS BIGINT) AS width FROM symbols")
def width(spark: SparkSession, d: str) -> DataFrame:
    return fx.symbols(spark, d).select("name", misc.node_width(F.col("name")).alias("width")).distinct()


# Extraction, from source text that the tables spell out


def _joined(rows: DataFrame, key: list[str], order: str, line: F.Column) -> DataFrame:
    """One text for each key: the lines in order."""
    lines = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("l"))
    return lines.select(*key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def _script_files(spark: SparkSession, d: str) -> DataFrame:
    """A function for each symbol, in a file for each folder; it calls the function of the next key and one that no file defines."""
    s = fx.symbols(spark, d).select(F.concat("folder", F.lit("/all.ts")).alias("path"), "k", "is_exported")
    line = F.concat(F.when(F.col("is_exported"), "export ").otherwise(""), F.lit("function f"), F.col("k").cast("string"), F.lit("() { f"), (F.col("k") + 25).cast("string"), F.lit("(); /* g(); */ none('h()'); }"))
    return _joined(s, ["path"], "k", line).withColumn("lang", F.lit("typescript"))


FUNCTIONS = (
    "WITH"
    + fx.SYMBOLS
    + """,
fs AS (SELECT concat(folder, '/all.ts') AS path, concat('f', k) AS name, CAST(row_number() OVER (PARTITION BY folder ORDER BY k) - 1 AS INTEGER) AS start_line, k, is_exported FROM symbols)"""
)


@query("e1_extract_symbols", FUNCTIONS + " SELECT concat(path, ':', name, ':', start_line) AS id, name, 'function' AS type, path, start_line, is_exported FROM fs")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.extract_call_graph(_script_files(spark, d), "/ws", 0)[0].select("id", "name", "type", "path", "start_line", "is_exported")


@query(
    "e2_extract_edges",
    FUNCTIONS + """
SELECT concat(a.path, ':', a.name, ':', a.start_line) AS source_id, coalesce(b.path || ':' || b.name || ':' || b.start_line, concat('@@external:f', a.k + 25)) AS target_id, 'CALLS' AS type_relation, a.start_line AS source_line
FROM fs a LEFT JOIN fs b ON b.path = a.path AND b.k = a.k + 25
UNION ALL SELECT concat(path, ':', name, ':', start_line), '@@external:none', 'CALLS', start_line FROM fs""",
)
def e2(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.extract_call_graph(_script_files(spark, d), "/ws", 0)[1].select("source_id", "target_id", "type_relation", "source_line")


@query("i1_extract_imports", "WITH" + fx.IMPORTS + " SELECT source, module, 'import' AS type, CAST(min(line) AS BIGINT) AS line FROM imports GROUP BY 1, 2")
def i1(spark: SparkSession, d: str) -> DataFrame:
    links = fx.imports(spark, d)
    line = F.concat(F.lit("import x"), F.col("line").cast("string"), F.lit(' from "'), F.col("module"), F.lit("\"; // import y from 'z'"))
    texts = _joined(links.withColumnRenamed("source", "path"), ["path"], "line", line)
    return imports.extract_imports(texts.withColumn("lang", F.lit("typescript"))).select("source", "module", "type", "line")


@query("b1_signatures", "WITH" + fx.PARAMS + " SELECT concat('s', symbol) AS symbol, concat('p', name) AS name, type, is_optional FROM olds")
def b1(spark: SparkSession, d: str) -> DataFrame:
    p = fx.params(spark, d, True)
    param = F.concat(F.lit("p"), "name", F.when(F.col("is_optional"), "?: ").otherwise(": "), "type")
    per = p.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_list(param)), ", ").alias("list"))
    line = F.concat(F.lit("export function s"), F.col("symbol").cast("string"), F.lit("("), "list", F.lit("): void {}"))
    texts = _joined(per.withColumn("path", F.concat(F.lit("/ws/b"), (F.col("symbol") % 100).cast("string"), F.lit(".ts"))), ["path"], "symbol", line)
    return diff.exploded(signatures.extract_signatures(texts, "old")).select("symbol", "name", "type", "is_optional")
