"""Code graphs derived from the star-schema tables, as DataFrames and as the same SQL.

part gives symbols, neighbouring lines of an order give edges between them, pages
give imports, events a change feed, orders and lines two versions of signatures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("function", "class", "method", "interface", "type", "variable")
RELATIONS = ("CALLS", "INHERITS", "IMPLEMENTS", "USES")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choice(n, values) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    brand, kind, n = F.lower(F.replace("p_brand", F.lit("#"))), F.lower("p_type"), F.length("p_type") % 3
    rows = part.select(
        F.concat(F.lit("/ws/"), brand, F.lit("/"), kind, _choice(n, (".ts", ".py", ".go"))).alias("path"),
        F.concat(F.lit("/ws/"), brand).alias("folder"),
        F.col("p_name").alias("name"),
        _choice(F.col("p_partkey") % 6, TYPES).alias("type"),
        _choice(n, ("typescript", "python", "go")).alias("lang"),
        F.col("p_partkey").cast("int").alias("start_line"),
        (F.col("p_partkey") + F.col("p_size")).cast("int").alias("end_line"),
        F.lit(0).alias("start_col"),
        (F.col("p_partkey") % 3 == 0).alias("is_exported"),
        (F.lit(1_700_000_000_000) + F.col("p_partkey") % 50).alias("indexed_at"),
        F.col("p_partkey").alias("k"),
    )
    return rows.withColumn("id", F.concat_ws(":", "path", "name", F.col("start_line").cast("string")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("tk"))
    pairs = lines.join(after, ["l_orderkey", "l_linenumber"]).groupBy(F.col("l_partkey").alias("sk"), "tk").agg(F.min("l_orderkey").cast("int").alias("source_line"))
    ids = symbols(spark, sf_dir).select("k", "id")
    named = pairs.join(ids.select(F.col("k").alias("sk"), F.col("id").alias("source_id")), "sk").join(ids.select(F.col("k").alias("tk"), F.col("id").alias("target_id")), "tk")
    return named.select("source_id", "target_id", _choice((F.col("sk") + F.col("tk")) % 4, RELATIONS).alias("type_relation"), F.lit(False).alias("is_cyclic"), "source_line", F.lit(1_700_000_000_000).alias("indexed_at"))


def stub_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = symbols(spark, sf_dir).select(F.col("id").alias("target_id"), "name")
    out = edges(spark, sf_dir).join(names, "target_id").withColumn("target_id", F.concat(F.lit("@@external:"), "name"))
    return out.groupBy("source_id", "target_id", "type_relation").agg(F.min("source_line").alias("source_line"))


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File dependencies: source, target, type, line, module."""
    path = symbols(spark, sf_dir).select("id", "path")
    e = edges(spark, sf_dir).join(path.select(F.col("id").alias("source_id"), F.col("path").alias("source")), "source_id").join(path.select(F.col("id").alias("target_id"), F.col("path").alias("target")), "target_id")
    return e.filter("source <> target").groupBy("source", "target").agg(F.min("source_line").alias("line")).select("source", "target", F.lit("import").alias("type"), "line", F.concat(F.lit("m"), "target").alias("module"))


def symbol_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = symbols(spark, sf_dir).select("id", "path")
    return (
        edges(spark, sf_dir)
        .join(path.select(F.col("id").alias("source_id"), F.col("path").alias("source_path")), "source_id")
        .join(path.select(F.col("id").alias("target_id"), F.col("path").alias("target_path")), "target_id")
        .select(F.col("source_id").alias("source_symbol_id"), "source_path", F.col("target_id").alias("target_symbol_id"), "target_path", (F.col("type_relation") == "USES").alias("is_type_only"), F.col("source_line").alias("line"))
    )


def root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol with the most edges, of least id: one row, column id."""
    e = edges(spark, sf_dir)
    ends = e.select(F.col("source_id").alias("id")).unionByName(e.select(F.col("target_id").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "id").limit(1).select("id")


def root_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file with the fewest targets above one, of least path: one row, column node."""
    d = deps(spark, sf_dir)
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("n", "source").limit(1).select(F.col("source").alias("node"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as imports: source, module, line."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "module"))
    return links.select(F.concat(F.lit("/ws/pages/"), F.col("page_id").cast("string"), F.lit(".ts")).alias("source"), "module", (F.col("pos") + 1).alias("line"))


def params(spark: SparkSession, sf_dir: str, old: bool) -> DataFrame:
    """Parameters of one version: symbol (order), name (part), type, is_optional, has_default, position."""
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3" if old else "l_linenumber >= 2")
    return lines.groupBy(F.col("l_orderkey").alias("symbol"), F.col("l_partkey").cast("string").alias("name")).agg(
        F.min("l_returnflag").alias("type"), (F.min("l_linestatus") == "O").alias("is_optional"), F.lit(False).alias("has_default"), F.min("l_linenumber").alias("position")
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, path, event."""
    event = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("change")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", F.concat(F.lit("/ws/u"), F.col("user_id").cast("string"), F.lit(".ts")).alias("path"), event.alias("event"))


SYMBOLS = """
sym0 AS (
  SELECT concat('/ws/', lower(replace(p_brand, '#', '')), '/', lower(p_type), ['.ts', '.py', '.go'][length(p_type) % 3 + 1]) AS path,
    concat('/ws/', lower(replace(p_brand, '#', ''))) AS folder, p_name AS name,
    ['function', 'class', 'method', 'interface', 'type', 'variable'][p_partkey % 6 + 1] AS type,
    ['typescript', 'python', 'go'][length(p_type) % 3 + 1] AS lang,
    CAST(p_partkey AS INTEGER) AS start_line, CAST(p_partkey + p_size AS INTEGER) AS end_line,
    p_partkey % 3 = 0 AS is_exported, 1700000000000 + p_partkey % 50 AS indexed_at, p_partkey AS k
  FROM part),
symbols AS (SELECT *, concat(path, ':', name, ':', start_line) AS id FROM sym0)"""

EDGES = (
    SYMBOLS
    + """,
edges AS (
  SELECT s.id AS source_id, t.id AS target_id, ['CALLS', 'INHERITS', 'IMPLEMENTS', 'USES'][(sk + tk) % 4 + 1] AS type_relation,
    source_line, s.path AS source_path, t.path AS target_path, t.name AS target_name
  FROM (
    SELECT a.l_partkey AS sk, b.l_partkey AS tk, CAST(min(a.l_orderkey) AS INTEGER) AS source_line
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
    GROUP BY 1, 2) p
  JOIN symbols s ON s.k = sk JOIN symbols t ON t.k = tk),
root AS (
  SELECT id FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id ORDER BY count(*) DESC, id LIMIT 1)"""
)

STUBS = (
    EDGES
    + """,
stubs AS (SELECT source_id, type_relation, target_name, min(source_line) AS source_line FROM edges GROUP BY ALL)"""
)

DEPS = (
    EDGES
    + """,
deps AS (
  SELECT source_path AS source, target_path AS target, 'import' AS type, min(source_line) AS line, concat('m', target_path) AS module
  FROM edges WHERE source_path <> target_path GROUP BY 1, 2),
start AS (SELECT source AS node FROM deps GROUP BY source HAVING count(*) > 1 ORDER BY count(*), source LIMIT 1)"""
)

CHANGES = """
changes AS (
  SELECT event_id AS seq, ts, concat('/ws/u', user_id, '.ts') AS path,
    CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'change' END AS event FROM events)"""

PARAMS = """
olds AS (
  SELECT l_orderkey AS symbol, CAST(l_partkey AS VARCHAR) AS name, min(l_returnflag) AS type, min(l_linestatus) = 'O' AS is_optional, min(l_linenumber) AS position
  FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2),
news AS (
  SELECT l_orderkey AS symbol, CAST(l_partkey AS VARCHAR) AS name, min(l_returnflag) AS type, min(l_linestatus) = 'O' AS is_optional, min(l_linenumber) AS position
  FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1, 2),
both_sides AS (SELECT symbol FROM olds INTERSECT SELECT symbol FROM news)"""

IMPORTS = """
links AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages),
imports AS (
  SELECT concat('/ws/pages/', page_id, '.ts') AS source, unnest(hrefs) AS module, CAST(unnest(range(1, len(hrefs) + 1)) AS INTEGER) AS line FROM links)"""
