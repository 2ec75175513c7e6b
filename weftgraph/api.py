"""One object over a workspace's tables, with a method for each question."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.misc import line_count
from .functions.paths import in_ignored_directory, language
from .operators import cycles, diff, resolve, store, traverse, usage, views
from .plans.runtime import settled
from .sources import callgraph, imports, signatures, symbols, workspace
from .streaming import changes as feed


# The edges of which an unused-import analysis is made at most, by profile; custom takes the user's.
PROFILES = {"default": 2000, "low-memory": 1000, "high-performance": 5000, "custom": 2000}


@dataclass
class Config:
    """max_depth: of crawls; exclude_node_modules: bare packages don't resolve; max_dead_code_files: of a dead-code scan.

    profile: default, low-memory, high-performance or custom; it sets
    max_unused_edges (0: no cap) where that isn't given.
    """

    root: str
    max_depth: int = 50
    exclude_node_modules: bool = True
    max_dead_code_files: int = 500
    max_bytes: int = workspace.MAX_BYTES
    profile: str = "default"
    max_unused_edges: int | None = None

    def __post_init__(self) -> None:
        if not self.root:
            raise ValueError("a root is required")
        if self.profile not in PROFILES:
            raise ValueError(f"profile is one of {', '.join(PROFILES)}")
        if self.max_unused_edges is None:
            self.max_unused_edges = PROFILES[self.profile]
        if min(self.max_depth, self.max_dead_code_files, self.max_bytes, self.max_unused_edges) < 0:
            raise ValueError("depths and sizes are 0 or more")


class CodeGraph:
    """Tables of a source tree, extracted once and held as checkpoints; every method returns a DataFrame."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.files: DataFrame | None = None

    # building

    def build_index(self) -> CodeGraph:
        """Reads the tree; files, imports, deps, symbols, edges, file_symbols, symbol_deps and export_graph are there after it."""
        c = self.config
        return self.from_texts(workspace.texts(self.spark, c.root, c.exclude_node_modules, c.max_bytes), self._configs())

    def _configs(self) -> DataFrame:
        c = self.config
        return workspace.configs(self.spark, c.root, c.exclude_node_modules, c.max_bytes)

    def from_texts(self, files: DataFrame, configs: DataFrame | None = None) -> CodeGraph:
        """As build_index, from rows (path, lang, text, size, last_modified); configs (path, text) if they aren't among files."""
        self._read = self._extracted(files)
        self.configs = settled((files if configs is None else configs).filter(F.col("path").rlike(workspace.CONFIG_FILE)).select("path", "text"))
        return self._derive()

    def _extracted(self, files: DataFrame) -> dict[str, DataFrame]:
        """What is read of each file by itself: its record, imports, symbols with references, and symbols with dependencies. Texts aren't kept."""
        now = int(time.time() * 1000)
        record = files.select("path", "lang", "last_modified", F.lit(now).cast("long").alias("indexed_at"), "size", line_count(F.col("text")).alias("n_lines"))
        listed = files.select("path", F.coalesce("lang", language(F.col("path"))).alias("lang"), "text")
        return {
            "files": settled(record),
            "imports": settled(imports.extract_imports(listed).withColumnRenamed("source", "path")),
            "raw": settled(callgraph.extraction(listed).withColumn("indexed_at", F.lit(now).cast("long"))),
            "analysed": settled(symbols.analyse_files(listed)),
        }

    def update(self, again: DataFrame, gone: DataFrame | None = None) -> CodeGraph:
        """Extracts the files in `again` (column path) anew, forgets those in `gone`, and derives all tables from what is known of each file.

        A file in `again` that isn't there any more is forgotten as well. This is
        what a batch of the change feed calls (streaming.changes).
        """
        c = self.config
        again = settled(again.select("path").distinct())
        fresh = self._extracted(workspace.texts(self.spark, c.root, c.exclude_node_modules, c.max_bytes, again))
        out = again if gone is None else again.unionByName(gone.select("path")).distinct()
        self._read = {t: settled(df.join(out, "path", "left_anti").select(*df.columns).unionByName(fresh[t])) for t, df in self._read.items()}
        self.configs = settled(self._configs())
        return self._derive()

    def _derive(self) -> CodeGraph:
        """The tables that look across files."""
        c, root = self.config, self.config.root.split("://", 1)[-1].rstrip("/")
        self.files, raw, analysed = self._read["files"], self._read["raw"], self._read["analysed"]
        self.imports = self._read["imports"].withColumnRenamed("path", "source")
        good, configs = self.imports.filter("error IS NULL"), self.configs
        named = configs.filter(F.col("path").endswith(".json"))
        aliases, packages, modules = (None, None, None) if configs.isEmpty() else (resolve.alias_table(named), resolve.package_table(named), resolve.go_module_table(configs))
        self.targets = settled(resolve.resolve(good, self.files, root, aliases, modules, packages, c.exclude_node_modules))
        self.deps = settled(resolve.dependencies(good.select("source", "module", "type", "line"), self.targets))
        folder = F.regexp_replace("path", "/[^/]*$", "")
        self.symbols = raw.select("path", "lang", "indexed_at", F.explode("symbols").alias("s")).select("s.id", "s.name", "s.type", "lang", "path", folder.alias("folder"), "s.start_line", "s.end_line", "s.start_col", "s.is_exported", "indexed_at")
        self.stub_edges = raw.select("indexed_at", F.explode("edges").alias("e")).select("e.source_id", "e.target_id", "e.type_relation", F.lit(False).alias("is_cyclic"), "e.source_line", "indexed_at")
        self.errors = raw.filter("error IS NOT NULL").select("path", "error")
        self.edges = settled(store.resolve_stubs(self.symbols, self.stub_edges))
        self.file_symbols = symbols.file_symbols(analysed)
        self.symbol_deps = settled(symbols.symbol_deps(analysed, self.targets))
        self.export_graph = symbols.export_graph(analysed)
        return self

    def save(self, folder: str, name: str) -> None:
        workspace.save_snapshot({"files": self.files, "symbols": self.symbols, "edges": self.edges, "deps": self.deps, "symbol_deps": self.symbol_deps, "file_symbols": self.file_symbols, "export_graph": self.export_graph}, folder, name, self.config.root)

    def load(self, folder: str, name: str) -> bool:
        """Whether a snapshot of this root and schema version was there. Its tables answer questions; update() needs an index that was built."""
        found = workspace.load_snapshot(self.spark, folder, name, self.config.root)
        for t, df in (found or {}).items():
            setattr(self, t, df)
        return found is not None

    def validate_index(self) -> DataFrame:
        listed = workspace.listing(self.spark, self.config.root).select("path", F.col("last_modified").alias("mtime"), "size")
        return store.validate_index(self.files.select("path", F.col("last_modified").alias("mtime"), "size"), listed)

    def stale_files(self) -> tuple[DataFrame, DataFrame]:
        """path of files to extract again, and of those that are gone."""
        c = self.config
        listed = workspace.listing(self.spark, c.root, c.exclude_node_modules).select("path", "lang", F.col("last_modified").alias("mtime"))
        return store.changed_files(listed, self.files), self.files.select("path").join(listed.select("path"), "path", "left_anti")

    def reindex_stale(self) -> DataFrame:
        """Extracts files that are new or changed since they were indexed, and forgets those that are gone; path of all of them."""
        again, gone = (settled(x) for x in self.stale_files())
        if not (again.isEmpty() and gone.isEmpty()):
            self.update(again, gone)
        return again.unionByName(gone)

    def file_record(self, path: str) -> DataFrame:
        return store.file_record(self.files, path)

    def follow(self, changes: DataFrame, checkpoint: str, once: bool = False):
        """Keeps the tables up to date with a stream of file events (path, event, seq)."""
        return feed.run(changes, lambda again, gone, _: self.update(again, gone), checkpoint, once=once)

    def saved(self, path: str, symbol_id: str, depth: int = 1) -> DataFrame:
        """The neighbourhood of a symbol after its displayed file was saved: the file is read anew and stubs resolve again."""
        return self.update(self.spark.createDataFrame([(path,)], "path string")).neighbourhood(symbol_id, depth)

    # file graph

    def analyze(self, path: str) -> DataFrame:
        return self.deps.filter(F.col("source") == path)

    def _node(self, path: str) -> DataFrame:
        return self.spark.createDataFrame([(path,)], "node string")

    def _leaf(self) -> Column:
        return in_ignored_directory(F.col("node"))

    def crawl(self, path: str, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
        return traverse.crawl_graph(self.deps, self._node(path), self.config.max_depth if depth is None else depth, self._leaf())

    def crawl_from(self, path: str, known: DataFrame, extra_depth: int = 10) -> DataFrame:
        return traverse.crawl_from(self.deps, self._node(path), known, extra_depth)

    def answer(self, path: str, depth: int | None = None) -> dict[str, DataFrame]:
        """A file's graph in parts that are computed when they are used: nodes and edges first, then which edges aren't used, then the lines of each node."""
        nodes, edges = self.crawl(path, depth)
        unused = self.unused_edges()[0].join(edges, ["source", "target"], "left_semi")
        lines = nodes.join(self.files.select(F.col("path").alias("node"), "n_lines"), "node", "left").select("node", "n_lines")
        return {"nodes": nodes, "edges": edges, "unused": unused, "lines": lines}

    def referencing_files(self, path: str) -> DataFrame:
        return usage.referencing_files(self.deps, self.spark.createDataFrame([(path,)], "path string"))

    def caller_count(self) -> DataFrame:
        return usage.caller_counts(self.deps)

    def stats(self) -> DataFrame:
        return usage.index_stats(self.deps)

    def verify_usage_batch(self) -> DataFrame:
        return usage.edge_usage(self.deps, self.symbol_deps, self.file_symbols.select("path").distinct())

    def unused_edges(self) -> tuple[DataFrame, bool]:
        """source, target of imports that aren't used, and whether there were too many edges to tell."""
        cap = self.config.max_unused_edges
        known = self.file_symbols.select("path").distinct()
        return usage.unused_edges(self.deps, self.symbol_deps, known, cap), usage.over_cap(self.deps, cap)

    def scan_references(self, files: DataFrame, path: str) -> DataFrame:
        """What refers to a file, from texts (path, lang, text) beside the index, as for a partial one."""
        root = self.config.root.split("://", 1)[-1].rstrip("/")
        listing = self.files.select("path").unionByName(files.select("path")).distinct()
        return usage.scan_references(files, self.spark.createDataFrame([(path,)], "path string"), lambda found: resolve.resolve(found, listing, root))

    def verify_usage(self, source: str, target: str) -> DataFrame:
        return self.verify_usage_batch().filter((F.col("source") == source) & (F.col("target") == target))

    def file_cycles(self) -> DataFrame:
        return cycles.cycle_edges(self.deps.select(F.col("source").alias("src"), F.col("target").alias("dst")))

    # symbols

    def symbol_graph(self, path: str) -> tuple[DataFrame, DataFrame]:
        return views.symbol_payload(self.file_symbols, self.symbol_deps, path)

    def unused_symbols(self, path: str | None = None) -> DataFrame:
        out = usage.unused_exports(self.file_symbols, self.symbol_deps, self.export_graph)
        return out if path is None else out.filter(F.col("path") == path)

    def scan_dead_code(self) -> DataFrame:
        return usage.dead_code(self.file_symbols, self.symbol_deps, self.export_graph, self.config.max_dead_code_files)

    def symbol_dependents(self, path: str, name: str) -> DataFrame:
        return usage.symbol_dependents(self.symbol_deps, path, name)

    def trace(self, symbol_id: str, max_depth: int = 10) -> DataFrame:
        pairs = self.symbol_deps.select(F.col("source_symbol_id").alias("src"), F.col("target_symbol_id").alias("dst"))
        return traverse.trace_rows(pairs, self._node(symbol_id), self.file_symbols.select("id", "path"), max_depth)

    # call graph

    def neighbourhood(self, symbol_id: str, depth: int = 1) -> DataFrame:
        return traverse.neighbourhood(self.symbols, self.edges, symbol_id, traverse.clamp_depth(depth))

    def external_callers(self, path: str, names: list[str], limit: int = 50) -> DataFrame:
        return usage.external_callers(self.symbols, self.edges, path, names, limit)

    def symbol_at(self, path: str, line: int) -> DataFrame:
        return views.symbols_at(self.symbols, self.spark.createDataFrame([(path, line)], "path string, line int"))

    def breaking_changes(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Between two versions of files (path, text)."""
        a, b = (signatures.extract_signatures(x, v) for x, v in ((old, "old"), (new, "new")))
        return diff.compare(settled(a), settled(b))
