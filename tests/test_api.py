"""The facade on a tree that changes: resolution through configs, updates, the change feed, snapshots."""

import os
import time

import pytest

from weftgraph.api import CodeGraph, Config
from weftgraph.sources import workspace

FILES = {
    "web/tsconfig.json": '{"extends": "../base.json", "compilerOptions": {"paths": {"@lib/*": ["./lib/*"]}}}',
    "base.json": "{}",
    "web/main.ts": "import { a } from '@lib/a';\nimport { p } from '@s/pkg';\nimport { r } from './rel';\nexport function run() { a(); p(); r(); }\n",
    "web/lib/a.ts": "export function a() { }\n",
    "web/rel.ts": "import { a } from './lib/a';\nexport function r() { a(); }\n",
    "pkg/package.json": '{"name": "@s/pkg", "main": "./index.js"}',
    "pkg/src/index.ts": "export function p() { }\n",
    "srv/go.mod": "module h.org/srv\n",
    "srv/main.go": 'package main\nimport "h.org/srv/util"\nfunc main() { util.Do() }\n',
    "srv/util/util.go": "package util\nfunc Do() { }\n",
}


def put(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "ws")
    for name, text in FILES.items():
        put(root, name, text)
    return root


def pairs(g, root):
    return {(r.source[len(root) + 1 :], r.target[len(root) + 1 :]) for r in g.deps.collect()}


WANT = {("web/main.ts", "web/lib/a.ts"), ("web/main.ts", "pkg/src/index.ts"), ("web/main.ts", "web/rel.ts"), ("web/rel.ts", "web/lib/a.ts"), ("srv/main.go", "srv/util/util.go")}


def test_resolution_through_configs(spark, tree):
    assert pairs(CodeGraph(spark, Config(tree)).build_index(), tree) == WANT


def test_stale_files_are_extracted_again(spark, tree):
    g = CodeGraph(spark, Config(tree)).build_index()
    assert g.reindex_stale().count() == 0
    time.sleep(1.1)
    put(tree, "web/rel.ts", "import { p } from '@s/pkg';\nexport function r2() { p(); }\n")
    put(tree, "web/new.ts", "import { r2 } from './rel';\nr2();\n")
    os.remove(os.path.join(tree, "srv/util/util.go"))
    assert {os.path.basename(r.path) for r in g.reindex_stale().collect()} == {"rel.ts", "new.ts", "util.go"}
    assert pairs(g, tree) == (WANT - {("web/rel.ts", "web/lib/a.ts"), ("srv/main.go", "srv/util/util.go")}) | {("web/rel.ts", "pkg/src/index.ts"), ("web/new.ts", "web/rel.ts")}
    names = {r.name for r in g.symbols.collect()}
    assert "r2" in names and not names & {"r", "Do"}
    fresh = CodeGraph(spark, Config(tree)).build_index()
    for table, key in (("symbols", "id"), ("edges", "source_id"), ("file_symbols", "id")):
        rows = [{tuple(v for k, v in r.asDict().items() if k != "indexed_at") for r in getattr(x, table).collect()} for x in (g, fresh)]
        assert rows[0] == rows[1], (table, key)
    assert g.reindex_stale().count() == 0
    assert g.file_record(f"{tree}/web/new.ts").count() == 1


def test_change_feed_keeps_the_tables(spark, tree, tmp_path):
    g = CodeGraph(spark, Config(tree)).build_index()
    put(tree, "web/rel.ts", "export function r() { }\n")
    os.remove(os.path.join(tree, "pkg/src/index.ts"))
    events = [(f"{tree}/web/rel.ts", "create", 1), (f"{tree}/web/rel.ts", "change", 2), (f"{tree}/pkg/src/index.ts", "change", 3), (f"{tree}/pkg/src/index.ts", "delete", 4)]
    spark.createDataFrame(events, "path string, event string, seq long").write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema("path string, event string, seq long").parquet(str(tmp_path / "feed"))
    g.follow(stream, str(tmp_path / "state"), once=True).awaitTermination()
    assert pairs(g, tree) == WANT - {("web/rel.ts", "web/lib/a.ts"), ("web/main.ts", "pkg/src/index.ts")}


def test_saved_file_refreshes_its_neighbourhood(spark, tree):
    g = CodeGraph(spark, Config(tree)).build_index()
    put(tree, "web/lib/a.ts", "export function a() { b(); }\nfunction b() { }\n")
    found = g.saved(f"{tree}/web/lib/a.ts", f"{tree}/web/lib/a.ts:a:0")
    assert (f"{tree}/web/lib/a.ts:a:0", f"{tree}/web/lib/a.ts:b:1") in {(r.source_id, r.target_id) for r in found.collect()}


def test_a_crash_leaves_the_last_snapshot(spark, tree, tmp_path):
    g = CodeGraph(spark, Config(tree)).build_index()
    folder = str(tmp_path / "snap")
    g.save(folder, "index")
    n = g.symbols.count()
    # a later version of which only a table was written
    g.symbols.limit(1).write.parquet(f"{folder}/index/v99999999999999999999/symbols")
    again = CodeGraph(spark, Config(tree))
    assert again.load(folder, "index") and again.symbols.count() == n
    g.save(folder, "index")
    assert again.load(folder, "index") and again.symbols.count() == n
    assert workspace.snapshot_mb(spark, folder, "index") > 0
    assert len([x for x in os.listdir(f"{folder}/index") if os.path.isdir(f"{folder}/index/{x}/metadata")]) == 1


def test_profiles_and_caps(spark, tree):
    assert Config(tree, profile="low-memory").max_unused_edges == 1000
    with pytest.raises(ValueError):
        Config(tree, profile="none")
    g = CodeGraph(spark, Config(tree, profile="custom", max_unused_edges=2)).build_index()
    rows, cut = g.unused_edges()
    assert cut and rows.count() == 0
    g.config.max_unused_edges = 0
    rows, cut = g.unused_edges()
    assert not cut


def test_scan_and_trace(spark, tree):
    g = CodeGraph(spark, Config(tree)).build_index()
    files = workspace.texts(spark, tree).select("path", "lang", "text")
    assert {r.source for r in g.scan_references(files, f"{tree}/web/lib/a.ts").collect()} == {f"{tree}/web/rel.ts"}
    rows = g.trace(f"{tree}/web/main.ts:run", 1).collect()
    assert {r.resolved for r in rows} == {f"{tree}/web/lib/a.ts", f"{tree}/pkg/src/index.ts", f"{tree}/web/rel.ts"}
    assert {r.max_depth_reached for r in rows} == {True}
    assert {r.max_depth_reached for r in g.trace(f"{tree}/web/main.ts:run", 3).collect()} == {False}


def test_answer_in_phases(spark, tree):
    put(tree, "web/main.ts", FILES["web/main.ts"].replace("p(); ", ""))
    found = CodeGraph(spark, Config(tree)).build_index().answer(f"{tree}/web/main.ts")
    name = lambda p: p[len(tree) + 1 :]
    assert {name(r.node): r.n_lines for r in found["lines"].collect()} == {"web/main.ts": 4, "web/lib/a.ts": 1, "pkg/src/index.ts": 1, "web/rel.ts": 2}
    assert {(name(r.source), name(r.target)) for r in found["unused"].collect()} == {("web/main.ts", "pkg/src/index.ts")}
    assert found["edges"].count() == 4 and found["nodes"].count() == 4
