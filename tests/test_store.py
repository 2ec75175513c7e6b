"""Upkeep, usage, signatures, views and the change feed on hand-made tables."""

from weftgraph.operators import diff, store, usage, views
from weftgraph.streaming import changes

EDGE = "source_id string, target_id string, type_relation string, source_line int"
SYMBOL = "id string, name string, lang string, path string, is_exported boolean, indexed_at long"


def edges(spark, *rows):
    return spark.createDataFrame([(*r, "CALLS", 1)[:4] if len(r) == 2 else (*r, 1)[:4] for r in rows], EDGE)


def symbols(spark, *ids):
    return spark.createDataFrame([(i, i.split(":")[1], "typescript", i.split(":")[0], False, 0) for i in ids], SYMBOL)


def test_reindex_with_shift(spark, rows):
    old, new = symbols(spark, "/f:g:1", "/m:main:0"), symbols(spark, "/f:g:2")
    e = edges(spark, ("/m:main:0", "/f:g:1"), ("/f:g:1", "/m:main:0"))
    path = spark.createDataFrame([("/f",)], "path string")
    s, kept = store.upsert(old, e, new, edges(spark, ("/f:g:2", "/m:main:0")), path)
    assert rows(s, "id") == {("/f:g:2",), ("/m:main:0",)}
    assert rows(kept, "source_id", "target_id") == {("/f:g:2", "/m:main:0")}
    _, linked = store.upsert(old, e, new, edges(spark, ("/f:g:2", "/m:main:0")), path, relink=True)
    assert rows(linked, "source_id", "target_id") == {("/f:g:2", "/m:main:0"), ("/m:main:0", "/f:g:2")}


def test_upsert_keeps_edges_to_symbols_that_stay_and_is_idempotent(spark, rows):
    s, e = symbols(spark, "/f:g:1", "/m:main:0"), edges(spark, ("/m:main:0", "/f:g:1"), ("/f:g:1", "/m:main:0"))
    path = spark.createDataFrame([("/f",)], "path string")
    new = edges(spark, ("/f:g:1", "/f:g:1"))
    s1, e1 = store.upsert(s, e, symbols(spark, "/f:g:1"), new, path)
    assert rows(e1, "source_id", "target_id") == {("/m:main:0", "/f:g:1"), ("/f:g:1", "/f:g:1")}
    s2, e2 = store.upsert(s1, e1, symbols(spark, "/f:g:1"), new, path)
    assert rows(e2) == rows(e1) and rows(s2.select(*s.columns)) == rows(s1.select(*s.columns))


def test_invalidate(spark, rows):
    s, e = store.invalidate(symbols(spark, "/f:g:1", "/m:a:0", "/m:b:1"), edges(spark, ("/m:a:0", "/f:g:1"), ("/f:g:1", "/m:a:0"), ("/m:a:0", "/m:b:1")), spark.createDataFrame([("/f",)], "path string"))
    assert rows(e, "source_id", "target_id") == {("/m:a:0", "/m:b:1")}
    assert rows(s, "path", "name") == {("/m", "a"), ("/m", "b")}


def test_stub_goes_to_the_nearest_then_exported_then_latest(spark, rows):
    s = spark.createDataFrame(
        [
            ("c1", "c", "typescript", "/p/q/c.ts", False, 0),
            ("n", "f", "typescript", "/p/q/n.ts", False, 0),
            ("far", "f", "typescript", "/p/r/n.ts", True, 9),
            ("py", "f", "python", "/p/q/n.py", True, 9),
            ("e1", "g", "typescript", "/z/1.ts", False, 9),
            ("e2", "g", "typescript", "/z/2.ts", True, 1),
            ("e3", "g", "typescript", "/z/3.ts", True, 2),
            ("e4", "g", "typescript", "/z/4.ts", True, 2),
        ],
        SYMBOL,
    )
    e = edges(spark, ("c1", "@@external:f"), ("c1", "@@external:g"), ("c1", "@@external:none"), ("c1", "n"))
    assert rows(store.resolve_stubs(s, e), "source_id", "target_id") == {("c1", "n"), ("c1", "e3")}
    assert tuple(store.resolution_counts(s, e).first()) == (3, 2, 1)
    assert rows(store.unresolved(s, e), "target_id") == {("@@external:none",)}


def test_marking_ignores_the_relation_and_resets(spark, rows):
    e = spark.createDataFrame([("a", "b", "CALLS", False), ("a", "b", "USES", False), ("c", "d", "CALLS", True), ("x", "y", "CALLS", True)], "source_id string, target_id string, type_relation string, is_cyclic boolean")
    marked = store.mark_cycles(e, spark.createDataFrame([("a", "b")], "source_id string, target_id string"), spark.createDataFrame([("a",), ("c",)], "source_id string"))
    assert rows(marked, "source_id", "type_relation", "is_cyclic") == {("a", "CALLS", True), ("a", "USES", True), ("c", "CALLS", False), ("x", "CALLS", True)}


def test_staleness(spark, rows):
    listing = spark.createDataFrame([("new", "go", 5), ("same", "go", 5), ("old", "go", 6), ("rules", "swift", 5)], "path string, lang string, mtime long")
    files = spark.createDataFrame([("same", 5, 10), ("old", 5, 10), ("rules", 5, 10)], "path string, last_modified long, indexed_at long")
    cut = spark.createDataFrame([("swift", 11)], "lang string, cutoff long")
    assert rows(store.changed_files(listing, files, cut)) == {("new",), ("old",), ("rules",)}
    kind = "path string, mtime double, size long"
    hashes, now = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1), ("c", 1.0, 1)], kind), spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 2)], kind)
    assert rows(store.stale(hashes, now)) == {("b", "stale"), ("c", "missing")}
    assert store.validate_index(hashes, now).first()["valid"] is False


def test_eviction(spark, rows):
    f = spark.createDataFrame([("a", 3), ("b", 1), ("c", 1)], "path string, indexed_at long")
    assert rows(store.evicted(f, 2)) == {("b",), ("c",)}
    assert [store.eviction_size(*x) for x in ((100, 10), (100, 300), (5, 300), (0, 300), (101, 300))] == [0, 10, 1, 0, 11]


def test_deleting_a_file_finds_its_importers(spark, rows):
    d = spark.createDataFrame([("a", "x"), ("b", "y")], "source string, target string")
    assert rows(store.dependants(d, spark.createDataFrame([("x",)], "path string"))) == {("a",)}


DEP = "source string, target string, type string, line int, module string"


def test_reverse_index(spark, rows):
    d = spark.createDataFrame([("a", "x", "import", 1, "m"), ("a", "x", "import", 3, "n"), ("b", "x", "export", 2, "m"), ("b", None, "import", 4, "q")], DEP)
    assert rows(usage.referencing_files(d, spark.createDataFrame([("x",)], "path string"))) == {("x", "a", "import", 3, "n"), ("x", "b", "export", 2, "m")}
    assert rows(usage.caller_counts(d)) == {("x", 2)}
    assert tuple(usage.index_stats(d).first()) == (2, 1, 2)


SYM_DEP = "source_symbol_id string, source_path string, target_symbol_id string, target_path string, is_type_only boolean, line int"


def test_runtime_and_type_only_callers(spark, rows):
    d = spark.createDataFrame([("a:f", "a", "x:g", "x", True, 1), ("a:f", "a", "x:g", "x", False, 2), ("b:h", "b", "x:g", "x", True, 1), ("c:i", "c", "x:g", "x", None, 1)], SYM_DEP)
    assert rows(usage.symbol_callers(d, "runtime"), "source_symbol_id") == {("a:f",), ("c:i",)}
    assert rows(usage.symbol_callers(d, "type-only"), "source_symbol_id") == {("b:h",)}
    assert rows(usage.symbol_dependents(d, "x", "g"), "source_path") == {("a",), ("b",), ("c",)}


def test_unused_exports_close_over_mentions(spark, rows):
    s = spark.createDataFrame([("x:f", "x.ts", True), ("x:g", "x.ts", True), ("x:h", "x.ts", True), ("x:p", "x.ts", False)], "id string, path string, is_exported boolean")
    d = spark.createDataFrame([("a:q", "a.ts", "x:f", "x.ts", False, 1), ("x:p", "x.ts", "x:h", "x.ts", False, 1)], SYM_DEP)
    g = spark.createDataFrame([("x:f", "x:g")], "src string, dst string")
    assert rows(usage.unused_exports(s, d, g), "id") == {("x:h",)}
    assert rows(usage.dead_code(s, d, g)) == {("x.ts", 1, 3)}


def test_usage_rules(spark, rows):
    p = spark.createDataFrame([("a.ts", "/n/node_modules/q/i.ts"), ("a.go", "b.go"), ("a.ts", "b.ts"), ("a.ts", "c.ts"), ("z.ts", "c.ts")], "source string, target string")
    d = spark.createDataFrame([("a:f", "a.ts", "b:g", "b.ts", False, 1)], SYM_DEP)
    known = spark.createDataFrame([("a.ts",)], "path string")
    assert rows(usage.unused_edges(p, d, known)) == {("a.ts", "c.ts")}
    assert usage.unused_edges(p, d, known, cap=2).count() == 0
    shown = views.unused_shown(p, usage.unused_edges(p, d, known), "hide")
    assert shown.count() == 4


def test_call_order_breaks_ties_by_target(spark, rows):
    e = spark.createDataFrame([("s", "a", "CALLS", 30), ("s", "b", "CALLS", 10), ("s", "c", "CALLS", 20), ("s", "d", "CALLS", 20), ("s", "e", "USES", 1)], EDGE)
    assert rows(usage.call_order(e)) == {("s", "b", 1), ("s", "c", 2), ("s", "d", 3), ("s", "a", 4)}


PARAM = "symbol string, name string, type string, is_optional boolean, has_default boolean, position int"


def test_parameters(spark, rows):
    old = spark.createDataFrame([("f", "p", "A", False, False, 0), ("f", "t", "A", False, False, 1), ("f", "o", "A", True, False, 2), ("gone", "x", "A", False, False, 0)], PARAM)
    new = spark.createDataFrame([("f", "t", "B", False, False, 0), ("f", "o", "A", False, False, 1), ("f", "q", "C", False, False, 2), ("f", "r", "C", False, True, 3)], PARAM)
    found = rows(diff.parameter_changes(old, new, notes=True), "change", "severity", "subject", "old_value", "new_value")
    assert found == {
        ("parameter-removed", "error", "p", "p: A", None),
        ("parameter-type-changed", "error", "t", "A", "B"),
        ("parameter-optional-to-required", "error", "o", None, None),
        ("parameter-added-required", "error", "q", None, "q: C"),
        ("parameter-added-optional", "note", "r", None, "r: C"),
        ("parameter-order-changed", "note", "0", "p", "t"),
        ("parameter-order-changed", "note", "1", "t", "o"),
        ("parameter-order-changed", "note", "2", "o", "q"),
    }


def test_signatures_interfaces_aliases(spark, rows):
    kind = "symbol string, return_type string, visibility string"
    old = spark.createDataFrame([("f", "A", "public"), ("g", "A", None), ("h", "A", "private"), ("i", "A", "public")], kind)
    new = spark.createDataFrame([("f", "B", "protected"), ("g", "A", "private"), ("h", "A", "public"), ("j", "A", "public")], kind)
    assert rows(diff.signature_changes(old, new), "symbol", "change") == {("f", "return-type-changed"), ("f", "visibility-reduced")}
    assert rows(diff.removed(old, new), "symbol") == {("i",)}
    member = "symbol string, name string, type string, is_optional boolean"
    a = spark.createDataFrame([("I", "x", "A", True), ("I", "y", "A", False)], member)
    b = spark.createDataFrame([("I", "x", "A", False), ("I", "z", "A", False), ("I", "w", "A", True)], member)
    assert rows(diff.interface_changes(a, b), "change", "subject", "new_value") == {("member-optional-to-required", "x", None), ("member-optional-to-required", "z", "A"), ("member-removed", "y", None)}
    t = "symbol string, type string"
    assert rows(diff.alias_changes(spark.createDataFrame([("T", "A"), ("U", "A")], t), spark.createDataFrame([("T", "B")], t)), "symbol", "severity") == {("T", "warning"), ("U", "error")}


def test_symbol_at_line(spark, rows):
    s = spark.createDataFrame([("a", "f", 0, 200), ("b", "f", 60, 70), ("c", "g", 5, 5)], "id string, path string, start_line int, end_line int")
    at = spark.createDataFrame([("f", 65), ("f", 100), ("f", 300), ("g", 1), ("none", 1)], "path string, line int")
    assert rows(views.symbols_at(s, at)) == {("f", 65, "b"), ("f", 100, "a"), ("f", 300, "a"), ("g", 1, "c")}


def test_merge_filter_and_legend(spark, rows):
    a = spark.createDataFrame([("x", "l")], "id string, label string")
    b = spark.createDataFrame([("x", "r"), ("y", "r")], "id string, label string")
    assert rows(views.merge_nodes(a, b)) == {("x", "r"), ("y", "r")}
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    assert rows(views.filter_to(e, spark.createDataFrame([("a",)], "path string"), spark.createDataFrame([("b",)], "path string"))) == {("a", "b")}
    assert views.filter_to(e, spark.createDataFrame([], "path string")).count() == 0
    assert rows(views.expand_all(e, "m")) == {("a",), ("b",), ("m",)}
    n = spark.createDataFrame([("p", "/w", "class"), ("q", "/w/sub", "class"), ("r", "/v", "method")], "id string, folder string, type string")
    g = spark.createDataFrame([("p", "r", "USES", "outgoing"), ("p", "p", "CALLS", "outgoing"), ("r", "p", "CALLS", "lateral")], "source_id string, target_id string, type_relation string, direction string")
    assert rows(views.shown(n, g, hidden_directions=["outgoing"])[1], "type_relation", "direction") == {("USES", "outgoing"), ("CALLS", "lateral")}
    assert rows(views.shown(n, g, hidden_folders=["/w"])[0], "id") == {("r",)}


def test_clusters(spark, rows):
    s = spark.createDataFrame([("f:A", "f", "A", "class", None), ("f:A.m", "f", "A.m", "function", "f:A"), ("f:B", "f", "B", "class", None)], "id string, path string, name string, category string, parent_symbol_id string")
    found = {r.id: (r.type, list(r.symbol_ids), list(r.child_ids)) for r in views.clusters(s).collect()}
    assert found == {"f": ("namespace", ["f:A", "f:B"], ["f:A"]), "f:A": ("class", ["f:A.m"], [])}


CHANGE = "seq long, path string, event string"


def test_events_coalesce_by_priority(spark, rows):
    c = spark.createDataFrame([(1, "p", "create"), (2, "p", "change"), (3, "p", "delete"), (4, "p", "change"), (5, "q", "create"), (6, "q", "odd")], CHANGE)
    assert rows(changes.coalesce(c)) == {("p", "delete", 4), ("q", "create", 5)}


def test_stream_applies_each_batch(spark, rows, tmp_path):
    spark.createDataFrame([(1, "p", "create"), (2, "p", "delete"), (3, "q", "change")], CHANGE).write.parquet(str(tmp_path / "feed"))
    seen = []
    stream = spark.readStream.schema(CHANGE).parquet(str(tmp_path / "feed"))
    q = changes.run(stream, lambda again, gone, n: seen.append((rows(again), rows(gone))), str(tmp_path / "state"), once=True)
    q.awaitTermination(120)
    assert seen == [({("q",)}, {("p",)})]


def test_debounce_by_event_time(spark, rows, tmp_path):
    c = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP'2024-01-01 00:00:00.000', 'p', 'create'), (2L, TIMESTAMP'2024-01-01 00:00:00.200', 'p', 'change'), (3L, TIMESTAMP'2024-01-01 00:00:01', 'p', 'change') AS t(seq, ts, path, event)")
    assert rows(changes.debounced(c), "path", "event", "last_seq") == {("p", "change", 2), ("p", "change", 3)}
