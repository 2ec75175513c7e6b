"""Paths, codec, extraction and resolution."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.api import CodeGraph, Config
from weftgraph.functions import codec, misc, paths
from weftgraph.operators import resolve
from weftgraph.sources import callgraph, imports, signatures, symbols, workspace


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.select(f(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_normalize(spark):
    assert values(spark, paths.normalize, "C:\\a\\\\b\\", "/a//b/", "/", "c:/", "", "a") == ["c:/a/b", "/a/b", "/", "c:/", "", "a"]


def test_names(spark):
    assert values(spark, paths.file_name, "/a/b.ts", "b.ts", "/a/b/", "c:\\x\\y.py", "") == ["b.ts", "b.ts", "b", "y.py", ""]
    assert values(spark, paths.language, "/a/b.TS", ".py", "rs", "x/y", "/a/b.vue", "q.csproj/r") == ["typescript", "python", "rust", "unknown", "vue", "unknown"]
    assert values(spark, paths.call_graph_language, "/a/b.js", "/a/b.csproj", "/a/b.swift") == ["typescript", None, "swift"]
    assert values(spark, lambda c: paths.relative(c, "/w"), "/w/a/b", "/w", "/wx/a", "/v") == ["a/b", "", "/wx/a", "/v"]
    assert values(spark, paths.in_ignored_directory, "/a/dist/x.ts", "/a/dist", "/a/b/c.ts") == [True, False, False]
    assert values(spark, paths.in_skipped_directory, "a/.x/b.ts", "a/b.ts", ".x.ts") == [True, False, False]
    assert values(spark, paths.is_external_package, "react", "./a", "/a", "a/b", "node_modules/x", "x.ts", "", "@s/p") == [True, False, False, False, True, False, False, False]
    assert values(spark, lambda c: paths.module_path(c, "/w"), "/w/a/b.py", "/w/c.tsx") == ["a.b", "c"]
    assert values(spark, paths.path_of_symbol, "/a/b.ts:f:3", "c:/a.ts:f", "/a") == ["/a/b.ts", "c:/a.ts", "/a"]
    assert values(spark, paths.ancestors, "/a/b/c.ts", "x") == [["/a/b", "/a", ""], []]
    assert values(spark, lambda c: paths.shared_segments(c, F.lit("/a/b/x.ts")), "/a/b/y.ts", "/a/c/y.ts", "/z.ts") == [3, 2, 1]


def test_measures(spark):
    assert values(spark, misc.line_count, "a\nb\n", "a", "", None, "a\r\nb", "\n") == [2, 1, 0, 0, 2, 1]
    assert values(spark, misc.scripts, "<script>a</script><p><SCRIPT lang='ts'>b\nc</script >", "x") == ["a\nb\nc", ""]
    assert values(spark, codec.token_estimate, "", "abcd", "abcde") == [0, 1, 2]
    assert values(spark, lambda c: misc.error(c, F.lit("boom"))["code"], "ENOENT", "EPERM", "EFBIG", None) == ["FILE_NOT_FOUND", "PERMISSION_DENIED", "FILE_TOO_LARGE", "UNKNOWN"]
    assert values(spark, misc.category, "ArrowFunction", "EnumDeclaration", "Odd") == ["function", "variable", "other"]


def test_codec_round_trip(spark):
    df = spark.sql("SELECT 'a,b' AS file, array('x', 'y|z') AS deps, 3 AS n, true AS ok, named_struct('k', 1) AS o, CAST(NULL AS STRING) AS nothing")
    lines = [r[0] for r in codec.write_rows(df).collect()]
    text = "\n".join([codec.header(df.columns, "rows"), *lines])
    assert text == 'rows(file,deps,n,ok,o,nothing)\n[a\\,b,x|y\\|z,3,true,{"k":1},]'
    assert codec.parse(text) == [{"file": "a,b", "deps": ["x", "y|z"], "n": 3, "ok": True, "o": {"k": 1}, "nothing": ""}]


def test_codec_losses():
    assert codec.parse("d(a,b)\n[x,]") == [{"a": "x", "b": ""}]
    assert codec.parse("d()\n") == []
    for bad in ("", "d", "d(a)\nx", "d(a)\n[1,2]"):
        with pytest.raises(ValueError):
            codec.parse(bad)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab,|[]\\ \u00e9", min_size=1, max_size=8), min_size=2, max_size=4))
def test_codec_arrays_of_strings(items):
    def esc(x):
        for s in codec.SPECIAL:
            x = x.replace(s, "\\" + s)
        return x

    assert codec._split("|".join(map(esc, items)), "|") == [esc(x) for x in items]


SCRIPT = """import { x as y } from './b';
import D from "d";
import 'side';
// import q from 'no'
const s = "import z from 'neither'";
export * from './ex';
const r = require("d");
export async function f() { return import('./dyn'); }
"""


def test_script_imports():
    found = {m: (k, n) for m, k, n in imports.of_file("/a.ts", "typescript", SCRIPT)}
    assert found["./b"] == ("import", 1) and found["d"] == ("import", 2) and found["./ex"] == ("export", 6) and found["./dyn"] == ("dynamic", 8)
    assert "side" not in found and "no" not in found


@pytest.mark.parametrize(
    ("path", "lang", "text", "want"),
    [
        ("/a.py", "python", "import os\nimport a.b as c\nfrom ..x import y\nfrom . import z\n", [("os", 1), ("..x", 3), (".", 4)]),
        ("/a.rs", "rust", "use std::io::{self, Read};\nmod inner;\nmod body {}\nextern crate serde;\nuse Foo;\n", [("std::io", 1), ("inner", 2), ("serde", 4)]),
        ("/a.go", "go", 'import (\n "fmt"\n x "github.com/a/b"\n)\nimport "os"\n', [("fmt", 2), ("github.com/a/b", 3), ("os", 5)]),
        ("/A.java", "java", "import java.util.List;\nimport static a.B.*;\n", [("java.util.List", 1), ("a.B.*", 2)]),
        ("/A.cs", "csharp", "using System;\nusing Al = X.Y;\nusing (var f = 1) {}\n", [("System", 1), ("Al", 2)]),
        ("/a.swift", "swift", "import Foundation\n@testable import Mod\nimport Foundation\n", [("Foundation", 1), ("Mod", 2)]),
        ("/a.gql", None, '#import "./f.gql"\n', [("./f.gql", 1)]),
        ("/a.vue", "typescript", "<template/><script>import a from './a'</script>", [("./a", 1)]),
    ],
)
def test_imports_of_other_languages(path, lang, text, want):
    assert [(m, n) for m, _, n in imports.of_file(path, lang, text)] == want


def test_import_errors_are_rows(spark, rows):
    f = spark.createDataFrame([("/a.py", "python", "def ("), ("/b.py", "python", "import os"), ("/c.py", "python", None)], "path string, lang string, text string")
    found = imports.extract_imports(f).collect()
    assert {(r.source, r.module, r.error is None) for r in found} == {("/a.py", None, False), ("/b.py", "os", True)}


def graph(path, lang, text):
    s, e = callgraph.extract(path, lang, text)
    name = lambda i: i.removeprefix("@@external:") if i.startswith("@@") else i.split(":")[1]
    return {(x[1], x[2]) for x in s}, {(name(a), name(b), r) for a, b, r, _ in e}


def test_typescript_call_graph():
    s, e = graph("/a.ts", "typescript", "function f(a: Bar) { h(); o.m(); o.g(); }\nconst g = (q: number) => f(q);\nclass K extends n.Base implements I { run() { this.run2(); } run2() { new K(); } }\ninterface I { x: string }\n")
    assert s == {("f", "function"), ("g", "variable"), ("K", "class"), ("run", "method"), ("run2", "method"), ("I", "interface")}
    assert {("f", "h", "CALLS"), ("f", "g", "CALLS"), ("f", "Bar", "USES"), ("g", "f", "CALLS"), ("K", "Base", "INHERITS"), ("K", "I", "IMPLEMENTS"), ("run", "run2", "CALLS"), ("run2", "K", "CALLS")} <= e
    assert not any(t == "m" for _, t, _ in e)


def test_call_graphs_of_other_languages():
    s, e = graph("/a.py", "python", "class A(B):\n def run(self):\n  return h(os.x)\ndef h(x):\n  return ext(x)\nh(1)\n")
    assert s == {("A", "class"), ("run", "function"), ("h", "function")}
    assert e == {("A", "B", "INHERITS"), ("run", "h", "CALLS"), ("run", "os", "USES"), ("h", "ext", "CALLS")}
    s, e = graph("/a.go", "go", "func main() {\n fmt.Println(h(1))\n}\nfunc (s *S) Do() { h(2) }\nfunc h(i int) int { return i }\ntype S struct { Base }\n")
    assert {("main", "function"), ("Do", "method"), ("h", "function"), ("S", "class")} == s
    assert {("main", "Println", "CALLS"), ("main", "h", "CALLS"), ("Do", "h", "CALLS"), ("S", "Base", "INHERITS")} <= e
    s, e = graph("/a.rs", "rust", "pub struct S;\nimpl Show for S { fn fmt(&self) { h(); self.x.go(); } }\nfn h() {}\ntrait T {}\n")
    assert s == {("S", "class"), ("fmt", "function"), ("h", "function"), ("T", "interface")}
    assert ("fmt", "h", "CALLS") in e and not any(t == "go" for _, t, _ in e)
    s, e = graph("/A.java", "java", "public class A extends B implements I {\n  public void run(int x) { init(); }\n  void init() { f.go(); }\n}\n")
    assert s == {("A", "class"), ("run", "function"), ("init", "function")}
    assert {("A", "B", "INHERITS"), ("A", "I", "IMPLEMENTS"), ("run", "init", "CALLS"), ("init", "go", "CALLS")} <= e
    s, e = graph("/A.cs", "csharp", "class A : B {\n  public int P { get; set; }\n  void Run() { Go(); x.Other(); }\n}\n")
    assert s == {("A", "class"), ("P", "variable"), ("Run", "function")}
    assert {("A", "B", "INHERITS"), ("A", "B", "IMPLEMENTS"), ("Run", "Go", "CALLS")} <= e
    s, e = graph("/a.swift", "swift", "class A: P {\n  func run(x: Thing) { h() }\n}\nprotocol P {}\nfunc h() {}\n")
    assert s == {("A", "class"), ("run", "function"), ("P", "interface"), ("h", "function")}
    assert {("A", "P", "INHERITS"), ("run", "Thing", "USES"), ("run", "h", "CALLS")} <= e


def test_symbols_and_dependencies():
    s, d = symbols.analyse("/a.ts", "typescript", "import { x as y, type Z } from './b';\nexport class K { m(q: Z) { return y(); } }\nfunction p() { return new K(); }\ny();\n")
    assert [(r["name"], r["is_exported"], r["parent_symbol_id"]) for r in s] == [("K", True, None), ("K.m", True, "/a.ts:K"), ("p", False, None)]
    found = {(r["source_symbol_id"].split(":")[1], r["module"], r["target_name"], r["is_type_only"]) for r in d}
    assert {("K.m", "./b", "x", False), ("K.m", "./b", "Z", True), ("p", None, "K", False), ("(file)", "./b", "x", False)} <= found
    s, _ = symbols.analyse("/a.swift", "swift", "private func a() {}\nfunc b() {}\nstruct S {}\n")
    assert {(r["name"], r["is_exported"]) for r in s} == {("a", False), ("b", True), ("S", True)}


def test_signatures_of_sources():
    text = "export function f(a: A, b?: string, c = 3, ...r: number[]): Map<string, Z> { return g(a); }\nclass K { constructor(private readonly x: string) {} private async run(n: { a: number }): Promise<void> {} }\nconst h = (q: number): T => 1;\n"
    found = {s["symbol"]: s for s in signatures.signatures(text)}
    assert [(p["name"], p["type"], p["is_optional"], p["has_default"], p["is_rest"]) for p in found["f"]["params"]] == [("a", "A", False, False, False), ("b", "string", True, False, False), ("c", "number", True, True, False), ("r", "number[]", False, False, True)]
    assert (found["f"]["return_type"], found["K.run"]["return_type"], found["K.run"]["visibility"], found["K.run"]["is_async"], found["h"]["return_type"]) == ("Map<string, Z>", "Promise<void>", "private", True, "T")
    assert found["K.constructor"]["return_type"] == "K"
    assert [(m["name"], m["type"], m["is_optional"]) for m in signatures.interface_members("interface I { a: string; readonly b?: number }")] == [("a", "string", False), ("b", "number", True)]
    assert signatures.type_aliases("type T = { q: A } | string;")[0]["type"] == "{ q: A } | string"


def listing(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def asked(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source string, module string")


def targets(df):
    return {(r.source, r.module): r.target for r in df.collect()}


def test_relative_order_of_candidates(spark):
    files = listing(spark, "/w/b.ts", "/w/b.js", "/w/c/index.ts", "/w/d", "/w/d.ts", "/v/e.py")
    got = targets(resolve.relative(asked(spark, ("/w/a.ts", "./b"), ("/w/a.ts", "./c"), ("/w/a.ts", "./d"), ("/w/x/a.ts", "../../v/e"), ("/w/a.ts", "./no"), ("/w/a.ts", "bare")), files))
    assert got == {("/w/a.ts", "./b"): "/w/b.ts", ("/w/a.ts", "./c"): "/w/c/index.ts", ("/w/a.ts", "./d"): "/w/d", ("/w/x/a.ts", "../../v/e"): "/v/e.py"}


def test_aliases_inherit_and_the_nearest_config_wins(spark):
    configs = spark.createDataFrame(
        [
            ("/w/tsconfig.json", '{ // c\n "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["*"], "@lib": ["lib/main"]},} }'),
            ("/w/p/tsconfig.json", '{"extends": "../tsconfig.json", "compilerOptions": {"paths": {"~/*": ["./q/*"]}}}'),
            ("/w/n/package.json", '{"imports": {"#x/*": {"import": "./i/*", "default": "./d/*"}}}'),
        ],
        "path string, text string",
    )
    a = resolve.alias_table(configs)
    files = listing(spark, "/w/src/u.ts", "/w/src/lib/main.ts", "/w/p/q/v.ts", "/w/n/d/z.js")
    got = targets(resolve.by_alias(asked(spark, ("/w/a.ts", "@/u"), ("/w/p/a.ts", "@lib"), ("/w/p/a.ts", "~/v"), ("/w/n/a.ts", "#x/z"), ("/w/a.ts", "~/v")), files, a, "/w"))
    assert got == {("/w/a.ts", "@/u"): "/w/src/u.ts", ("/w/p/a.ts", "@lib"): "/w/src/lib/main.ts", ("/w/p/a.ts", "~/v"): "/w/p/q/v.ts", ("/w/n/a.ts", "#x/z"): "/w/n/d/z.js"}


def test_rules_of_languages(spark):
    files = listing(spark, "/w/a/m.py", "/w/k/__init__.py", "/w/a/b/x.py", "/w/src/foo.rs", "/w/bar/mod.rs", "/w/util/a_test.go", "/w/util/b.go", "/w/com/x/A.java", "/w/lib/B.java", "/w/Data/Models/U.cs", "/w/Sources/Kit/K.swift")
    q = asked(
        spark, ("/w/a/b/s.py", "..m"), ("/w/a/b/s.py", "k"), ("/w/a/b/s.py", ".x"), ("/w/src/s.rs", "crate::bar"), ("/w/src/s.rs", "foo"), ("/w/src/s.rs", "std::io"), ("/w/src/s.rs", "super::bar"),
        ("/w/s.go", "ex.org/m/util"), ("/w/s.go", "fmt"), ("/w/s.go", "other.org/z/util"), ("/w/S.java", "com.x.A"), ("/w/S.java", "q.B"), ("/w/S.java", "java.util.List"),
        ("/w/S.cs", "App.Data.Models"), ("/w/S.cs", "System.IO"), ("/w/t/s.swift", "Kit"), ("/w/t/s.swift", "Foundation"),
    )
    mods = spark.createDataFrame([("/w", "ex.org/m")], "config_dir string, module_name string")
    got = targets(resolve.resolve(q, files, "/w", go_modules=mods))
    assert got == {
        ("/w/a/b/s.py", "..m"): "/w/a/m.py", ("/w/a/b/s.py", "k"): "/w/k/__init__.py", ("/w/a/b/s.py", ".x"): "/w/a/b/x.py", ("/w/src/s.rs", "crate::bar"): "/w/bar/mod.rs",
        ("/w/src/s.rs", "foo"): "/w/src/foo.rs", ("/w/src/s.rs", "super::bar"): "/w/bar/mod.rs", ("/w/s.go", "ex.org/m/util"): "/w/util/b.go", ("/w/s.go", "other.org/z/util"): "/w/util/b.go",
        ("/w/S.java", "com.x.A"): "/w/com/x/A.java", ("/w/S.java", "q.B"): "/w/lib/B.java", ("/w/S.cs", "App.Data.Models"): "/w/Data/Models/U.cs", ("/w/t/s.swift", "Kit"): "/w/Sources/Kit/K.swift",
    }


def test_a_workspace_from_end_to_end(spark, rows, tmp_path):
    tree = {
        "a.ts": "import { b } from './b';\nexport function a() { return b(); }\n",
        "b.ts": "export function b() { return c(); }\nexport function unused() {}\nfunction c() { return 1; }\n",
        "node_modules/x/i.ts": "export const q = 1;",
        ".hidden/h.ts": "export const h = 1;",
        "note.txt": "no",
        "m.py": "def broken(:\n",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    root = str(tmp_path)
    assert rows(workspace.listing(spark, root), "path") == {(f"{root}/{n}",) for n in ("a.ts", "b.ts", "m.py")}
    g = CodeGraph(spark, Config(root)).build_index()
    assert rows(g.deps, "source", "target") == {(f"{root}/a.ts", f"{root}/b.ts")}
    assert rows(g.edges, "source_id", "target_id") == {(f"{root}/a.ts:a:1", f"{root}/b.ts:b:0"), (f"{root}/b.ts:b:0", f"{root}/b.ts:c:2")}
    assert rows(g.errors, "path") == {(f"{root}/m.py",)}
    assert rows(g.unused_symbols(f"{root}/b.ts"), "name") == {("unused",)}
    assert g.neighbourhood(f"{root}/a.ts:a:1", 5).count() == 2
    assert rows(g.external_callers(f"{root}/b.ts", ["b"]), "caller_name") == {("a",)}
    assert rows(g.trace(f"{root}/a.ts:a"), "called") == {(f"{root}/b.ts:b",), (f"{root}/b.ts:c",)}
    assert g.verify_usage(f"{root}/a.ts", f"{root}/b.ts").first()["is_used"]
    assert g.validate_index().first()["valid"] and g.reindex_stale().count() == 0
    g.save(f"{root}/snap", "v1")
    again = CodeGraph(spark, Config(root))
    assert again.load(f"{root}/snap", "v1") and again.edges.count() == 2
    assert not CodeGraph(spark, Config("/other")).load(f"{root}/snap", "v1")
    assert not again.load(f"{root}/snap", "v2")


def test_parameters_are_checked():
    for bad in ({"root": ""}, {"root": "/w", "max_depth": -1}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_build_index_reads_configs(spark, rows, tmp_path):
    tree = {
        "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["lib/*"]}}}',
        "a.ts": "import { b } from '@lib/b';\nimport { p } from '@co/pack';\n",
        "lib/b.ts": "export const b = 1;\n",
        "packages/pack/package.json": '{"name": "@co/pack", "main": "./entry.ts"}',
        "packages/pack/entry.ts": "export const p = 1;\n",
        "go/go.mod": "module ex.org/m\n\ngo 1.22\n",
        "go/s.go": 'package s\n\nimport "ex.org/m/deep/er/than/three/util"\n',
        "go/deep/er/than/three/util/u.go": "package util\n",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    root = str(tmp_path)
    g = CodeGraph(spark, Config(root)).build_index()
    assert rows(g.deps, "source", "target") == {(f"{root}/{a}", f"{root}/{b}") for a, b in (("a.ts", "lib/b.ts"), ("a.ts", "packages/pack/entry.ts"), ("go/s.go", "go/deep/er/than/three/util/u.go"))}


def test_go_resolves_by_directory_without_modules(spark, rows, tmp_path):
    for name, text in {"s.go": 'package s\n\nimport "ex.org/z/util"\n', "util/u.go": "package util\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    g = CodeGraph(spark, Config(str(tmp_path))).build_index()
    assert rows(g.deps, "source", "target") == {(f"{tmp_path}/s.go", f"{tmp_path}/util/u.go")}
