"""Registered queries that read source text in each language, written out from the tables, and resolve what it imports.

Every symbol of the fixtures gives one line, in which {k} is its key; a file holds
the lines of a folder. The SQL says what such a line defines and refers to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, misc, paths
from ..operators import resolve, store, traverse, usage, views
from ..sources import callgraph, imports, signatures, symbols, workspace
from ..streaming import changes as feed
from . import fixtures as fx
from .queries import query
from .runtime import ensure_checkpoint_dir, settled


def filled(template: str, **values: Column) -> Column:
    """The template with the values in the place of their names in braces; {{ and }} are braces."""
    parts, rest = [], template
    while rest:
        at = rest.find("{")
        name = rest[at + 1 : rest.find("}", at)] if at >= 0 else ""
        if at < 0:
            parts.append(F.lit(rest))
            break
        if name in values:
            parts += [F.lit(rest[:at]), values[name]]
            rest = rest[at + len(name) + 2 :]
        else:
            parts.append(F.lit(rest[: at + 1]))
            rest = rest[at + 1 :]
    return F.concat(*parts)


def source_files(spark: SparkSession, d: str, ending: str, lang: str | None, template: str, head: str = "") -> DataFrame:
    """path, lang, text: a file for each folder, a line for each of its symbols by key."""
    s = fx.symbols(spark, d).select(F.concat("folder", F.lit("/all" + ending)).alias("path"), "k", "is_exported")
    line = filled(template, k=F.col("k").cast("string"), j=(F.col("k") + 25).cast("string"))
    lines = s.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return lines.select("path", F.lit(lang).cast("string").alias("lang"), F.concat(F.lit(head), text).alias("text"))


def lines_sql(ending: str, more: str = "") -> str:
    """path, k, n (the line's number from 0), is_exported of the lines of source_files."""
    return "WITH" + fx.SYMBOLS + f""",
ls AS (SELECT concat(folder, '/all{ending}') AS path, folder, k, CAST(row_number() OVER (PARTITION BY folder ORDER BY k) - 1 AS INTEGER) AS n, is_exported FROM symbols){more}
"""


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


# Definitions and references by language: template, definitions (name before the key, kind), references (from, to, 1 if in the file, 2 if the name has no key, relation)

CALL_GRAPHS = {
    "typescript": (
        ".ts",
        "export class C{k} extends B{k} implements I{k} { private m{k}(x: T{k}): void { f{k}(); this.n{k}(); } n{k}() { new V{k}(); } } interface J{k} { a: W{k}; } type A{k} = X{k} | Y{k}; const v{k} = (x: Z{k}) => g{k}(x); /* h{k}(); */ function u{k}() { return 'i{k}()'; }",
        [("C", "class"), ("m", "method"), ("n", "method"), ("J", "interface"), ("A", "type"), ("v", "variable"), ("u", "function")],
        [("C", "B", 0, "INHERITS"), ("C", "I", 0, "IMPLEMENTS"), ("C", "I", 0, "USES"), ("m", "T", 0, "USES"), ("m", "f", 0, "CALLS"), ("m", "n", 1, "CALLS"), ("n", "V", 0, "CALLS"), ("J", "W", 0, "USES"), ("A", "X", 0, "USES"), ("A", "Y", 0, "USES"), ("v", "Z", 0, "USES"), ("v", "g", 0, "CALLS")],
    ),
    "rust": (
        ".rs",
        "pub struct S{k} { a: T{k} } enum E{k} { A } trait R{k} { } type L{k} = S{k}; fn m{k}(x: &U{k}) -> W{k} { f{k}(); x.g{k}(); S{k}::h{k}(); m{k}() } // i{k}();",
        [("S", "class"), ("E", "class"), ("R", "interface"), ("L", "type"), ("m", "function")],
        [("S", "T", 0, "USES"), ("m", "U", 0, "USES"), ("m", "W", 0, "USES"), ("m", "f", 0, "CALLS"), ("m", "h", 0, "CALLS"), ("m", "m", 1, "CALLS")],
    ),
    "go": (
        ".go",
        "func F{k}(a A{k}) *U{k} { g{k}(); pkg.H{k}(); return nil }; /* i{k}() */ type S{k} struct { T{k} }; type I{k} interface { }; type N{k} S{k}",
        [("F", "function"), ("S", "class"), ("I", "interface"), ("N", "type")],
        [("F", "A", 0, "USES"), ("F", "U", 0, "USES"), ("F", "g", 0, "CALLS"), ("F", "H", 0, "CALLS"), ("S", "T", 0, "INHERITS"), ("N", "S", 1, "USES")],
    ),
    "java": (
        ".java",
        "public class C{k} extends B{k} implements I{k}, J{k} { private T{k} a; void m{k}(U{k} x) { f{k}(); x.g{k}(); new V{k}(); } } interface K{k} { } enum E{k} { A } // h{k}();",
        [("C", "class"), ("m", "function"), ("K", "interface"), ("E", "type")],
        [("C", "B", 0, "INHERITS"), ("C", "B", 0, "USES"), ("C", "I", 0, "IMPLEMENTS"), ("C", "I", 0, "USES"), ("C", "J", 0, "IMPLEMENTS"), ("C", "T", 0, "USES"), ("m", "U", 0, "USES"), ("m", "f", 0, "CALLS"), ("m", "g", 0, "CALLS"), ("m", "V", 0, "CALLS"), ("m", "V", 0, "USES")],
    ),
    "csharp": (
        ".cs",
        "public class C{k} : B{k} { public int P{k} { get; set; } void M{k}(T{k} x) { F{k}(); } } interface I{k} { } struct S{k} { } // h{k}();",
        [("C", "class"), ("P", "variable"), ("M", "function"), ("I", "interface"), ("S", "class")],
        [("C", "B", 0, "INHERITS"), ("C", "B", 0, "IMPLEMENTS"), ("C", "B", 0, "USES"), ("M", "T", 0, "USES"), ("M", "F", 0, "CALLS"), ("M", "F", 0, "USES"), ("M", "x", 2, "USES")],
    ),
    "swift": (
        ".swift",
        "class C{k}: B{k}, P{k} { func m{k}(x: T{k}) -> U{k} { f{k}(); x.g{k}() } } protocol Q{k} { } struct S{k} { var a: W{k} } typealias A{k} = S{k} // h{k}()",
        [("C", "class"), ("m", "function"), ("Q", "interface"), ("S", "class"), ("A", "type")],
        [("C", "B", 0, "INHERITS"), ("C", "B", 0, "USES"), ("C", "P", 0, "INHERITS"), ("m", "T", 0, "USES"), ("m", "U", 0, "USES"), ("m", "f", 0, "CALLS"), ("S", "W", 0, "USES")],
    ),
    "python": (
        ".py",
        "class C{k}(B{k}, mod{k}.D{k}): m{k} = lambda self: (f{k}(), self.g{k}(), C{k}()) # h{k}()",
        [("C", "class")],
        [("C", "B", 0, "INHERITS"), ("C", "D", 0, "INHERITS"), ("C", "mod", 0, "USES"), ("C", "f", 0, "CALLS"), ("C", "C", 1, "CALLS"), ("C", "self", 2, "USES")],
    ),
}


def _call_graph(lang: str) -> None:
    ending, template, defs, refs = CALL_GRAPHS[lang]
    sql = lines_sql(ending, f""",
defs(a, kind) AS (VALUES {values(defs)}),
refs(a, b, own, relation) AS (VALUES {values(refs)})""") + """
SELECT concat(path, ':', a, k, ':', n) AS a, concat(a, k) AS b, kind, n AS line FROM ls, defs
UNION ALL SELECT concat(path, ':', a, k, ':', n), CASE own WHEN 1 THEN concat(path, ':', b, k, ':', n) WHEN 0 THEN concat('@@external:', b, k) ELSE concat('@@external:', b) END, relation, n FROM ls, refs"""

    @query(f"e4_{lang}", sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = settled(callgraph.extraction(source_files(spark, d, ending, lang, template)))
        found = out.select(F.inline("symbols")).select(F.col("id").alias("a"), F.col("name").alias("b"), F.col("type").alias("kind"), F.col("start_line").alias("line"))
        return found.unionByName(out.select(F.inline("edges")).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("type_relation").alias("kind"), F.col("source_line").alias("line")))


for _lang in CALL_GRAPHS:
    _call_graph(_lang)

# Imports by language: template, and the modules it names with their type

IMPORTS = {
    "i2_import_patterns": (
        ".ts", "typescript",
        "import a{k} from 'm{k}'; export * from 'e{k}'; export { b } from './f{k}'; const c{k} = require('r{k}'); import('d{k}').then(); import 's{k}'; import type { T{k} } from 't{k}'; // import x from 'c{k}'",
        [("m", "import"), ("t", "import"), ("e", "export"), ("./f", "export"), ("r", "require"), ("d", "dynamic")],
    ),
    "i3_graphql": (".gql", None, '#import "frag{k}.graphql"', [("frag", "import", ".graphql")]),
    "i5_python": (".py", "python", "import a{k}.b, c{k} as d; from .e{k} import f; from ..g{k}.h import i as j # import k{k}", [("a", "import", ".b"), (".e", "import"), ("..g", "import", ".h")]),
    "i6_rust": (".rs", "rust", "use crate::a{k}::{b, c}; use super::d{k}::E; mod f{k}; mod g{k} { } extern crate h{k}; use i{k}::*; // use j{k}::k;", [("crate::a", "import"), ("super::d", "import", "::e"), ("f", "import"), ("h", "import"), ("i", "import")]),
    "i7_go": (".go", "go", 'import x{k} "h{k}.org/a/b" // "c{k}"', [("h", "import", ".org/a/b")]),
    "i8_java": (".java", "java", "import a{k}.b.C; // import d{k}.e;", [("a", "import", ".b.C")]),
    "i9_csharp": (".cs", "csharp", "using A{k}.B; // using C{k};", [("A", "import", ".B")]),
    "i10_swift": (".swift", "swift", "import struct A{k}.B // import C{k}", [("A", "import", ".B")]),
}


def _imports(name: str) -> None:
    ending, lang, template, modules = IMPORTS[name]
    sql = lines_sql(ending, f", ms(m, kind, rest) AS (VALUES {values([(*x, '')[:3] for x in modules])})") + """
SELECT path AS source, concat(m, k, rest) AS module, kind AS type, CAST(n + 1 AS BIGINT) AS line FROM ls, ms"""

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return imports.extract_imports(source_files(spark, d, ending, lang, template)).select("source", "module", "type", "line")


for _name in IMPORTS:
    _imports(_name)


@query(
    "i11_by_language",
    "WITH" + fx.SYMBOLS + """,
ends(e, used) AS (VALUES ('.ts', 'm'), ('.jsx', 'm'), ('.vue', 'm'), ('.svelte', 'm'), ('.py', 'p'), ('.md', ''))
SELECT concat(path, e) AS source, used AS module FROM (SELECT DISTINCT path FROM symbols), ends WHERE used <> ''""",
)
def i11(spark: SparkSession, d: str) -> DataFrame:
    script, py = "import x from 'm'", "import p"
    texts = {".ts": script, ".jsx": script, ".vue": f"<template>import y from 'n'</template><script>{script}</script>", ".svelte": f"<script lang=ts>{script}</script>", ".py": py, ".md": script}
    p = fx.symbols(spark, d).select("path").distinct()
    files = p.select(F.explode(F.array(*(F.struct(F.concat("path", F.lit(e)).alias("path"), F.lit(t).alias("text")) for e, t in texts.items()))).alias("f")).select("f.*")
    return imports.extract_imports(files.withColumn("lang", paths.language(F.col("path")))).select("source", "module")


# Symbols, signatures

ANALYSED = {
    "typescript": (".ts", "export class C{k} { static s{k}() { } m{k}() { } } export function f{k}() { return v{k}; } const v{k} = 1; export const e{k} = () => f{k}(); interface I{k} { } type T{k} = I{k};"),
    "python": (".py", "class C{k}: a = 1\nasync def f{k}(): return g{k}()\ndef g{k}(): return 1\ndef _h{k}(): return C{k}()"),
    "rust": (".rs", "pub fn f{k}() { g{k}() }\nfn g{k}() { }\npub struct S{k} { }\ntrait R{k} { }"),
    "swift": (".swift", "func f{k}() { g{k}() }\nprivate func g{k}() { }\nstruct S{k} { }\nprotocol P{k} { }"),
}
FOUND = {  # name, kind, category, exported, line of the symbol's lines, parent
    "typescript": [("C", "ClassDeclaration", "class", 1, 0, None), ("f", "FunctionDeclaration", "function", 1, 0, None), ("v", "VariableDeclaration", "variable", 0, 0, None), ("e", "VariableDeclaration", "variable", 1, 0, None), ("I", "InterfaceDeclaration", "interface", 0, 0, None), ("T", "TypeAliasDeclaration", "type", 0, 0, None)],
    "python": [("C", "ClassDeclaration", "class", 1, 0, None), ("f", "AsyncFunction", "function", 1, 1, None), ("g", "FunctionDeclaration", "function", 1, 2, None), ("_h", "FunctionDeclaration", "function", 0, 3, None)],
    "rust": [("f", "FunctionDeclaration", "function", 1, 0, None), ("g", "FunctionDeclaration", "function", 0, 1, None), ("S", "ClassDeclaration", "class", 1, 2, None), ("R", "InterfaceDeclaration", "interface", 0, 3, None)],
    "swift": [("f", "FunctionDeclaration", "function", 1, 0, None), ("g", "FunctionDeclaration", "function", 0, 1, None), ("S", "ClassDeclaration", "class", 1, 2, None), ("P", "InterfaceDeclaration", "interface", 1, 3, None)],
}
USED = {"typescript": [("f", "v"), ("e", "f"), ("T", "I")], "python": [("f", "g"), ("_h", "C")], "rust": [("f", "g")], "swift": [("f", "g")]}


def _analysed(spark: SparkSession, d: str, lang: str) -> DataFrame:
    ending, template = ANALYSED[lang]
    return settled(symbols.analyse_files(source_files(spark, d, ending, lang, template)))


def _symbols(number: str, lang: str) -> None:
    ending, template = ANALYSED[lang]
    per = template.count("\n") + 1
    members = """
UNION ALL SELECT concat(path, ':C', k, '.s', k), 'StaticMethodDeclaration', 'function', true, CAST(n + 1 AS BIGINT), concat(path, ':C', k) FROM ls
UNION ALL SELECT concat(path, ':C', k, '.m', k), 'MethodDeclaration', 'function', true, CAST(n + 1 AS BIGINT), concat(path, ':C', k) FROM ls""" if lang == "typescript" else ""
    sql = lines_sql(ending, f", ds(a, kind, category, e, nth, parent) AS (VALUES {values(FOUND[lang])})")

    @query(f"{number}_{lang}_symbols", sql + f"""
SELECT concat(path, ':', a, k) AS id, kind, category, e = 1 AS is_exported, CAST(n * {per} + nth + 1 AS BIGINT) AS line, CAST(parent AS VARCHAR) AS parent FROM ls, ds""" + members)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return symbols.file_symbols(_analysed(spark, d, lang)).select("id", "kind", "category", "is_exported", "line", F.col("parent_symbol_id").alias("parent"))

    @query(f"a4_{lang}_usage", lines_sql(ending, f", us(a, b) AS (VALUES {values(USED[lang])})") + """
SELECT concat(path, ':', a, k) AS source_symbol_id, concat(path, ':', b, k) AS target_symbol_id FROM ls, us""")
    def usage_of(spark: SparkSession, d: str) -> DataFrame:
        none = spark.createDataFrame([], "source string, module string, target string")
        return symbols.symbol_deps(_analysed(spark, d, lang), none).select("source_symbol_id", "target_symbol_id")


for _number, _lang in (("a1", "typescript"), ("a6", "python"), ("a7", "rust"), ("a8", "swift")):
    _symbols(_number, _lang)


@query(
    "d13_export_graph",
    lines_sql(".ts") + "SELECT concat(path, ':e', k) AS src, concat(path, ':f', k) AS dst FROM ls",
)
def d13(spark: SparkSession, d: str) -> DataFrame:
    return symbols.export_graph(_analysed(spark, d, "typescript"))


IMPORTING = "import D{k}, { a{k} as b{k}, type T{k} } from './lib'; import * as n{k} from './space'; export function f{k}() { b{k}(); n{k}.q{k}(); D{k}(); let x: T{k}; }"


@query(
    "a3_import_map",
    lines_sql(".ts", ", us(file, name, types) AS (VALUES ('lib', 'a', false), ('lib', 'T', true), ('lib', 'default', false), ('space', 'q', false))") + """
SELECT concat(path, ':f', k) AS source_symbol_id, concat(folder, '/', file, '.ts:', name, CASE WHEN name = 'default' THEN '' ELSE CAST(k AS VARCHAR) END) AS target_symbol_id, types AS is_type_only FROM ls, us""",
)
def a3(spark: SparkSession, d: str) -> DataFrame:
    files = source_files(spark, d, ".ts", "typescript", IMPORTING)
    folder = paths.dirname(F.col("path"))
    targets = files.select(F.col("path").alias("source"), F.explode(F.array(F.lit("lib"), F.lit("space"))).alias("m"), folder.alias("folder")).select("source", F.concat(F.lit("./"), "m").alias("module"), F.concat("folder", F.lit("/"), "m", F.lit(".ts")).alias("target"))
    return symbols.symbol_deps(symbols.analyse_files(files), targets).select("source_symbol_id", "target_symbol_id", "is_type_only")


@query(
    "a5_runtime_symbols",
    lines_sql(".ts", f", ds(a, kind, category, e, nth, parent) AS (VALUES {values(FOUND['typescript'])})") + " SELECT concat(path, ':', a, k) AS id FROM ls, ds WHERE category NOT IN ('interface', 'type') UNION ALL SELECT concat(path, ':C', k, '.', m, k) FROM ls, (VALUES ('s'), ('m')) x(m)",
)
def a5(spark: SparkSession, d: str) -> DataFrame:
    found = symbols.file_symbols(_analysed(spark, d, "typescript"))
    return found.filter(misc.is_runtime(F.col("kind"))).select("id")


@query(
    "a2_categories",
    "SELECT * FROM (VALUES ('ClassDeclaration', 'class'), ('FunctionDeclaration', 'function'), ('MethodDeclaration', 'function'), ('VariableDeclaration', 'variable'), ('InterfaceDeclaration', 'interface'), ('TypeAliasDeclaration', 'type')) v(kind, category)",
)
def a2(spark: SparkSession, d: str) -> DataFrame:
    return symbols.file_symbols(_analysed(spark, d, "typescript")).filter("parent_symbol_id IS NULL OR kind NOT LIKE 'Static%'").select("kind", misc.category(F.col("kind")).alias("category")).distinct()


MEMBERS = "interface I{k} { readonly a{k}: T{k}; b{k}?: number; c{k}(x: T{k}): U{k}; } type A{k} = T{k} | 'x';"


@query(
    "b2_members",
    lines_sql(".ts", ", ms(m, kind, optional, readonly) AS (VALUES ('a', 'property', false, true), ('b', 'property', true, false), ('c', 'method', false, false))") + """
SELECT concat('I', k) AS symbol, concat(m, k) AS name, kind, CASE m WHEN 'a' THEN concat('T', k) WHEN 'b' THEN 'number' ELSE concat('(x: T', k, ') => U', k) END AS type, optional AS is_optional, readonly AS is_readonly FROM ls, ms""",
)
def b2(spark: SparkSession, d: str) -> DataFrame:
    return signatures.extract_interface_members(source_files(spark, d, ".ts", "typescript", MEMBERS), "old").select("symbol", "name", "kind", "type", "is_optional", "is_readonly")


@query("b2_aliases", lines_sql(".ts") + " SELECT concat('A', k) AS symbol, concat('T', k, ' | ''x''') AS type FROM ls")
def b2_aliases(spark: SparkSession, d: str) -> DataFrame:
    return signatures.extract_type_aliases(source_files(spark, d, ".ts", "typescript", MEMBERS), "old").select("symbol", "type")


SIGNED = "export async function f{k}(a{k}: number, b{k}?: T{k}, c{k} = 'x', ...r{k}: string[]): Promise<U{k}> { } class K{k} { constructor(private d{k}: T{k}) { } protected m{k}(): V{k} { } } const v{k} = (x{k}) => x{k};"


@query(
    "b1_kinds",
    lines_sql(".ts", ", ss(s, kind, v, a, np) AS (VALUES ('f', 'function', NULL, true, 4), ('K.constructor', 'constructor', NULL, false, 1), ('K.m', 'method', 'protected', false, 0), ('v', 'arrow', NULL, false, 1))") + """
SELECT CASE s WHEN 'f' THEN concat('f', k) WHEN 'v' THEN concat('v', k) WHEN 'K.m' THEN concat('K', k, '.m', k) ELSE concat('K', k, '.constructor') END AS symbol, kind,
  CASE s WHEN 'f' THEN concat('Promise<U', k, '>') WHEN 'K.m' THEN concat('V', k) WHEN 'v' THEN 'any' ELSE concat('K', k) END AS return_type, v AS visibility, a AS is_async, np AS n_params FROM ls, ss""",
)
def b1_kinds(spark: SparkSession, d: str) -> DataFrame:
    found = signatures.extract_signatures(source_files(spark, d, ".ts", "typescript", SIGNED), "old")
    return found.select("symbol", "kind", "return_type", "visibility", "is_async", F.size("params").alias("n_params"))


# Resolution: sources, modules and targets with {k} (key), {f} (folder) and {b} (its name); a null target doesn't resolve

ROOT = "/ws"
ALL_KINDS = [
    ("{f}/all.ts", "@lib/x{k}", "{f}/lib/x{k}.ts"),
    ("{f}/all.ts", "@base/y{k}", "/ws/base/y{k}/index.ts"),
    ("{f}/all.ts", "@lib", "{f}/lib/index.js"),
    ("{f}/all.ts", "@none/x{k}", None),
]
RESOLVED = {
    "r3_alias": ALL_KINDS,
    "r5_package_imports": [("{f}/deep/all.js", "#util/x{k}", "{f}/util/x{k}.js"), ("{f}/all.js", "#one{k}", None), ("{f}/all.js", "#one", "{f}/one.js")],
    "r6_packages": [("/ws/all.ts", "@s/{b}/x{k}", "{f}/pkg/src/x{k}.ts"), ("/ws/all.ts", "@s/{b}", "{f}/pkg/src/index.ts"), ("/ws/all.ts", "@s/none{k}", None)],
    "r7_python_relative": [("{f}/sub/a{k}.py", "..lib{k}.deep", "{f}/lib{k}/deep.py"), ("{f}/sub/a{k}.py", ".m{k}", "{f}/sub/m{k}/__init__.py"), ("{f}/sub/a{k}.py", ".none{k}", None)],
    "r8_python_absolute": [("{f}/sub/a{k}.py", "near{k}.x", "{f}/near{k}/x.py"), ("{f}/sub/a{k}.py", "far{k}", "/ws/far{k}.pyi"), ("{f}/sub/a{k}.py", "os", None)],
    "r9_rust": [("{f}/sub/a{k}.rs", "crate::p{k}::q", "/ws/p{k}/q.rs"), ("{f}/sub/a{k}.rs", "super::r{k}", "{f}/r{k}/mod.rs"), ("{f}/sub/a{k}.rs", "s{k}", "{f}/sub/s{k}.rs"), ("{f}/sub/a{k}.rs", "std::io", None), ("{f}/sub/a{k}.rs", "crate::Type{k}", None)],
    "r10_go": [("{f}/all.go", "h.org/{b}/p{k}", "{f}/p{k}/b.go"), ("{f}/all.go", "x.org/y/q{k}", "/ws/q{k}/z.go"), ("{f}/all.go", "fmt", None)],
    "r11_java": [("{f}/A.java", "{b}.P{k}", "{f}/P{k}.java"), ("{f}/A.java", "no.such.Q{k}", "{f}/q/Q{k}.java"), ("{f}/A.java", "java.util.List", None), ("{f}/A.java", "{b}.*", None)],
    "r12_csharp": [("{f}/A.cs", "App.{b}.N{k}", "{f}/N{k}/B.cs"), ("{f}/A.cs", "App.M{k}", "/ws/M{k}/C.cs"), ("{f}/A.cs", "System.IO", None)],
    "r13_swift": [("{f}/sub/A.swift", "M{k}", "{f}/Sources/M{k}/B.swift"), ("{f}/sub/A.swift", "N{k}", "/ws/x/y/Sources/N{k}/C.swift"), ("{f}/sub/A.swift", "UIKit", None)],
}
#: Files beside the targets that must not win.
DECOYS = {"r8_python_absolute": ["/ws/near{k}/x.py"], "r10_go": ["{f}/p{k}/a_test.go", "{f}/p{k}/c.go"], "r11_java": ["{f}/q/z/Q{k}.java"], "r12_csharp": ["{f}/N{k}/D.cs"], "r13_swift": ["{f}/Sources/M{k}/C.swift"], "r3_alias": ["{f}/base/y{k}.ts"]}
CONFIGS = {
    "r3_alias": [("{f}/tsconfig.json", '{{"extends": "../tsconfig.base", /* c */ "compilerOptions": {{"paths": {{"@lib/*": ["./lib/*"],}}}}}}'), ("/ws/tsconfig.base.json", '{{"compilerOptions": {{"baseUrl": ".", "paths": {{"@base/*": ["base/*"]}}}}}}')],
    "r5_package_imports": [("{f}/package.json", '{{"imports": {{"#util/*": {{"default": "./util/*"}}, "#one": "./one"}}}}')],
    "r6_packages": [("{f}/pkg/package.json", '{{"name": "@s/{b}", "main": "./dist/index.js"}}')],
    "r10_go": [("{f}/go.mod", "module h.org/{b}\n\ngo 1.22\n")],
}


def _spelt(spark: SparkSession, d: str, rows: list[tuple], names: list[str], by_symbol: bool = True) -> DataFrame:
    """The rows with {k}, {f} and {b} filled in by each symbol, or each folder."""
    s = fx.symbols(spark, d).select("folder", *(["k"] if by_symbol else [])).distinct()
    kinds = "array<struct<" + ", ".join(f"{n}: string" for n in names) + ">>"
    each = s.withColumn("r", F.explode(F.array(*(F.struct(*(F.lit(x).cast("string").alias(n) for n, x in zip(names, r, strict=True))) for r in rows)).cast(kinds)))

    def fill(c: Column) -> Column:
        c = F.replace(F.replace(c, F.lit("{f}"), F.col("folder")), F.lit("{b}"), F.element_at(F.split("folder", "/"), -1))
        c = F.replace(c, F.lit("{k}"), F.col("k").cast("string")) if by_symbol else c
        return F.replace(F.replace(c, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))

    return each.select(*(fill(F.col(f"r.{n}")).alias(n) for n in names)).distinct()


def _resolution(spark: SparkSession, d: str, name: str) -> DataFrame:
    cases = RESOLVED[name]
    wanted = settled(_spelt(spark, d, [c[:2] for c in cases], ["source", "module"]))
    files = settled(_spelt(spark, d, [(t,) for t in [*(c[2] for c in cases if c[2]), *DECOYS.get(name, ())]], ["path"]))
    aliases = packages = modules = None
    if name in CONFIGS:
        configs = settled(_spelt(spark, d, CONFIGS[name], ["path", "text"], by_symbol=False))
        named = configs.filter(F.col("path").endswith(".json"))
        aliases, packages, modules = resolve.alias_table(named), resolve.package_table(named), resolve.go_module_table(configs)
    return resolve.resolve(wanted, files, ROOT, aliases, modules, packages)


def _filled_sql(column: str) -> str:
    return f"replace(replace(replace({column}, '{{k}}', CAST(k AS VARCHAR)), '{{f}}', folder), '{{b}}', regexp_extract(folder, '[^/]+$'))"


for _name in RESOLVED:

    def _resolve(spark: SparkSession, d: str, name: str = _name) -> DataFrame:
        return _resolution(spark, d, name)

    query(
        _name,
        "WITH" + fx.SYMBOLS + f", cases(s, m, t) AS (VALUES {values([c for c in RESOLVED[_name] if c[2]])}) SELECT DISTINCT {_filled_sql('s')} AS source, {_filled_sql('m')} AS module, {_filled_sql('t')} AS target FROM symbols, cases",
    )(_resolve)


@query(
    "r1_master_order",
    "WITH" + fx.SYMBOLS + f", cases(s, m, t) AS (VALUES {values([c for n in ('r3_alias', 'r6_packages', 'r7_python_relative', 'r9_rust', 'r10_go', 'r11_java', 'r12_csharp') for c in RESOLVED[n] if c[2]] + [('{f}/all.ts', './rel{k}', '{f}/rel{k}/index.ts')])}) SELECT DISTINCT {_filled_sql('s')} AS source, {_filled_sql('m')} AS module, {_filled_sql('t')} AS target FROM symbols, cases",
)
def r1(spark: SparkSession, d: str) -> DataFrame:
    """All languages and stages in one call; a relative path falls to the last stage."""
    names = ("r3_alias", "r6_packages", "r7_python_relative", "r9_rust", "r10_go", "r11_java", "r12_csharp")
    cases = [*(c for n in names for c in RESOLVED[n]), ("{f}/all.ts", "./rel{k}", "{f}/rel{k}/index.ts")]
    wanted = settled(_spelt(spark, d, [c[:2] for c in cases], ["source", "module"]))
    files = settled(_spelt(spark, d, [(t,) for t in [*(c[2] for c in cases if c[2]), *(t for n in names for t in DECOYS.get(n, ()))]], ["path"]))
    configs = settled(_spelt(spark, d, [c for n in names for c in CONFIGS.get(n, ())], ["path", "text"], by_symbol=False))
    named = configs.filter(F.col("path").endswith(".json"))
    return resolve.resolve(wanted, files, ROOT, resolve.alias_table(named), resolve.go_module_table(configs), resolve.package_table(named))


# Paths, texts and small views


@query(
    "f1_paths",
    r"""WITH p AS (SELECT page_id, concat('C:\ws//', replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/', '\'), '/') AS path FROM pages),
n AS (SELECT page_id, path, regexp_replace(concat('c', replace(path, '\', '/')[2:]), '/+', '/', 'g') AS x FROM p)
SELECT page_id, rtrim(x, '/') AS path, regexp_extract(rtrim(x, '/'), '[^/]+$') AS file, string_split(rtrim(x, '/'), '/')[-2] AS parent, replace(rtrim(x, '/'), 'c:/ws/', '') AS relative FROM n""",
)
def f1(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("C:\\ws//"), F.replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), F.lit("/"), F.lit("\\")), F.lit("/"))
    p = fx.table(spark, d, "pages").select("page_id", paths.normalize(raw).alias("path"))
    return p.select("page_id", "path", paths.file_name(F.col("path")).alias("file"), paths.parent_name(F.col("path")).alias("parent"), paths.relative(F.col("path"), "c:/ws").alias("relative"))


@query(
    "f3_external_packages",
    "WITH" + fx.SYMBOLS + """,
m AS (SELECT concat(pre, name, e) AS module, pre, e FROM (SELECT DISTINCT replace(name, ' ', '-') AS name FROM symbols), (VALUES (''), ('./'), ('/'), ('C:/'), ('a/'), ('node_modules/')) p(pre), (VALUES (''), ('.ts'), ('.md')) x(e))
SELECT module, pre IN ('', 'node_modules/') AND e <> '.ts' AS is_external FROM m""",
)
def f3(spark: SparkSession, d: str) -> DataFrame:
    names = fx.symbols(spark, d).select(F.replace("name", F.lit(" "), F.lit("-")).alias("name")).distinct()
    each = names.withColumn("p", F.explode(F.array(*map(F.lit, ("", "./", "/", "C:/", "a/", "node_modules/"))))).withColumn("e", F.explode(F.array(*map(F.lit, ("", ".ts", ".md")))))
    m = each.select(F.concat("p", "name", "e").alias("module"))
    return m.select("module", paths.is_external_package(F.col("module")).alias("is_external"))


@query(
    "s4_directories",
    "WITH" + fx.SYMBOLS + """,
p AS (SELECT concat(folder, x, regexp_extract(path, '[^/]+$')) AS path, x FROM symbols, (VALUES ('/'), ('/node_modules/a/'), ('/.cache/'), ('/dist/'), ('/src/'), ('/../')) v(x))
SELECT DISTINCT path, x IN ('/node_modules/a/', '/.cache/', '/dist/') AS skipped, x IN ('/.cache/', '/dist/') AS skipped_with_packages, x IN ('/node_modules/a/', '/dist/') AS ignored FROM p""",
)
def s4(spark: SparkSession, d: str) -> DataFrame:
    s = fx.symbols(spark, d)
    p = s.withColumn("x", F.explode(F.array(*map(F.lit, ("/", "/node_modules/a/", "/.cache/", "/dist/", "/src/", "/../"))))).select(F.concat("folder", "x", F.regexp_extract("path", "[^/]+$", 0)).alias("path")).distinct()
    c = F.col("path")
    return p.select("path", paths.in_skipped_directory(c).alias("skipped"), paths.in_skipped_directory(c, False).alias("skipped_with_packages"), paths.in_ignored_directory(c).alias("ignored"))


@query("f5_token_savings", "SELECT event_id, CAST(ceil(length(props) / 4.0) AS BIGINT) AS json_tokens, CAST(ceil(length(event_type) / 4.0) AS BIGINT) AS compact_tokens FROM events")
def f5(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events")
    return e.select("event_id", codec.token_savings(F.col("props"), F.col("event_type")).alias("s")).select("event_id", "s.json_tokens", "s.compact_tokens")


@query(
    "f6_bounding_box",
    "WITH" + fx.SYMBOLS + ", p AS (SELECT CAST(start_line AS DOUBLE) AS x, CAST(end_line AS DOUBLE) AS y FROM symbols) SELECT min(x) AS \"left\", min(y) AS top, max(x) - min(x) AS width, max(y) - min(y) AS height FROM p",
)
def f6(spark: SparkSession, d: str) -> DataFrame:
    return misc.bounding_box(fx.symbols(spark, d).select(F.col("start_line").cast("double").alias("x"), F.col("end_line").cast("double").alias("y")))


@query(
    "t5_progress",
    "WITH e AS (SELECT event_id, event_id + 1 AS done, event_id + user_id + 1 AS total FROM events) SELECT event_id, CAST(round(done * 100 / total) AS BIGINT) AS percent, CAST(round(1000.0::DOUBLE / done * (total - done)) AS BIGINT) AS left_ms FROM e",
)
def t5(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events")
    return e.select("event_id", misc.progress(F.col("event_id") + 1, F.col("event_id") + F.col("user_id") + 1, F.lit(1000.0)).alias("p")).select("event_id", "p.percent", "p.left_ms")


@query(
    "f11_errors",
    """WITH m AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'ENOENT' WHEN 'signup' THEN 'EACCES' WHEN 'click' THEN 'EFBIG' ELSE '' END AS code, CASE WHEN event_id < 100 THEN 'a syntax error' ELSE 'other' END AS message FROM events)
SELECT event_id, CASE code WHEN 'ENOENT' THEN 'FILE_NOT_FOUND' WHEN 'EACCES' THEN 'PERMISSION_DENIED' WHEN 'EFBIG' THEN 'FILE_TOO_LARGE' ELSE CASE WHEN event_id < 100 THEN 'PARSE_ERROR' ELSE 'UNKNOWN' END END AS kind,
  code IN ('ENOENT', 'EACCES') OR code = '' AND event_id < 100 AS recoverable FROM m""",
)
def f11(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events")
    code = F.when(F.col("event_type") == "error", "ENOENT").when(F.col("event_type") == "signup", "EACCES").when(F.col("event_type") == "click", "EFBIG").otherwise("")
    m = e.select("event_id", misc.error(code, F.when(F.col("event_id") < 100, "a syntax error").otherwise("other")).alias("e"))
    return m.select("event_id", F.col("e.code").alias("kind"), "e.recoverable")


@query("g11_scoped_labels", "WITH" + fx.SYMBOLS + ", m AS (SELECT DISTINCT concat(pre, replace(name, ' ', '/')) AS module, pre FROM symbols, (VALUES ('@'), ('@/'), ('')) v(pre)) SELECT module, CASE WHEN pre = '@' AND contains(module, '/') THEN module END AS label FROM m")
def g11(spark: SparkSession, d: str) -> DataFrame:
    names = fx.symbols(spark, d).select(F.replace("name", F.lit(" "), F.lit("/")).alias("name"))
    m = names.select(F.explode(F.array(*(F.concat(F.lit(p), "name") for p in ("@", "@/", "")))).alias("module")).distinct()
    return m.select("module", paths.scoped_label(F.col("module")).alias("label"))


@query("g20_merge_nodes", "WITH" + fx.SYMBOLS + " SELECT id, CASE WHEN type IN ('class', 'method') THEN 'right' ELSE 'left' END AS side FROM symbols WHERE type <> 'variable' OR lang = 'go'")
def g20_nodes(spark: SparkSession, d: str) -> DataFrame:
    s = fx.symbols(spark, d).filter("type <> 'variable' OR lang = 'go'")
    return views.merge_nodes(s.select("id", F.lit("left").alias("side")), s.filter("type IN ('class', 'method')").select("id", F.lit("right").alias("side")))


@query(
    "g25_add_referencing",
    "WITH" + fx.DEPS + """,
t AS (SELECT min(target) AS target FROM deps),
shown AS (SELECT DISTINCT target AS path FROM deps WHERE target LIKE '%.ts' UNION SELECT target FROM t),
r AS (SELECT source FROM deps, t WHERE deps.target = t.target)
SELECT path, regexp_extract(path, '[^/]+$') AS label FROM (SELECT path FROM shown UNION SELECT source FROM r)""",
)
def g25(spark: SparkSession, d: str) -> DataFrame:
    deps = settled(fx.deps(spark, d))
    target = deps.agg(F.min("target")).first()[0]
    nodes = deps.filter(F.col("target").endswith(".ts") | (F.col("target") == target)).select(F.col("target").alias("path")).distinct()
    nodes = nodes.withColumn("label", paths.file_name(F.col("path")))
    references = usage.referencing_files(deps, spark.createDataFrame([(target,)], "path string"))
    return views.add_referencing(nodes, deps.filter(F.col("target").endswith(".ts")).select("source", "target"), references, target)[0]


@query(
    "g16_flags",
    "WITH RECURSIVE" + fx.DEPS + """,
walk AS (SELECT node, 0 AS depth FROM start UNION SELECT target, depth + 1 FROM walk JOIN deps ON source = node WHERE depth < 3),
nodes AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
drawn AS (SELECT node FROM nodes ORDER BY depth, node LIMIT 40),
inner_edges AS (SELECT DISTINCT source, target FROM deps WHERE source IN (SELECT node FROM drawn) AND target IN (SELECT node FROM drawn))
SELECT (SELECT count(*) FROM nodes) > 40 AS nodes_cut, (SELECT count(*) FROM inner_edges) > 100 AS edges_cut""",
)
def g16_flags(spark: SparkSession, d: str) -> DataFrame:
    deps = settled(fx.deps(spark, d))
    nodes = settled(traverse.crawl(deps, fx.root_file(spark, d), 2))
    return traverse.capped(nodes, deps.select(F.col("source").alias("src"), F.col("target").alias("dst")), 40, 100)[2]


@query(
    "d1_reverse_index",
    "WITH" + fx.DEPS + """,
fresh AS (SELECT source, target, max(line) + 1 AS line FROM deps WHERE source LIKE '%.ts' AND target LIKE '%.py' GROUP BY ALL)
SELECT source, target, line FROM deps WHERE source NOT LIKE '%.ts' UNION ALL SELECT source, target, line FROM fresh""",
)
def d1(spark: SparkSession, d: str) -> DataFrame:
    deps = settled(fx.deps(spark, d))
    sources = deps.filter(F.col("source").endswith(".ts")).select(F.col("source").alias("path")).distinct()
    fresh = deps.filter(F.col("source").endswith(".ts") & F.col("target").endswith(".py"))
    # each twice: the later line wins
    fresh = fresh.unionByName(fresh.withColumn("line", F.col("line") + 1))
    return usage.replaced(deps, fresh, sources).select("source", "target", "line")


@query(
    "d8_scan",
    "WITH" + fx.SYMBOLS + """,
t AS (SELECT DISTINCT folder FROM symbols WHERE lang = 'go')
SELECT concat(s.folder, '/lib/x', k, '.ts') AS target, concat(s.folder, '/all.ts') AS source, 'import' AS type FROM symbols s JOIN t USING (folder) WHERE is_exported""",
)
def d8(spark: SparkSession, d: str) -> DataFrame:
    """Exported keys' libraries in folders with Go files, sought in the texts of all folders."""
    files = settled(source_files(spark, d, ".ts", "typescript", "import a{k} from './lib/x{k}'; const b{k} = 'x{j}';"))
    s = fx.symbols(spark, d)
    go = s.filter("lang = 'go'").select("folder").distinct()
    targets = s.filter("is_exported").join(go, "folder", "left_semi").select(F.concat("folder", F.lit("/lib/x"), F.col("k").cast("string"), F.lit(".ts")).alias("path"))
    listing = targets.unionByName(files.select("path"))
    return usage.scan_references(files, targets, lambda found: resolve.resolve(found, listing, ROOT)).select("target", "source", "type")


@query(
    "d15_verify_usage",
    "WITH" + fx.DEPS + """,
d AS (SELECT * FROM deps WHERE target = (SELECT min(target) FROM deps))
SELECT d.source, d.target, d.source LIKE '%.go' OR EXISTS (SELECT 1 FROM edges e WHERE e.type_relation = 'USES' AND e.source_path = d.source AND e.target_path = d.target) AS is_used FROM d""",
)
def d15(spark: SparkSession, d: str) -> DataFrame:
    deps = settled(fx.deps(spark, d))
    target = deps.agg(F.min("target")).first()[0]
    return usage.edge_usage(deps.filter(F.col("target") == target), fx.symbol_deps(spark, d).filter("is_type_only"), fx.symbols(spark, d).select("path").distinct())


@query(
    "d22_tolerant_targets",
    "WITH" + fx.EDGES + " SELECT source_id AS source_symbol_id, target_id AS target_symbol_id, target_path FROM edges",
)
def d22(spark: SparkSession, d: str) -> DataFrame:
    deps = settled(fx.symbol_deps(spark, d))
    # targets as their files name them: a module, a path with backslashes, or the path itself
    module = F.concat(F.lit("./"), F.regexp_extract("target_path", "[^/]+$", 0), F.lit("?"), F.col("target_path"))
    how = F.pmod(F.xxhash64("target_path"), F.lit(3))
    named = deps.withColumn("named", F.when(how == 0, module).when(how == 1, F.replace("target_path", F.lit("/"), F.lit("\\"))).otherwise(F.col("target_path")))
    targets = named.filter(F.col("named").startswith("./")).select(F.col("source_path").alias("source"), F.col("named").alias("module"), F.col("target_path").alias("target")).distinct()
    loose = named.withColumn("target_path", F.col("named")).drop("named")
    return usage.match_targets(loose, targets).select("source_symbol_id", "target_symbol_id", "target_path")


@query("e9_file_record", "SELECT concat('/ws/d', doc_id, '.ts') AS path, lang, n_chars AS size FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)")
def e9(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents")
    files = docs.select(F.concat(F.lit("/ws/d"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), "lang", F.col("n_chars").alias("size"))
    return store.file_record(files, f"/ws/d{docs.agg(F.min('doc_id')).first()[0]}.ts")


@query(
    "g18_trace_rows",
    "WITH RECURSIVE" + fx.EDGES + """,
walk AS (SELECT id AS node, 0 AS depth FROM root UNION SELECT target_id, depth + 1 FROM walk JOIN edges ON source_id = node WHERE depth < 1),
callers AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
SELECT DISTINCT depth + 1 AS depth, source_id AS caller, target_id AS called, CASE WHEN target_path NOT LIKE '%.go' THEN target_path END AS resolved, true AS max_depth_reached
FROM callers JOIN edges ON source_id = node WHERE depth < 2""",
)
def g18_rows(spark: SparkSession, d: str) -> DataFrame:
    e = settled(traverse.call_pairs(fx.edges(spark, d)))
    known = fx.symbols(spark, d).filter("lang <> 'go'").select("id", "path")
    return traverse.trace_rows(e, fx.root(spark, d).select(F.col("id").alias("node")), known, 2)


@query("c8_cycle_cap", "WITH" + fx.DEPS + " SELECT source AS src, target AS dst FROM deps LIMIT 0")
def c8(spark: SparkSession, d: str) -> DataFrame:
    """Over the cap no cycles are sought."""
    from ..operators import cycles

    return cycles.capped_cycle_edges(fx.deps(spark, d).select(F.col("source").alias("src"), F.col("target").alias("dst")), 1)


@query(
    "toon_read",
    "WITH" + fx.SYMBOLS + ", d AS (SELECT folder, count(*) AS n FROM symbols GROUP BY folder) SELECT folder, name, start_line, is_exported, rest FROM (SELECT folder, name, start_line, is_exported, concat(type, ',', lang, '|[x]\\') AS rest FROM symbols) JOIN d USING (folder)",
)
def toon_read(spark: SparkSession, d: str) -> DataFrame:
    """Rows written in the compact format, a document for each folder, and read again."""
    s = fx.symbols(spark, d).select("folder", "name", "start_line", "is_exported", F.concat("type", F.lit(","), "lang", F.lit("|[x]\\")).alias("rest"))
    cells = [codec.cell(f.name, f.dataType) for f in s.schema.fields]
    lines = s.select("folder", F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias("line"))
    text = F.concat(F.lit(codec.header(s.columns) + "\n"), F.array_join(F.collect_list("line"), "\n"))
    read = codec.read_documents(lines.groupBy("folder").agg(text.alias("text")))
    return read.select(F.from_json("row_json", s.schema).alias("r")).select("r.*")


@query("s10_snapshot", "WITH" + fx.SYMBOLS + " SELECT id, name, type, start_line FROM symbols")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """Saved twice and loaded: the later version."""
    ensure_checkpoint_dir(spark)
    folder, root = spark.sparkContext.getCheckpointDir(), "/ws"
    s = fx.symbols(spark, d).select("id", "name", "type", "start_line")
    workspace.save_snapshot({"symbols": s.limit(1)}, folder, "s10_snapshot", root)
    workspace.save_snapshot({"symbols": s}, folder, "s10_snapshot", root)
    if workspace.load_snapshot(spark, folder, "s10_snapshot", "/other") is not None:
        raise ValueError("a snapshot of another root was loaded")
    return workspace.load_snapshot(spark, folder, "s10_snapshot", root)["symbols"]


@query(
    "s1_workspace",
    "WITH" + fx.SYMBOLS + """,
f AS (SELECT DISTINCT folder FROM symbols)
SELECT concat(regexp_extract(folder, '[^/]+$'), '/all', e) AS path, lang, CASE WHEN e = '.py' THEN 'FILE_TOO_LARGE' END AS error, e <> '.py' AS has_text
FROM f, (VALUES ('.ts', 'typescript'), ('.py', 'python'), ('.go', 'go')) x(e, lang)""",
)
def s1(spark: SparkSession, d: str) -> DataFrame:
    """A tree written to shared storage and walked: ignored and hidden directories and other endings are left out, large files have no text."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir().rstrip("/") + "/s1_workspace"
    files = fx.symbols(spark, d).select("folder").distinct()
    names = {".ts": "x", ".py": "y" * 200, ".go": "z", ".md": "m"}
    places = ["/all", "/node_modules/a/all", "/.hidden/all", "/dist/all"]
    each = files.select(F.regexp_extract("folder", "[^/]+$", 0).alias("f")).withColumn("p", F.explode(F.array(*map(F.lit, places)))).withColumn("e", F.explode(F.array(*map(F.lit, names))))
    text = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("e"))
    write_files(each.select(F.concat(F.lit(root + "/"), "f", "p", "e").alias("path"), text.alias("text")))
    found = workspace.texts(spark, root, max_bytes=100)
    below = F.regexp_extract("path", "([^/]+/[^/]+)$", 1)
    return found.select(below.alias("path"), "lang", "error", F.col("text").isNotNull().alias("has_text"))


def write_files(rows: DataFrame) -> None:
    """Writes text to path, through the file system that the path names; for small trees, as the driver does it."""
    jvm, conf = rows.sparkSession.sparkContext._jvm, rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path, text in rows.toLocalIterator():
        p = jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(conf).create(p, True)
        out.write(bytearray(text.encode()))
        out.close()


@query(
    "t2_split",
    "WITH" + fx.CHANGES + """,
w AS (SELECT path, arg_max(event, (CASE event WHEN 'delete' THEN 3 WHEN 'change' THEN 2 ELSE 1 END, seq)) AS event FROM changes GROUP BY path)
SELECT path, event = 'delete' AS is_gone FROM w""",
)
def t2(spark: SparkSession, d: str) -> DataFrame:
    again, gone = feed.split(fx.changes(spark, d))
    return again.withColumn("is_gone", F.lit(False)).unionByName(gone.withColumn("is_gone", F.lit(True)))


@query(
    "t4_debounce",
    "WITH" + fx.CHANGES + """,
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, seq) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS first FROM changes),
n AS (SELECT *, sum(first) OVER (PARTITION BY path ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT path, arg_max(event, (CASE event WHEN 'delete' THEN 3 WHEN 'change' THEN 2 ELSE 1 END, seq)) AS event, max(seq) AS last_seq FROM n GROUP BY path, nth""",
)
def t4(spark: SparkSession, d: str) -> DataFrame:
    return feed.debounced(fx.changes(spark, d), "2 hours").select("path", "event", "last_seq")


@query("a9_editor_symbols", "WITH" + fx.EDGES + ", here AS (SELECT path FROM root JOIN symbols USING (id)) SELECT id, CASE WHEN type = 'variable' THEN concat(type, '() callback') ELSE name END AS name, CASE type WHEN 'class' THEN 'class' WHEN 'interface' THEN 'class' WHEN 'function' THEN 'function' WHEN 'method' THEN 'function' ELSE 'variable' END AS kind FROM symbols JOIN here USING (path)")
def a9(spark: SparkSession, d: str) -> DataFrame:
    path = fx.root(spark, d).first()["id"].partition(":")[0]
    s = fx.symbols(spark, d)
    name = F.when(F.col("type") == "variable", "<function>").otherwise(F.col("name"))
    editor = s.select("id", "path", name.alias("name"), F.initcap("type").alias("lsp_kind"), F.col("type").alias("container_name"))
    return views.intra_file(editor, fx.edges(spark, d).select("source_id", "target_id"), path)[0]


@query("s15_editor_calls", "WITH" + fx.EDGES + ", here AS (SELECT path FROM root JOIN symbols USING (id)) SELECT DISTINCT source_id, target_id FROM edges, here WHERE source_path = path AND target_path = path")
def s15(spark: SparkSession, d: str) -> DataFrame:
    path = fx.root(spark, d).first()["id"].partition(":")[0]
    editor = fx.symbols(spark, d).select("id", "path", "name", F.initcap("type").alias("lsp_kind"), F.lit(None).cast("string").alias("container_name"))
    return views.intra_file(editor, fx.edges(spark, d).select("source_id", "target_id"), path)[1]


@query("a11_symbol_list", "WITH" + fx.SYMBOLS + " SELECT id FROM symbols WHERE type NOT IN ('type', 'interface')")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return views.listed_symbols(fx.symbols(spark, d).withColumn("category", F.col("type"))).select("id")


for _same, _table in ((True, "merged"), (False, "replaced")):

    def _g21(spark: SparkSession, d: str, same: bool = _same) -> DataFrame:
        s = fx.symbols(spark, d).select("id", "type")
        old, new = s.filter("type <> 'class'").withColumn("side", F.lit("old")), s.filter("type <> 'method'").withColumn("side", F.lit("new"))
        none = s.select(F.col("id").alias("source"), F.col("id").alias("target")).limit(0)
        return views.apply_update(old, none, new, none, same, True, "indexing")[0].select("id", "side")

    query(f"g21_{_table}", "WITH" + fx.SYMBOLS + (" SELECT id, CASE WHEN type <> 'method' THEN 'new' ELSE 'old' END AS side FROM symbols" if _same else " SELECT id, 'new' AS side FROM symbols WHERE type <> 'method'"))(_g21)


@query(
    "f7_radial",
    "WITH" + fx.SYMBOLS + """,
r AS (SELECT id, start_line % 5 AS depth, row_number() OVER (PARTITION BY start_line % 5 ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY start_line % 5) AS n FROM symbols)
SELECT id, CAST(round(depth * 250 * cos(2 * pi() * i / n)) AS BIGINT) AS x, CAST(round(depth * 250 * sin(2 * pi() * i / n)) AS BIGINT) AS y FROM r""",
)
def f7(spark: SparkSession, d: str) -> DataFrame:
    s = fx.symbols(spark, d).select("id", (F.col("start_line") % 5).alias("depth"))
    return misc.radial(s).select("id", F.round("x").cast("long").alias("x"), F.round("y").cast("long").alias("y"))


@query(
    "f10_configs",
    "WITH" + fx.SYMBOLS + """,
f AS (SELECT DISTINCT folder FROM symbols)
SELECT folder AS config_dir, 0 AS ordinal, '@lib' AS alias, concat(folder, '/lib') AS target FROM f
UNION ALL SELECT folder, 10000, '@base', '/ws/base' FROM f UNION ALL SELECT '/ws', 0, '@base', '/ws/base'""",
)
def f10(spark: SparkSession, d: str) -> DataFrame:
    """Configs with comments and commas at ends; what a config extends comes after its own."""
    return resolve.alias_table(_spelt(spark, d, CONFIGS["r3_alias"], ["path", "text"], by_symbol=False))


@query("s5_ignored_parents", "WITH" + fx.SYMBOLS + " SELECT DISTINCT concat(replace(folder, 'brand1', 'dist'), '/x.ts') AS path, folder = '/ws/brand1' AS ignored FROM symbols")
def s5(spark: SparkSession, d: str) -> DataFrame:
    p = fx.symbols(spark, d).select(F.concat(F.replace("folder", F.lit("brand1"), F.lit("dist")), F.lit("/x.ts")).alias("path")).distinct()
    return p.select("path", paths.in_ignored_directory(F.col("path")).alias("ignored"))


@query("r16_relative", "WITH" + fx.SYMBOLS + " SELECT DISTINCT path, path[5:] AS relative, replace(regexp_replace(path[5:], '\\.(py|ts|js|tsx|jsx)$', ''), '/', '.') AS module FROM symbols")
def r16(spark: SparkSession, d: str) -> DataFrame:
    p = fx.symbols(spark, d).select("path").distinct()
    return p.select("path", paths.relative(F.col("path"), "/ws").alias("relative"), paths.module_path(F.col("path"), "/ws").alias("module"))


@query("d19_referencing_payload", "WITH" + fx.DEPS + ", t AS (SELECT min(target) AS target FROM deps) SELECT d.source, d.target, (SELECT count(DISTINCT x.source) FROM deps x WHERE x.target = d.source) AS parent_count FROM deps d JOIN t ON d.target = t.target")
def d19(spark: SparkSession, d: str) -> DataFrame:
    deps = settled(fx.deps(spark, d))
    target = deps.agg(F.min("target")).first()[0]
    found = usage.referencing_files(deps, spark.createDataFrame([(target,)], "path string")).select(F.col("source").alias("path"), "target")
    return usage.with_parent_counts(found, deps).select(F.col("path").alias("source"), "target", F.coalesce("parent_count", F.lit(0)).cast("long").alias("parent_count"))
