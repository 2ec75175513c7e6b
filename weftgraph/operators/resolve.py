"""Specifiers of imports to files: ordered candidates, one equi-join with the files, the first that exists.

Every rule turns an import into candidate paths with an ordinal; no rule looks at
the file system. `files` is the listing (column path, normal form), `imports` has
source and module. The results have source, module and target; rules
of several stages are joined in order by `first_resolved`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import EXTENSIONS, ancestors, dirname, language
from ..plans.runtime import settled, unguessed
from .store import first_of

# Names that never resolve to files of the workspace.
RUST_EXTERNAL = (
    "std", "core", "alloc", "proc_macro", "test", "serde", "tokio", "async_std", "futures",
    "vm", "rustpython_vm", "rustpython", "rustpython_parser", "rustpython_compiler", "num_traits", "enum_dispatch", "dashmap",
)
JAVA_STANDARD = ("java.", "javax.", "sun.", "com.sun.", "org.w3c.", "org.xml.", "org.ietf.", "org.omg.", "jdk.", "javafx.")
CSHARP_FRAMEWORK = ("System", "Microsoft", "Newtonsoft", "NUnit", "Xunit", "MSTest", "AutoMapper", "FluentValidation", "MediatR", "Serilog")
PYTHON_ENDS = (".py", ".pyi", "/__init__.py", "/__init__.pyi")


def resolved(path: Column) -> Column:
    """An absolute path without empty parts, points and parent references."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    drive = path.rlike("^[A-Za-z]:/")
    return F.when(drive, F.array_join(parts, "/")).otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))


def pick(imports: DataFrame, files: DataFrame, candidates: Column) -> DataFrame:
    """source, module, target: of the candidates (an array of paths) the first that is a file."""
    rows = imports.select("source", "module").distinct().select("source", "module", F.posexplode(candidates).alias("__n", "path"))
    found = rows.join(unguessed(files.select("path").distinct()), "path")
    return found.groupBy("source", "module").agg(F.min_by("path", "__n").alias("target"))


def stems(files: DataFrame) -> DataFrame:
    """path, base, rank: what may be written for a file, the least rank first: the path itself, it without a known extension, its directory if it is an index file.

    So an import is one row that meets its file by base, and not one for each ending.
    """
    ends = F.array(*map(F.lit, EXTENSIONS))
    end = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    nth = F.array_position(ends, end).cast("int")
    bare = F.expr("substring(path, 1, length(path) - length(__end))")
    rows = files.select("path").distinct().withColumns({"__end": end, "__nth": nth}).withColumn("__bare", bare)
    whole = F.struct(F.col("path").alias("base"), F.lit(0).alias("rank"))
    cut = F.struct(F.col("__bare").alias("base"), F.col("__nth").alias("rank"))
    folder = F.struct(F.regexp_replace("__bare", "/index$", "").alias("base"), (F.col("__nth") + len(EXTENSIONS)).alias("rank"))
    tried = F.when(F.col("__nth") == 0, F.array(whole)).when(F.col("__bare").endswith("/index"), F.array(whole, cut, folder)).otherwise(F.array(whole, cut))
    return rows.select("path", F.explode(tried).alias("t")).select("path", "t.base", "t.rank")


def pick_stem(rows: DataFrame, files: DataFrame) -> DataFrame:
    """source, module, target of rows (source, module, base, and ordinal if several bases are tried): the first base that a file has, by its least rank."""
    order = F.struct("ordinal", "rank") if "ordinal" in rows.columns else F.col("rank")
    return rows.join(unguessed(stems(files)), "base").groupBy("source", "module").agg(F.min_by("path", order).alias("target"))


def relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Specifiers that begin with a point or a slash."""
    base = F.when(F.col("module").startswith("/"), resolved(F.col("module"))).otherwise(resolved(F.concat_ws("/", dirname(F.col("source")), F.col("module"))))
    rows = imports.filter(F.col("module").rlike(r"^(\.|/)")).select("source", "module").distinct()
    return pick_stem(rows.withColumn("base", base), files)


def nearest(paths: DataFrame, configs: DataFrame, root: str = "") -> DataFrame:
    """path, config_dir: the deepest directory at or above the file, not above root, among configs (column config_dir)."""
    above = paths.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("config_dir"))
    if root:
        above = above.filter((F.col("config_dir") == root) | F.col("config_dir").startswith(root.rstrip("/") + "/"))
    found = above.join(unguessed(configs.select("config_dir").distinct()), "config_dir")
    return found.groupBy("path").agg(F.max_by("config_dir", F.length("config_dir")).alias("config_dir"))


def _json(text: str) -> dict:
    """JSON with comments and commas at ends."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    plain = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", plain)
    try:
        out = json.loads(plain)
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def _target(value) -> str | None:
    """Of a conditional target the first of default, import, require, node."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return next((t for t in map(_target, value) if t), None)
    if isinstance(value, dict):
        return next((t for t in (_target(value.get(k)) for k in ("default", "import", "require", "node")) if t), None)
    return None


def config_rows(path: str, text: str) -> list[tuple]:
    """(config_dir, extends, ordinal, alias, target) of one tsconfig.json or package.json."""
    data, folder = _json(text), path.rpartition("/")[0]
    if path.endswith("package.json"):
        pairs = [(k, _target(v)) for part in ("imports", "aliases") for k, v in (data.get(part) or {}).items()]
        return [(folder, None, i, k.removesuffix("/*"), re.sub(r"/\*$", "", f"{folder}/{v.removeprefix('./')}")) for i, (k, v) in enumerate(pairs) if v]
    options = data.get("compilerOptions") or {}
    base = f"{folder}/{options.get('baseUrl', '.')}"
    up = data.get("extends")
    up = None if not isinstance(up, str) or not up.startswith(".") else f"{folder}/{up}" + ("" if up.endswith(".json") else ".json")
    rows = [(folder, up, i, k.removesuffix("/*"), re.sub(r"/\*$", "", f"{base}/{v[0]}")) for i, (k, v) in enumerate((options.get("paths") or {}).items()) if v and isinstance(v, list) and isinstance(v[0], str)]
    return rows or [(folder, up, -1, None, None)]


def alias_table(configs: DataFrame, max_extends: int = 10) -> DataFrame:
    """config_dir, ordinal, alias, target of config files (path, text); what a config extends follows its own aliases."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *r) for p, t in zip(batch["path"], batch["text"], strict=True) for r in config_rows(p, t or "")]
            yield pd.DataFrame(rows, columns=["path", "config_dir", "extends", "ordinal", "alias", "target"])

    own = configs.select("path", "text").mapInPandas(run, "path string, config_dir string, extends string, ordinal int, alias string, target string")
    own = settled(own.withColumn("extends", F.when(F.col("extends").isNotNull(), resolved(F.col("extends")))).withColumn("target", F.when(F.col("target").isNotNull(), resolved(F.col("target")))))
    # chains of extends: from each config to those it inherits from, by number of steps
    step = own.select("path", "extends").distinct()
    chain = settled(own.select("config_dir", "path").distinct().withColumn("level", F.lit(0)))
    seen = chain
    for level in range(1, max_extends + 1):
        chain = settled(chain.join(step, "path").filter("extends IS NOT NULL").select("config_dir", F.col("extends").alias("path")).distinct().join(seen, ["config_dir", "path"], "left_anti").withColumn("level", F.lit(level)))
        if chain.isEmpty():
            break
        seen = seen.unionByName(chain)
    rows = seen.join(own.select("path", "ordinal", "alias", "target").filter("alias IS NOT NULL"), "path")
    return rows.select("config_dir", (F.col("level") * 10_000 + F.col("ordinal")).alias("ordinal"), "alias", "target")


def package_table(configs: DataFrame) -> DataFrame:
    """name, dir, main of the package.json files among configs (path, text); of equal names the least directory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                data = _json(text or "")
                main = next((data[k] for k in ("main", "module") if isinstance(data.get(k), str) and data[k]), None)
                if isinstance(data.get("name"), str):
                    rows.append((data["name"], path.rpartition("/")[0], main and main.removeprefix("./")))
            yield pd.DataFrame(rows, columns=["name", "dir", "main"])

    rows = configs.filter(F.col("path").endswith("/package.json")).select("path", "text").mapInPandas(run, "name string, dir string, main string")
    return settled(rows.groupBy("name").agg(F.min("dir").alias("dir"), F.min_by("main", "dir").alias("main")))


def go_module_table(configs: DataFrame) -> DataFrame:
    """config_dir, module_name of the go.mod files among configs (path, text)."""
    name = F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1)
    return configs.filter(F.col("path").endswith("/go.mod")).select(dirname(F.col("path")).alias("config_dir"), name.alias("module_name")).filter("module_name <> ''")


def by_alias(imports: DataFrame, files: DataFrame, aliases: DataFrame, root: str = "") -> DataFrame:
    """Specifiers that equal an alias of the nearest config or go on from it by a slash; the first alias wins."""
    asked = imports.select("source", "module").distinct().filter(~F.col("module").startswith("."))
    near = nearest(asked.select(F.col("source").alias("path")), aliases, root).withColumnRenamed("path", "source")
    parts = F.split("module", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    tried = asked.join(unguessed(near), "source").select("source", "module", "config_dir", F.explode(prefixes).alias("alias"))
    best = first_of(tried.join(unguessed(aliases), ["config_dir", "alias"]), ["source", "module"], F.col("ordinal"))
    return pick_stem(best.select("source", "module", F.concat("target", F.expr("substring(module, length(alias) + 1)")).alias("base")), files)


def python(imports: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Relative modules go up a directory for each point after the first; others are tried from the file's directory up to the root."""
    ends = lambda base: [F.concat(base, F.lit(e)) for e in PYTHON_ENDS]
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace("module", r"^\.*", ""), F.lit("."), F.lit("/"))
    ups = ancestors(F.col("source"))
    here = F.try_element_at(ups, F.greatest(dots, F.lit(1)))
    inside = F.filter(ups, lambda d: (d == root) | d.startswith(root.rstrip("/") + "/"))
    near = F.array(*ends(F.concat_ws("/", here, F.when(rest != "", rest))))
    all_ups = F.flatten(F.transform(inside, lambda d: F.array(*ends(F.concat_ws("/", d, rest)))))
    rows = imports.filter(F.col("source").rlike(r"\.pyi?$"))
    return pick(rows, files, F.when(dots > 0, near).otherwise(all_ups))


def rust(imports: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """crate:: from the root, super:: from the parent, self:: and bare modules from the file's directory; names with capitals aren't files."""
    m = F.col("module")
    first = F.split(m, "::")[0]
    rest = F.regexp_replace(m, "^(crate|super|self)::", "")
    here = dirname(F.col("source"))
    base = F.when(m.startswith("crate::"), F.lit(root)).when(m.startswith("super::"), dirname(here)).otherwise(here)
    path = F.concat_ws("/", base, F.replace(rest, F.lit("::"), F.lit("/")))
    rows = imports.filter(F.col("source").endswith(".rs") & ~first.isin(*RUST_EXTERNAL) & (rest == F.lower(rest)))
    return pick(rows, files, F.array(F.concat(path, F.lit(".rs")), F.concat(path, F.lit("/mod.rs"))))


def first_files(files: DataFrame, ending: str, test_ending: str | None = None) -> DataFrame:
    """folder, path: the first file by name with the ending (and not the other) in each directory."""
    rows = files.filter(F.col("path").endswith(ending))
    if test_ending:
        rows = rows.filter(~F.col("path").endswith(test_ending))
    return rows.groupBy(dirname(F.col("path")).alias("folder")).agg(F.min("path").alias("path"))


def _levels(folder: Column, root: str) -> Column:
    return F.size(F.split(F.substring(folder, len(root.rstrip("/")) + 2, 1 << 30), "/"))


def _by_folder(rows: DataFrame, folders: DataFrame, candidates: Column) -> DataFrame:
    tried = rows.select("source", "module", F.posexplode(candidates).alias("__n", "folder"))
    return tried.join(unguessed(folders), "folder").groupBy("source", "module").agg(F.min_by("path", "__n").alias("target"))


def _named_folder(rows: DataFrame, folders: DataFrame, name: Column, root: str, levels: int) -> DataFrame:
    """The least directory of this name at most so many levels below the root that has a file."""
    inside = folders.filter(F.col("folder").startswith(root.rstrip("/") + "/")).filter((_levels(F.col("folder"), root) <= levels) & ~F.col("folder").rlike(r"/(\.[^/]*|node_modules)(/|$)"))
    named = inside.groupBy(F.regexp_extract("folder", "([^/]+)$", 1).alias("__name")).agg(F.min_by("path", "folder").alias("target"))
    return rows.select("source", "module", name.alias("__name")).join(unguessed(named), "__name").select("source", "module", "target")


def go(imports: DataFrame, files: DataFrame, root: str, modules: DataFrame | None = None) -> DataFrame:
    """By the nearest module above the file (config_dir, module_name), else a directory of the last segment within 3 levels; the first file that isn't a test. Standard packages and unsafe segments don't resolve."""
    rows = imports.select("source", "module").distinct().filter(F.col("source").endswith(".go") & F.split("module", "/")[0].contains(".") & ~F.col("module").rlike(r"(^|/)(\.\.)?(/|$)"))
    folders = settled(first_files(files, ".go", "_test.go"))
    named = _named_folder(rows, folders, F.element_at(F.split("module", "/"), -1), root, 3)
    if modules is None:
        return named
    near = nearest(rows.select(F.col("source").alias("path")), modules, root).withColumnRenamed("path", "source").join(unguessed(modules), "config_dir")
    own = rows.join(unguessed(near), "source").filter(F.expr("startswith(module, concat(module_name, '/'))"))
    by_module = own.withColumn("folder", F.expr("concat(config_dir, substring(module, length(module_name) + 1))")).join(unguessed(folders), "folder").select("source", "module", F.col("path").alias("target"))
    return first_resolved([by_module, named])


def java(imports: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """The package's path from the root, else the least file of the class's name within 4 levels. Standard packages and wildcards don't resolve."""
    standard = reduce(lambda c, p: c | F.col("module").startswith(p), JAVA_STANDARD[1:], F.col("module").startswith(JAVA_STANDARD[0]))
    rows = imports.select("source", "module").distinct().filter(F.col("source").endswith(".java") & ~standard & ~F.col("module").endswith(".*") & ~F.col("module").rlike(r"(^|\.)(\.|$)|/"))
    whole = pick(rows, files, F.array(F.concat(F.lit(root.rstrip("/") + "/"), F.replace(F.col("module"), F.lit("."), F.lit("/")), F.lit(".java"))))
    inside = files.filter(F.col("path").endswith(".java") & F.col("path").startswith(root.rstrip("/") + "/") & (_levels(F.col("path"), root) <= 4))
    named = inside.groupBy(F.regexp_extract("path", r"([^/]+)\.java$", 1).alias("__name")).agg(F.min("path").alias("target"))
    return first_resolved([whole, rows.withColumn("__name", F.element_at(F.split("module", r"\."), -1)).join(unguessed(named), "__name").select("source", "module", "target")])


def csharp(imports: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Ever longer suffixes of the namespace as directories below the root, the last segment first; else a directory of the last segment within 3 levels; the first file. Framework namespaces and single segments don't resolve."""
    m = F.col("module")
    framework = reduce(lambda c, p: c | (m == p) | m.startswith(p + "."), CSHARP_FRAMEWORK[1:], (m == CSHARP_FRAMEWORK[0]) | m.startswith(CSHARP_FRAMEWORK[0] + "."))
    rows = imports.select("source", "module").distinct().filter(F.col("source").endswith(".cs") & ~framework & m.contains(".") & ~m.rlike(r"(^|\.)(\.|$)|/"))
    parts = F.split(m, r"\.")
    suffixes = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda i: F.concat(F.lit(root.rstrip("/") + "/"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/")))
    folders = settled(first_files(files, ".cs"))
    return first_resolved([_by_folder(rows, folders, suffixes), _named_folder(rows, folders, F.element_at(parts, -1), root, 3)])


def swift(imports: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Module directories X/Sources/X or Sources/X at or above the file, the nearest first, else the shallowest such directory within 5 levels; the first file."""
    rows = imports.select("source", "module").distinct().filter(F.col("source").endswith(".swift"))
    folders = settled(first_files(files, ".swift"))
    m = F.col("module")
    inside = F.filter(ancestors(F.col("source")), lambda d: (d == root) | d.startswith(root.rstrip("/") + "/"))
    tried = F.flatten(F.transform(inside, lambda d: F.array(F.concat(d, F.lit("/"), m, F.lit("/Sources/"), m), F.concat(d, F.lit("/Sources/"), m))))
    deep = folders.withColumn("__name", F.regexp_extract("folder", "/Sources/([^/]+)$", 1)).filter((F.col("__name") != "") & (_levels(F.col("folder"), root) <= 5))
    any_where = deep.groupBy("__name").agg(F.min_by("path", F.struct(F.length("folder"), "folder")).alias("target"))
    return first_resolved([_by_folder(rows, folders, tried), rows.withColumn("__name", m).join(unguessed(any_where), "__name").select("source", "module", "target")])


def workspace_packages(imports: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """Packages of the workspace (name, dir, main): a subpath below the package's src or itself, else src/index, main, index."""
    parts = F.split("module", "/")
    scoped = F.col("module").startswith("@")
    name = F.when(scoped, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])
    rows = imports.select("source", "module").distinct().withColumn("name", name).join(unguessed(packages.select("name", "dir", "main")), "name")
    rest = F.expr("substring(module, length(name) + 2)")
    under = lambda sub: F.concat(F.col("dir"), F.lit("/"), sub)
    sub = F.array(under(F.concat(F.lit("src/"), rest)), under(rest))
    entry = F.array(under(F.lit("src/index")), under(F.coalesce("main", F.lit("index"))), under(F.lit("index")))
    tried = rows.select("source", "module", (rest == "").alias("__entry"), F.posexplode(F.when(rest != "", sub).otherwise(entry)).alias("ordinal", "base"))
    found = tried.join(unguessed(stems(files)), "base")
    # the main file is written whole
    found = found.filter(~F.col("__entry") | (F.col("ordinal") != 1) | (F.col("rank") == 0))
    return found.groupBy("source", "module").agg(F.min_by("path", F.struct("ordinal", "rank")).alias("target"))


def first_resolved(stages: list[DataFrame]) -> DataFrame:
    """source, module, target by the first stage that has one."""
    rows = reduce(DataFrame.unionByName, [s.select("source", "module", "target").withColumn("__n", F.lit(i)) for i, s in enumerate(stages)])
    return rows.groupBy("source", "module").agg(F.min_by("target", "__n").alias("target"))


def is_bare(module: Column) -> Column:
    return ~module.startswith(".") & ~module.startswith("/") & ~module.rlike("^[a-zA-Z]:")


def resolve(imports: DataFrame, files: DataFrame, root: str, aliases: DataFrame | None = None, go_modules: DataFrame | None = None, packages: DataFrame | None = None, exclude_node_modules: bool = True) -> DataFrame:
    """source, module, target of all imports that resolve, by the language of their source.

    Order: aliases, Rust modules, workspace packages, Python modules, other languages' rules,
    bare modules (themselves, unless excluded) and relative paths of scripts.
    """
    files, imports = settled(files.select("path").distinct()), settled(imports.select("source", "module").distinct())
    # a rule is planned only if a source is in its language
    ends = {"rust": r"\.rs$", "python": r"\.pyi?$", "java": r"\.java$", "csharp": r"\.cs$", "swift": r"\.swift$", "go": r"\.go$"}
    there = imports.agg(*(F.max(F.col("source").rlike(e)).alias(n) for n, e in ends.items())).first()
    stages = [by_alias(imports, files, aliases, root)] if aliases is not None else []
    stages += [rust(imports, files, root)] if there["rust"] else []
    if packages is not None:
        stages.append(workspace_packages(imports, files, packages))
    stages += [rule(imports, files, root) for name, rule in (("python", python), ("java", java), ("csharp", csharp), ("swift", swift)) if there[name]]
    stages += [go(imports, files, root, go_modules)] if there["go"] else []
    scripts = imports.filter(language(F.col("source")).isin("typescript", "javascript", "vue", "svelte", "graphql"))
    if not exclude_node_modules:
        stages.append(scripts.filter(is_bare(F.col("module"))).withColumn("target", F.col("module")))
    # one after the other: together their plans and exchanges are held by the driver at once
    return first_resolved([settled(stage) for stage in [*stages, relative(scripts, files)]])


def dependencies(imports: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target, type, line, module: resolved imports, of several to one file the first by line and module."""
    rows = imports.join(unguessed(targets), ["source", "module"])
    w = Window.partitionBy("source", "target").orderBy("line", "module")
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("source", "target", "type", "line", "module")
