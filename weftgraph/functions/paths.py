"""Column functions over paths, names and extensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Extensions, their languages, directories that are never analysed.
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".gql", ".graphql", ".py", ".pyi", ".rs", ".toml", ".cs", ".csproj", ".go", ".java", ".swift")
SOURCE_FILE = r"\.(ts|tsx|js|jsx|vue|svelte|gql|graphql|py|pyi|rs|toml|cs|csproj|go|java|swift)$"
LANGUAGE = {
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "python": (".py", ".pyi"),
    "rust": (".rs",),
    "vue": (".vue",),
    "svelte": (".svelte",),
    "graphql": (".gql", ".graphql"),
    "csharp": (".cs", ".csproj"),
    "go": (".go",),
    "java": (".java",),
    "swift": (".swift",),
}
CALL_GRAPH_LANGUAGE = {
    "typescript": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte"),
    "python": (".py", ".pyi"),
    "rust": (".rs",),
    "csharp": (".cs",),
    "go": (".go",),
    "java": (".java",),
    "swift": (".swift",),
}
IGNORED_DIRECTORIES = ("node_modules", ".git", "dist", "build", "out", "coverage", ".next", ".nuxt", "__pycache__", ".venv", "venv", "target")


def normalize(path: Column) -> Column:
    """Slashes for backslashes, runs of slashes as one, a drive letter in lower case, no slash at the end but a root's."""
    slash = path.rlike(r"^[/\\]")
    drive = F.regexp_extract(path, r"^([A-Za-z]:)[/\\]", 1)
    parts = F.array_join(F.filter(F.split(F.regexp_replace(path, r"^[A-Za-z]:(?=[/\\])", ""), r"[/\\]+"), lambda x: x != ""), "/")
    return F.when(drive != "", F.concat(F.lower(drive), F.lit("/"), parts)).when(slash, F.concat(F.lit("/"), parts)).otherwise(parts)


def file_name(path: Column) -> Column:
    """The last part that isn't empty, or ''."""
    return F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)


def parent_name(path: Column) -> Column:
    """The part before the last one, null if there is one part only."""
    parts = F.split(path, r"[/\\]")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    """From the last point of the file name, in lower case; '' without one or if the name only begins with it."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1))


def _by_extension(ext: Column, languages: dict[str, tuple[str, ...]]) -> Column:
    return reduce(lambda c, kv: c.when(ext.isin(*kv[1]), kv[0]), list(languages.items())[1:], F.when(ext.isin(*next(iter(languages.values()))), next(iter(languages))))


def language(path_or_extension: Column) -> Column:
    """Of a path, or of an extension with or without its point; else unknown."""
    whole = path_or_extension.rlike(r"[/\\]")
    ext = F.when(whole, extension(path_or_extension)).when(path_or_extension.startswith("."), F.lower(path_or_extension)).otherwise(F.concat(F.lit("."), F.lower(path_or_extension)))
    return _by_extension(ext, LANGUAGE).otherwise("unknown")


def call_graph_language(path: Column) -> Column:
    """The language whose rules extract calls from a file: JavaScript counts as TypeScript; null for files without any."""
    return _by_extension(extension(path), CALL_GRAPH_LANGUAGE)


def is_source_file(path: Column) -> Column:
    return path.rlike(SOURCE_FILE)


def in_skipped_directory(path: Column, exclude_node_modules: bool = True) -> Column:
    """Whether a walk would not have entered some directory above the file: ignored ones and those that begin with a point."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    names = [d for d in IGNORED_DIRECTORIES if exclude_node_modules or d != "node_modules"]
    return F.exists(parts, lambda p: p.isin(*names) | (p.startswith(".") & ~p.isin(".", "..")))


def in_ignored_directory(path: Column) -> Column:
    """Whether a part before the last one is an ignored directory."""
    parts = F.split(normalize(path), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED_DIRECTORIES)))


def ancestors(path: Column) -> Column:
    """Directories above a normal path, the nearest first, down to the top one."""
    parts = F.split(path, "/")
    ups = F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))
    return F.when(F.size(parts) > 1, F.transform(ups, lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def shared_segments(a: Column, b: Column) -> Column:
    """How many leading directories two files share (the empty one before the first slash counts)."""
    p, q = (F.slice(F.split(x, "/"), 1, F.greatest(F.size(F.split(x, "/")) - 1, F.lit(0))) for x in (a, b))
    same = F.zip_with(p, q, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same).cast("long"))


def relative(path: Column, root: str) -> Column:
    """The path below the root; a path outside stays as it is."""
    root = root.rstrip("/")
    return F.when(path == root, "").when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path)


def module_path(path: Column, root: str) -> Column:
    """Points for the slashes of the path below the root, without a known ending."""
    p = F.replace(relative(path, root), F.lit("/"), F.lit("."))
    return reduce(lambda c, e: F.regexp_replace(c, rf"\.{e}$", ""), ("py", "ts", "js", "tsx", "jsx"), p)


def path_of_symbol(symbol_id: Column) -> Column:
    """The file of "path:name"; a drive letter's colon isn't a separator."""
    return F.regexp_extract(symbol_id, r"^((?:[A-Za-z]:)?[^:]*)", 1)


def name_of_symbol(symbol_id: Column) -> Column:
    return F.element_at(F.split(symbol_id, ":"), -1)


def is_external_package(path: Column) -> Column:
    """A bare package: no known extension, not relative, absolute or on a drive, and without a slash unless under node_modules."""
    known = reduce(lambda c, e: c | path.endswith(e), EXTENSIONS[1:], path.endswith(EXTENSIONS[0]))
    local = path.startswith(".") | path.startswith("/") | path.rlike("^[a-zA-Z]:")
    inside = path.rlike(r"[/\\]") & ~path.contains("node_modules")
    return F.coalesce((path != "") & ~known & ~local & ~inside, F.lit(False))


def labels(nodes: DataFrame, path_col: str = "path", custom: str | None = None) -> DataFrame:
    """label: the custom one, else the file name, after its parent where several nodes have that name."""
    name = file_name(F.col(path_col))
    repeated = F.count(F.lit(1)).over(Window.partitionBy(name)) > 1
    label = F.when(repeated & parent_name(F.col(path_col)).isNotNull(), F.concat_ws("/", parent_name(F.col(path_col)), name)).otherwise(name)
    return nodes.withColumn("label", F.coalesce(F.col(custom), label) if custom else label)


def scoped_label(module: Column) -> Column:
    """The module itself if it is a scoped package; null otherwise."""
    return F.when(module.startswith("@") & module.contains("/") & ~module.startswith("@/"), module)
