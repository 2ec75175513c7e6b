"""Error classes, symbol categories, text measures and node layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of symbols by category, and error codes that don't end a run.
CATEGORY = {
    "function": ("FunctionDeclaration", "ArrowFunction", "MethodDeclaration", "GetAccessor", "SetAccessor"),
    "class": ("ClassDeclaration",),
    "interface": ("InterfaceDeclaration",),
    "type": ("TypeAliasDeclaration",),
    "variable": ("VariableDeclaration", "PropertyDeclaration", "EnumDeclaration"),
}
TYPE_ONLY_KINDS = ("InterfaceDeclaration", "TypeAliasDeclaration", "TypeParameter")
RECOVERABLE = ("FILE_NOT_FOUND", "PERMISSION_DENIED", "PARSE_ERROR", "RESOLUTION_FAILED")


def category(kind: Column) -> Column:
    out = F.lit("other")
    for name, kinds in CATEGORY.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def is_runtime(kind: Column) -> Column:
    return ~kind.isin(*TYPE_ONLY_KINDS)


def error(code: Column, message: Column) -> Column:
    """Struct of code and recoverable, from an operating system's code and a message."""
    kind = (
        F.when(code == "ENOENT", "FILE_NOT_FOUND")
        .when(code.isin("EACCES", "EPERM"), "PERMISSION_DENIED")
        .when((code == "EFBIG") | message.contains("too large"), "FILE_TOO_LARGE")
        .when(message.contains("parse") | message.contains("syntax"), "PARSE_ERROR")
        .when((code == "ETIMEDOUT") | message.contains("timeout"), "TIMEOUT")
        .otherwise("UNKNOWN")
    )
    return F.struct(kind.alias("code"), kind.isin(*RECOVERABLE).alias("recoverable"))


def line_count(text: Column) -> Column:
    """Lines by line feed, with or without carriage return; one empty line at the end doesn't count, null and empty have none."""
    lines = F.size(F.split(text, "\r?\n"))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(lines - text.endswith("\n").cast("int")).cast("long")


def scripts(text: Column) -> Column:
    """Bodies of all script elements, joined by line ends."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(?is)<script[^>]*>(.*?)</script\s*[^>]*>"), 1), "\n")


def node_width(label: Column) -> Column:
    return F.greatest(F.lit(120), F.least(F.lit(300), F.length(label) * 7 + 24)).cast("long")


def layered(nodes: DataFrame, depth: str = "depth", order: str = "id") -> DataFrame:
    """x and y of columns by depth, rows in order."""
    at = F.row_number().over(Window.partitionBy(depth).orderBy(order)) - 1
    return nodes.withColumns({"x": (F.col(depth) * 260).cast("double"), "y": (at * 64).cast("double")})


def radial(nodes: DataFrame, depth: str = "depth", order: str = "id") -> DataFrame:
    """x and y on circles by depth, nodes evenly spread in order."""
    at = F.row_number().over(Window.partitionBy(depth).orderBy(order)) - 1
    angle = 2 * F.pi() * at / F.count(F.lit(1)).over(Window.partitionBy(depth))
    return nodes.withColumns({"x": F.col(depth) * 250 * F.cos(angle), "y": F.col(depth) * 250 * F.sin(angle)})


def bounding_box(nodes: DataFrame) -> DataFrame:
    """One row: left, top, width, height of points x, y; nulls without points."""
    return nodes.agg(F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"))


def progress(done: Column, total: Column, elapsed_ms: Column) -> Column:
    """Struct of percent and the milliseconds left at the pace so far."""
    return F.struct(
        F.when(total > 0, F.round(done * 100 / total)).otherwise(0).cast("long").alias("percent"),
        F.when((done > 0) & (total > 0), F.round(elapsed_ms / done * (total - done))).cast("long").alias("left_ms"),
    )
