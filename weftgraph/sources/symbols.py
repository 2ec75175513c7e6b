"""Symbols of files and what they depend on, at the level of names: "path:name".

A file's import map says which module each local name comes from; a symbol
depends on the imported names and the file's own symbols that occur in its text.
Targets in other files are named by module, to be joined with resolved imports.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .callgraph import NAME, Definition, _by_rules, _python
from .lex import Lines, code_only, without_comments

KINDS = {"function": "FunctionDeclaration", "class": "ClassDeclaration", "method": "MethodDeclaration", "interface": "InterfaceDeclaration", "type": "TypeAliasDeclaration", "variable": "VariableDeclaration"}
CATEGORIES = {"function": "function", "method": "function", "class": "class", "interface": "interface", "type": "type", "variable": "variable"}
IMPORT = re.compile(r"\bimport\s+(?P<t>type\s+)?(?P<c>[^;'\"]*?)\s+from\s+['\"](?P<m>[^'\"]+)['\"]")
VALUE = re.compile(rf"(?:^|[;{{}}])[ \t]*(?:export\s+)?(?:declare\s+)?(?:const|let|var|enum)\s+(?P<n>{NAME})", re.M)


def import_map(text: str, lang: str) -> dict[str, tuple[str, str, bool]]:
    """Local name to (module, name there, type only). A namespace's name there is *, a default's is default."""
    out: dict[str, tuple[str, str, bool]] = {}
    if lang == "python":
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, ast.ImportFrom):
                out.update({a.asname or a.name: ("." * node.level + (node.module or ""), a.name, False) for a in node.names})
            elif isinstance(node, ast.Import):
                out.update({a.asname or a.name.split(".")[0]: (a.name, "*", False) for a in node.names})
        return out
    if lang == "rust":
        for m in re.finditer(r"\buse\s+([\w:]+?)(?:::\{([^}]*)\}|::(\w+)(?:\s+as\s+(\w+))?)\s*;", code_only(text, lang)):
            for part in (m[2] or "").split(",") if m[2] else [f"{m[3]} as {m[4]}" if m[4] else m[3]]:
                name, _, alias = part.strip().partition(" as ")
                if name:
                    out[alias.strip() or name] = (m[1].lower(), name, False)
        return out
    if lang not in ("typescript", "javascript"):
        return out
    for m in IMPORT.finditer(without_comments(text)):
        whole, clause = bool(m["t"]), m["c"].strip()
        named = re.search(r"\{([^}]*)\}", clause)
        for part in named[1].split(",") if named else ():
            p = re.match(rf"\s*(type\s+)?({NAME})(?:\s+as\s+({NAME}))?\s*$", part)
            if p:
                out[p[3] or p[2]] = (m["m"], p[2], whole or bool(p[1]))
        rest = re.sub(r"\{[^}]*\}", "", clause)
        space = re.search(rf"\*\s+as\s+({NAME})", rest)
        if space:
            out[space[1]] = (m["m"], "*", whole)
        default = re.match(rf"\s*({NAME})\s*(?:,|$)", rest)
        if default:
            out[default[1]] = (m["m"], "default", whole)
    return out


EXPORTS = re.compile(rf"\bexport\s*(?:default\s+({NAME})\b|\{{([^}}]*)\}}(?!\s*from))")


def _exported_names(code: str) -> set[str]:
    """Names in export clauses and default exports."""
    return {name for m in EXPORTS.finditer(code) for name in ([m[1]] if m[1] else re.findall(NAME, m[2]))}


def _is_exported(code: str, lang: str, d: Definition, listed: set[str]) -> bool:
    if lang == "python":
        return not d.name.startswith("_")
    before = code[max(0, d.start - 80) : d.start].rpartition("\n")[2]
    if lang == "rust":
        return bool(re.search(r"\bpub\b", before))
    if lang == "swift":
        return not re.search(r"\b(?:private|fileprivate)\b", before)
    if lang in ("typescript", "javascript"):
        return d.exported or d.name in listed or bool(re.match(r"\s*export\b", before))
    return bool(re.search(r"\bpublic\b", before)) or lang == "go" and d.name[:1].isupper()


def analyse(path: str, lang: str, text: str) -> tuple[list[dict], list[dict]]:
    """Rows of symbols and of dependencies. Of symbols of one id the last stays; members of TypeScript classes are named Class.member."""
    script = lang in ("typescript", "javascript")
    code = text if lang == "python" else code_only(text, lang)
    defs = (_python(text) if lang == "python" else _by_rules(text, lang))[0]
    if script:
        arrows = {d.start for d in defs}
        for m in VALUE.finditer(code):
            if m.start("n") not in arrows:
                end = code.find("\n", m.end())
                exported = "export" in m[0]
                stop = code.find(";", m.end())
                end = min(x for x in (end, stop, len(code)) if x >= 0)
                defs.append(Definition("variable", m["n"], m.start("n"), end, m.start("n"), exported))
        # what stands in a block, but for members of classes, is local to it
        defs.sort(key=lambda d: d.start)
        depth, last, outer = 0, 0, []
        for d in defs:
            depth += code.count("{", last, d.start) - code.count("}", last, d.start)
            last = d.start
            if not depth or d.kind == "method":
                outer.append(d)
        held = [d for d in outer if d.kind == "class"]
        defs = [d for d in outer if d.kind != "method" or any(c.start < d.start < c.end for c in held)]
    lines, names = Lines(text), import_map(text, lang)
    plain, listed = (without_comments(text), _exported_names(code)) if script else ("", set())
    around: list[tuple[Definition, str]] = []
    symbols: dict[str, dict] = {}
    kept: list[tuple[Definition, str]] = []
    for d in defs:
        around = [(a, i) for a, i in around if a.end > d.start]
        parent = around[-1] if around else None
        if parent and (parent[0].kind != "class" or script and d.kind != "method"):
            if lang != "python" or parent[0].kind != "class":
                continue  # local to a function
        name = f"{parent[0].name}.{d.name}" if script and parent else d.name
        kind = "AsyncFunction" if lang == "python" and text.startswith("async", d.first) else KINDS[d.kind]
        if script and d.kind == "method" and re.search(r"\bstatic\b", code[d.first : d.start]):
            kind = "Static" + kind
        sid = f"{path}:{name}"
        symbols.pop(sid, None)
        symbols[sid] = {"id": sid, "path": path, "name": name, "kind": kind, "category": CATEGORIES[d.kind], "line": lines.at(d.start) + 1, "is_exported": _is_exported(code, lang, d, listed) if not (script and parent) else parent[0].exported, "parent_symbol_id": parent[1] if parent else None}
        kept.append((d, sid))
        if d.kind == "class" or lang == "python":
            around.append((d, sid))
    own = {d.name: sid for d, sid in kept if symbols.get(sid, {}).get("parent_symbol_id") is None}
    deps: dict[tuple, dict] = {}

    member_of, colon = re.compile(rf"\s*\.\s*({NAME})"), re.compile(r"\s*:")

    def scan(source: str, start: int, part: str) -> None:
        """part: the code from start on, and a character or more behind it."""
        for m in re.finditer(NAME, part):
            name, at = m[0], start + m.start()
            line = lines.at(at) + 1
            if name in names and (script or not colon.match(part, m.end())):
                module, there, types = names[name]
                if there == "*":
                    member = member_of.match(part, m.end())
                    there = member[1] if member else "*"
                deps.setdefault((source, module, there), {"source_symbol_id": source, "source_path": path, "module": module, "target_name": there, "is_type_only": types, "line": line})
            elif name in own and own[name] != source and not part[max(0, m.start() - 3) : m.start()].rstrip().endswith("."):
                deps.setdefault((source, None, name), {"source_symbol_id": source, "source_path": path, "module": None, "target_name": name, "is_type_only": False, "line": line})

    tops = [(d, sid) for d, sid in kept if symbols[sid]["parent_symbol_id"] is None]
    for d, sid in kept:
        if d.kind != "class":
            scan(sid, d.start + len(d.name), code[d.start + len(d.name) : d.end])
        else:
            line_end = code.find("\n", d.start)
            scan(sid, d.start + len(d.name), code[d.start + len(d.name) : line_end if lang == "python" and line_end > 0 else d.end])
    if script:  # usage outside all symbols
        at = 0
        for d, _ in [*tops, (None, "")]:
            end = d.first if d else len(code)
            if end > at:
                part = IMPORT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), plain[at:end])
                scan(f"{path}:(file)", at, re.sub(r"\b(?:import|export)\b[^;\n]*", lambda m: " " * len(m[0]), part) + " ")
            at = max(at, d.end) if d else at
        for m in re.finditer(r"\bimport\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", plain):
            holder = next((sid for d, sid in reversed(kept) if d.start <= m.start() < d.end), f"{path}:(file)")
            deps.setdefault((holder, m[1], "default"), {"source_symbol_id": holder, "source_path": path, "module": m[1], "target_name": "default", "is_type_only": False, "line": lines.at(m.start()) + 1})
    return sorted(symbols.values(), key=lambda s: (not s["is_exported"], s["line"])), list(deps.values())


def analyse_files(files: DataFrame) -> DataFrame:
    """path, symbols, deps, error: one row for each of files (path, lang, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, lang, text in zip(batch["path"], batch["lang"], batch["text"], strict=True):
                try:
                    rows.append((path, *(analyse(path, lang, text or "") if lang else ([], [])), None))
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, [], [], f"PARSE_ERROR: {e}"))
            yield pd.DataFrame(rows, columns=["path", "symbols", "deps", "error"])

    symbol = "struct<id string, path string, name string, kind string, category string, line long, is_exported boolean, parent_symbol_id string>"
    dep = "struct<source_symbol_id string, source_path string, module string, target_name string, is_type_only boolean, line long>"
    return files.select("path", "lang", "text").mapInPandas(run, f"path string, symbols array<{symbol}>, deps array<{dep}>, error string")


def file_symbols(analysed: DataFrame) -> DataFrame:
    return analysed.select(F.inline("symbols"))


def symbol_deps(analysed: DataFrame, targets: DataFrame) -> DataFrame:
    """source_symbol_id, source_path, target_symbol_id, target_path, is_type_only, line; targets: resolved imports (source, module, target). Imports that don't resolve are left out."""
    rows = analysed.select(F.inline("deps"))
    to = targets.select(F.col("source").alias("source_path"), "module", F.col("target").alias("target_path"))
    inner = rows.filter("module IS NULL").withColumn("target_path", F.col("source_path"))
    outer = rows.filter("module IS NOT NULL").join(to, ["source_path", "module"])
    both = inner.unionByName(outer.select(*inner.columns))
    return both.select("source_symbol_id", "source_path", F.concat_ws(":", "target_path", "target_name").alias("target_symbol_id"), "target_path", "is_type_only", "line")


def export_graph(analysed: DataFrame) -> DataFrame:
    """src, dst: exported symbols, and the exported symbols of their file that their text mentions."""
    exported = file_symbols(analysed).filter("is_exported").select("id")
    inner = analysed.select(F.inline("deps")).filter("module IS NULL").select(F.col("source_symbol_id").alias("src"), F.concat_ws(":", "source_path", "target_name").alias("dst")).distinct()
    return inner.join(exported.withColumnRenamed("id", "src"), "src", "left_semi").join(exported.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
