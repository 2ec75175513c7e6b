"""Imports of source files: one row for each module a file names."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .lex import Lines, code_only, without_comments

Row = tuple[str, str, int]

# Patterns of what TypeScript, JavaScript and GraphQL import, in order of priority; side-effect imports name nothing and don't count.
_CLAUSE = r"\s+(?:[^;'\"]|'[^']*'|\"[^\"]*\")*?\s+from\s+['\"]([^'\"]+)['\"]"
SCRIPT = (
    ("import", re.compile("import" + _CLAUSE)),
    ("export", re.compile("export" + _CLAUSE)),
    ("require", re.compile(r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")),
    ("dynamic", re.compile(r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")),
)
GRAPHQL = re.compile(r"#import\s+['\"]([^'\"]+)['\"]")
SFC_SCRIPT = re.compile(r"<script[^>]*>(.*?)</script\s*[^>]*>", re.S | re.I)


def _once(rows: list[Row]) -> list[Row]:
    """The first row of each module."""
    seen: dict[str, Row] = {}
    for r in rows:
        seen.setdefault(r[0], r)
    return list(seen.values())


def script(text: str) -> list[Row]:
    plain, lines = without_comments(text), Lines(text)
    return _once([(m[1], kind, lines.at(m.start()) + 1) for kind, pattern in SCRIPT for m in pattern.finditer(plain)])


def graphql(text: str) -> list[Row]:
    lines = Lines(text)
    return _once([(m[1], "import", lines.at(m.start()) + 1) for m in GRAPHQL.finditer(text)])


def python(text: str) -> list[Row]:
    """A syntax error raises. An aliased plain import isn't counted."""
    rows: list[Row] = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Import):
            rows += [(a.name, "import", node.lineno) for a in node.names if a.asname is None]
        elif isinstance(node, ast.ImportFrom):
            rows.append(("." * node.level + (node.module or ""), "import", node.lineno))
    return _once(sorted(rows, key=lambda r: r[2]))


def rust(text: str) -> list[Row]:
    """use paths (without their last braces, stars and aliases), modules without a body, extern crates; in lower case, without single capitalised names."""
    code, lines, rows = code_only(text, "rust"), Lines(text), []
    for m in re.finditer(r"\buse\s+([^;{]+?)\s*(?:::\s*\{[^;]*\}|::\s*\*)?\s*;|\bmod\s+(\w+)\s*;|\bextern\s+crate\s+(\w+)", code):
        name = re.sub(r"\s+as\s+\w+$|\s", "", m[1]) if m[1] else m[2] or m[3]
        if name and not (re.fullmatch(r"[A-Z]\w*", name) and m[1]):
            rows.append((name.lower(), "import", lines.at(m.start()) + 1))
    return _once(rows)


def go(text: str) -> list[Row]:
    code, lines, rows = without_comments(text), Lines(text), []
    for m in re.finditer(r"^import\s*(\((?P<many>.*?)\)|(?:[\w.]+\s+)?[\"`](?P<one>[^\"`]+)[\"`])", code, re.S | re.M):
        if m["one"]:
            rows.append((m["one"], "import", lines.at(m.start("one")) + 1))
        else:
            rows += [(x[1], "import", lines.at(m.start("many") + x.start()) + 1) for x in re.finditer(r"[\"`]([^\"`]+)[\"`]", m["many"])]
    return rows


def java(text: str) -> list[Row]:
    code, lines = code_only(text), Lines(text)
    return [(re.sub(r"\s", "", m[1]), "import", lines.at(m.start()) + 1) for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.\s]+(?:\.\s*\*)?)\s*;", code, re.M)]


def csharp(text: str) -> list[Row]:
    """The first name of a directive, so an alias counts by its own name."""
    code, lines = code_only(text), Lines(text)
    return [(m[1], "import", lines.at(m.start(1)) + 1) for m in re.finditer(r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*(?:=[^;(]*)?;", code, re.M)]


def swift(text: str) -> list[Row]:
    code, lines = code_only(text, "swift"), Lines(text)
    found = re.finditer(r"^\s*(?:@\w+\s+)?import\s+(?:(?:struct|class|enum|protocol|func|var|let|typealias)\s+)?([\w.]+)", code, re.M)
    return _once([(m[1], "import", lines.at(m.start(1)) + 1) for m in found])


BY_LANGUAGE = {"typescript": script, "javascript": script, "python": python, "rust": rust, "go": go, "java": java, "csharp": csharp, "swift": swift, "graphql": graphql}
BY_ENDING = {".gql": graphql, ".graphql": graphql, ".vue": script, ".svelte": script}


def of_file(path: str, lang: str | None, text: str) -> list[Row]:
    ending = path[path.rfind(".") :] if "." in path else ""
    if ending in (".vue", ".svelte") and "<script" in text:
        text = "\n".join(SFC_SCRIPT.findall(text))
    f = BY_ENDING.get(ending) or BY_LANGUAGE.get(lang or "")
    return f(text) if f else []


def extract_imports(files: DataFrame) -> DataFrame:
    """source, module, type, line (from 1), error of files (path, lang, text). A file that can't be read gives one row with an error; null text gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, lang, text in zip(batch["path"], batch["lang"], batch["text"], strict=True):
                if text is None:
                    continue
                try:
                    rows += [(path, *r, None) for r in of_file(path, lang, text)]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, None, None, None, f"PARSE_ERROR: {e}"))
            yield pd.DataFrame(rows, columns=["source", "module", "type", "line", "error"]).astype({"line": "Int64"})

    return files.select("path", "lang", "text").mapInPandas(run, "source string, module string, type string, line long, error string")
