"""Signatures, interface members and type aliases of TypeScript and JavaScript files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..schema import PARAM
from .callgraph import NAME, _definitions, _statement_end
from .lex import Lines, code_only, paren_end, split_top, without_comments

MODIFIERS = re.compile(r"^(?:(public|private|protected|readonly|override)\s+)+")
DECORATORS = re.compile(r"^(?:@\w+(?:\([^)]*\))?\s*)+")
PARAMETER = re.compile(rf"(\.\.\.)?\s*({NAME}|\{{.*?\}}|\[.*?\])\s*(\?)?\s*(?::\s*(.*))?$", re.S)
COLON, SPACES = re.compile(r"\s*:\s*"), re.compile(r"\s+")
#: Values of variables that are functions: with parameters in brackets, or with one.
ARROW, SINGLE, ASYNC = re.compile(r"=\s*(?:async\s*)?(?:<[^(]*>)?\("), re.compile(rf"=\s*(?:async\s+)?({NAME})\s*=>"), re.compile(r"=\s*async\b")
#: Rows that a task hands on at once.
ROWS = 10_000


def parameter(text: str, position: int) -> dict | None:
    text = MODIFIERS.sub("", DECORATORS.sub("", text.strip()))
    if not text:
        return None
    head, *default = split_top(text, "=") if "=>" not in text.split(":", 1)[0] else [text]
    m = PARAMETER.match(head.strip())
    if not m or m[2] == "this":
        return None
    value = "=".join(default).strip()
    kind = m[4].strip() if m[4] else _inferred(value) if value else "any"
    return {"name": SPACES.sub(" ", m[2]), "type": SPACES.sub(" ", kind), "is_optional": bool(m[3]) or bool(value), "has_default": bool(value), "is_rest": bool(m[1]), "position": position}


def _inferred(value: str) -> str:
    if re.fullmatch(r"-?[\d.]+", value):
        return "number"
    if value[:1] in "'\"`":
        return "string"
    return "boolean" if value in ("true", "false") else "any"


def parameters(text: str) -> list[dict]:
    found = [parameter(p, i) for i, p in enumerate(split_top(text))] if text.strip() else []
    return [p for p in found if p]


def _return_type(plain: str, code: str, at: int, stop: str) -> str | None:
    """The type written behind the parameters, up to the body or arrow."""
    m = COLON.match(code, at)
    if not m:
        return None
    start = m.end()
    depth = 0
    for i in range(start, len(code)):
        c = code[i]
        if c in "([<" or c == "{" and (depth or not code[start:i].strip()):
            depth += 1
        elif c in ")]}" or c == ">" and code[i - 1] != "=":
            depth -= 1
            if depth < 0:
                return plain[start:i].strip()
        elif not depth and (c in "{;" or code.startswith(stop, i) and stop == "=>" and code[start:i].strip() and not code[start:i].rstrip().endswith(")")):
            return SPACES.sub(" ", plain[start:i].strip())
    return plain[start:].strip()


def signatures(text: str) -> list[dict]:
    """name, kind, params, return_type, visibility, is_async, line (from 1) of functions, the first constructor of each class, methods as Class.name, and arrow variables."""
    plain, code, lines = without_comments(text), code_only(text), Lines(text)
    out: dict[str, dict] = {}
    around: list = []  # classes that began, of which those on top that ended are taken off
    covered = 0  # where the functions so far end
    for d in _definitions(code, "typescript"):
        while around and around[-1].end <= d.start:
            around.pop()
        if d.kind == "class":
            around.append(d)
        if d.kind not in ("function", "method", "variable"):
            continue
        inside, covered = d.start < covered, max(covered, d.end)
        if inside:
            continue
        before = code[d.first : d.start]
        if d.kind == "variable":
            eq = code.find("=", d.start)
            bracket = m.end() - 1 if eq >= 0 and (m := ARROW.match(code, eq)) else -1
        else:
            eq, bracket = d.start, code.find("(", d.start)
        if bracket < 0:
            single = SINGLE.match(code, eq) if eq >= 0 else None
            if not single:
                continue
            params, at = [{"name": single[1], "type": "any", "is_optional": False, "has_default": False, "is_rest": False, "position": 0}], single.end()
        else:
            close = paren_end(code, bracket)
            params, at = parameters(plain[bracket + 1 : close]), close + 1
        name = f"{around[-1].name}.{d.name}" if around and d.kind == "method" else d.name
        ctor = d.kind == "method" and d.name == "constructor"
        is_async = bool(re.search(r"\basync\b", before)) or d.kind == "variable" and bool(ASYNC.match(code, eq)) or d.kind == "function" and bool(re.search(r"\basync\s+$", code[max(0, d.first - 8) : d.first]))
        returned = around[-1].name if ctor and around else _return_type(plain, code, at, "=>" if d.kind == "variable" else "{") or ("Promise<any>" if is_async else "any")
        seen = re.search(r"\b(public|private|protected)\b", before)
        kind = "constructor" if ctor else "method" if d.kind == "method" else "function" if d.kind == "function" else "arrow"
        out.setdefault(name, {"symbol": name, "kind": kind, "params": params, "return_type": returned, "visibility": None if kind not in ("method",) else seen[1] if seen else "public", "is_async": is_async, "line": lines.at(d.start) + 1})
    return list(out.values())


def interface_members(text: str) -> list[dict]:
    """symbol (the interface), name, kind, type, is_optional, is_readonly."""
    plain, code = without_comments(text), code_only(text)
    out = []
    for d in _definitions(code, "typescript"):
        if d.kind != "interface":
            continue
        start = code.index("{", d.start)
        for part in re.split(r"[;\n]|,(?![^<(]*[>)])", plain[start + 1 : d.end - 1]):
            m = re.match(rf"\s*(readonly\s+)?({NAME})\s*(\?)?\s*(\(.*\)\s*)?(?::\s*(.*?))?\s*$", part, re.S)
            if m and (m[4] or m[5]):
                kind = f"{m[4].strip()} => {m[5] or 'any'}" if m[4] else m[5]
                out.append({"symbol": d.name, "name": m[2], "kind": "method" if m[4] else "property", "type": SPACES.sub(" ", kind), "is_optional": bool(m[3]), "is_readonly": bool(m[1])})
    return out


def type_aliases(text: str) -> list[dict]:
    """symbol, type."""
    plain, code = without_comments(text), code_only(text)
    found = []
    for d in _definitions(code, "typescript"):
        if d.kind == "type":
            start = code.index("=", d.start) + 1
            found.append({"symbol": d.name, "type": SPACES.sub(" ", plain[start : _statement_end(code, start)].strip().rstrip(";"))})
    return found


def extract_signatures(files: DataFrame, version: str) -> DataFrame:
    """version, path, symbol, kind, return_type, visibility, is_async, line, params of files (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["version", "path", "symbol", "kind", "return_type", "visibility", "is_async", "line", "params"]
        for batch in batches:
            for p, t in zip(batch["path"], batch["text"], strict=True):
                found = signatures(t) if t else []
                for at in range(0, len(found), ROWS):
                    yield pd.DataFrame([{"version": version, "path": p, **s} for s in found[at : at + ROWS]], columns=columns)

    return files.select("path", "text").mapInPandas(run, f"version string, path string, symbol string, kind string, return_type string, visibility string, is_async boolean, line int, params array<{PARAM}>")


def _flat(files: DataFrame, version: str, read, kinds: str) -> DataFrame:
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"version": version, "path": p, **s} for p, t in zip(batch["path"], batch["text"], strict=True) if t for s in read(t)]
            yield pd.DataFrame(rows, columns=["version", "path", *names])

    return files.select("path", "text").mapInPandas(run, "version string, path string, " + kinds)


def extract_interface_members(files: DataFrame, version: str) -> DataFrame:
    return _flat(files, version, interface_members, "symbol string, name string, kind string, type string, is_optional boolean, is_readonly boolean")


def extract_type_aliases(files: DataFrame, version: str) -> DataFrame:
    return _flat(files, version, type_aliases, "symbol string, type string")
