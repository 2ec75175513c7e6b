"""Symbols and typed relations of source files: definitions and references by the rules of each language.

Python is read by its own grammar, other languages by patterns over text whose
comments and strings are blanked. A reference belongs to the innermost definition
around it, or to none, and then doesn't count. Its target is the first definition
of that name in the file, else a stub. Calls on members count only if their
target is in the file, but in Go, where packages are called that way, and Java.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname
from ..schema import EDGES, STUB, SYMBOLS
from .lex import Lines, block_end, code_only, paren_end, split_top

NAME = r"[A-Za-z_$][\w$]*"
# Words before a parenthesis that aren't calls, and words that aren't names of types.
NOT_CALLED = frozenset("if for while switch catch function return typeof new await super import async match fn func def guard using lock sizeof nameof defer go select when else do try throw in of loop where unless elif and or not is as".split())


@dataclass
class Definition:
    kind: str
    name: str
    start: int  # of the name
    end: int
    first: int  # of the declaration
    exported: bool = False


@dataclass
class Reference:
    relation: str
    name: str
    at: int
    member: bool = False


@dataclass
class Rules:
    """definitions: (kind, pattern with group n, body: block or none); supers: patterns whose group `bases` lists names, by relation."""

    definitions: list[tuple[str, re.Pattern]]
    supers: list[tuple[str, re.Pattern]] = field(default_factory=list)
    uses: re.Pattern | None = None
    keep_members: bool = False
    method_in: re.Pattern | None = None  # methods: a pattern of names within the bodies of classes
    method_kind: str = "method"


def _p(text: str) -> re.Pattern:
    return re.compile(text.replace("NAME", NAME), re.M)


_TYPE_PARAMS = r"(?:<[^<>(){};]*(?:<[^<>]*>[^<>(){};]*)*>)?"
RULES = {
    "typescript": Rules(
        [
            ("function", _p(r"\bfunction\s*\*?\s*(?P<n>NAME)")),
            ("variable", _p(rf"\b(?:const|let|var)\s+(?P<n>NAME)\s*(?::[^=;\n]+)?=\s*(?:async\s*)?{_TYPE_PARAMS}(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|NAME)\s*(?::[^=;{{}}\n]+)?=>")),
            ("class", _p(r"\bclass\s+(?!extends\b)(?P<n>NAME)")),
            ("interface", _p(r"\binterface\s+(?P<n>NAME)(?=[^;(]*\{)")),
            ("type", _p(rf"\btype\s+(?P<n>NAME)\s*{_TYPE_PARAMS}\s*=")),
        ],
        [
            ("INHERITS", _p(r"\bclass\s+(?:NAME\s*)?(?:<[^{]*?>\s*)?extends\s+(?P<bases>NAME(?:\s*\.\s*NAME)*)")),
            ("IMPLEMENTS", _p(r"\bclass\b[^{;]*?\bimplements\s+(?P<bases>[^{]+)")),
        ],
        _p(r"(?:[:|&]\s*|\btype\s+NAME\s*" + _TYPE_PARAMS + r"\s*=\s*|\bas\s+|<\s*|,\s*(?=[A-Z])|\bextends\s+|\bimplements\s+|=>\s*)(?P<n>[A-Z][\w$]*)(?=\s*(?:[;,)\]>=|&{\[<]|$))"),
        method_in=_p(r"(?<![.\w$])(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?\s*(?P<n>#?NAME)\s*" + _TYPE_PARAMS + r"\((?=[^;]*?\{)"),
    ),
    "rust": Rules(
        [
            ("function", _p(r"\bfn\s+(?P<n>NAME)")),
            ("class", _p(r"\b(?:struct|enum)\s+(?P<n>NAME)")),
            ("interface", _p(r"\btrait\s+(?P<n>NAME)")),
            ("type", _p(r"\btype\s+(?P<n>NAME)")),
        ],
        [("IMPLEMENTS", _p(r"\bimpl\s*(?:<[^{]*?>)?\s*(?P<bases>[\w:]+)(?:<[^{]*?>)?\s+for\b"))],
        _p(r"(?:[:&<(,]\s*|->\s*|\bfor\s+|\bdyn\s+|\bmut\s+)(?P<n>[A-Z]\w*)"),
    ),
    "go": Rules(
        [
            ("function", _p(r"^func\s+(?P<n>NAME)\s*[\[(]")),
            ("method", _p(r"^func\s*\([^)]*\)\s*(?P<n>NAME)\s*\(")),
            ("class", _p(r"\btype\s+(?P<n>NAME)\s*(?:\[[^\]]*\])?\s*struct\b")),
            ("interface", _p(r"\btype\s+(?P<n>NAME)\s*(?:\[[^\]]*\])?\s*interface\b")),
            ("type", _p(r"\btype\s+(?P<n>NAME)\s+(?!struct\b|interface\b|=?\s*$)")),
        ],
        [],
        _p(r"(?:[\w)\]]\s+|[*\]&(]\s*)(?P<n>[A-Z]\w*)(?=\s*(?:[,){}\n]|$))"),
        keep_members=True,
    ),
    "java": Rules(
        [
            ("class", _p(r"\bclass\s+(?P<n>NAME)")),
            ("interface", _p(r"\binterface\s+(?P<n>NAME)")),
            ("type", _p(r"\benum\s+(?P<n>NAME)")),
            ("function", _p(r"(?:^|[;{}])\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^(){};]*>\s*)?(?:[\w.]+(?:<[^(){};]*>)?(?:\[\])*\s+)?(?P<n>NAME)\s*\([^;{}()]*(?:\([^)]*\)[^;{}()]*)*\)\s*(?:throws\s+[\w.,\s]+)?(?=\{)")),
        ],
        [("INHERITS", _p(r"\bclass\b[^{;]*?\bextends\s+(?P<bases>[\w.]+)")), ("IMPLEMENTS", _p(r"\bclass\b[^{;]*?\bimplements\s+(?P<bases>[^{]+)"))],
        _p(r"(?:\bnew\s+|[(<,{;]\s*|^\s*|\b(?:public|private|protected|static|final|extends|implements|return|throws)\s+)(?P<n>[A-Z]\w*)\b(?=\s*(?:[<>,(\[]|\w|$))"),
        keep_members=True,
    ),
    "csharp": Rules(
        [
            ("class", _p(r"\b(?:class|struct|record)\s+(?P<n>NAME)")),
            ("interface", _p(r"\binterface\s+(?P<n>NAME)")),
            ("type", _p(r"\benum\s+(?P<n>NAME)|\bdelegate\s+[\w<>\[\].]+\s+(?P<m>NAME)")),
            ("variable", _p(r"[\w>\]?]\s+(?P<n>NAME)\s*\{\s*(?=(?:(?:private|protected|internal)\s+)?(?:get|set|init)\b)")),
            ("function", _p(r"(?:^|[;{}])\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|extern|partial|new)\s+)*(?:[\w.]+(?:<[^(){};]*>)?(?:\[\])*\??\s+)?(?P<n>NAME)\s*(?:<[^(){};]*>)?\s*\([^;{}()]*\)\s*(?::\s*(?:base|this)\s*\([^)]*\)\s*)?(?=\{|=>)")),
        ],
        [(r, _p(r"\b(?:class|struct|record|interface)\s+NAME(?:<[^{]*?>)?\s*:\s*(?P<bases>[^{;]+)")) for r in ("INHERITS", "IMPLEMENTS")],
        _p(r"(?P<n>\bNAME\b)"),
    ),
    "swift": Rules(
        [
            ("function", _p(r"\bfunc\s+(?P<n>NAME)")),
            ("class", _p(r"\b(?:class(?!\s+(?:func|var|let)\b)|struct|enum|extension|actor)\s+(?P<n>NAME)")),
            ("interface", _p(r"\bprotocol\s+(?P<n>NAME)")),
            ("type", _p(r"\btypealias\s+(?P<n>NAME)")),
        ],
        [("INHERITS", _p(r"\b(?:class|struct|enum|extension|actor|protocol)\s+NAME(?:<[^{]*?>)?\s*:\s*(?P<bases>[^{]+)"))],
        _p(r"(?::\s*|->\s*|<\s*|\[\s*)(?P<n>[A-Z]\w*)"),
    ),
}
RULES["javascript"] = RULES["typescript"]
CALL = _p(r"(?P<before>\.\s*|::\s*|->\s*|\?\.\s*)?\b(?P<n>NAME)\s*(?:<[\w\s,.<>\[\]]*>|::<[^()]*>)?\s*\(")
# Words of C# that its rule on identifiers doesn't take for names.
CSHARP_WORDS = frozenset(
    "abstract as async await base bool break byte case catch char class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach get goto if implicit in init int "
    "interface internal is lock long namespace new null object operator out override params partial private protected public readonly record ref return sbyte sealed set short sizeof static string struct switch this throw true "
    "try typeof uint ulong unchecked unsafe ushort using value var virtual void volatile where while yield".split()
)


def _exported(code: str, lang: str, first: int) -> bool:
    if lang not in ("typescript", "javascript"):
        return False
    before = code[max(0, first - 60) : first]
    return bool(re.search(r"\bexport\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?$", before))


def _definitions(code: str, lang: str) -> list[Definition]:
    """Of text without comments and strings, by place."""
    rules = RULES[lang]
    found: dict[int, Definition] = {}
    for kind, pattern in rules.definitions:
        for m in pattern.finditer(code):
            group = "n" if m["n"] else "m"
            name, at = m[group], m.start(group)
            if name in NOT_CALLED or at in found:
                continue
            end = block_end(code, at) if kind not in ("type", "variable") or lang == "csharp" else _statement_end(code, m.end())
            found[at] = Definition(kind, name, at, end, m.start() + len(m[0]) - len(m[0].lstrip(" \t\n;{}")), _exported(code, lang, m.start()))
    if rules.method_in:
        for d in [d for d in found.values() if d.kind == "class"]:
            body = code.find("{", d.start)
            depth, at = 0, body + 1
            for m in rules.method_in.finditer(code, body + 1, d.end) if body >= 0 else ():
                depth, at = depth + code.count("{", at, m.start()) - code.count("}", at, m.start()), m.start()
                if not depth and m["n"] not in NOT_CALLED - {"is", "of", "in", "not", "and", "or"} and m.start("n") not in found:
                    end = block_end(code, paren_end(code, m.end() - 1))
                    found[m.start("n")] = Definition(rules.method_kind, m["n"].lstrip("#"), m.start("n"), end, m.start())
    return sorted(found.values(), key=lambda d: d.start)


def _by_rules(text: str, lang: str) -> tuple[list[Definition], list[Reference]]:
    rules, code = RULES[lang], code_only(text, lang)
    defs = _definitions(code, lang)
    found = {d.start for d in defs}
    refs: list[Reference] = []
    for m in CALL.finditer(code):
        member = (m["before"] or "").strip() in (".", "?.")
        if (member or m["n"] not in NOT_CALLED) and m.start("n") not in found:
            refs.append(Reference("CALLS", m["n"], m.start("n"), member))
    for relation, pattern in rules.supers:
        for m in pattern.finditer(code):
            for part in split_top(m["bases"]):
                base = re.search(rf"({NAME})\s*(?:<.*)?$", part.strip(), re.S) or re.match(rf"\s*({NAME})", part)
                if base:
                    refs.append(Reference(relation, base[1], m.start("bases") + max(0, m["bases"].find(base[1]))))
    if lang == "go":
        for m in re.finditer(r"\bstruct\s*\{([^}]*)\}", code):
            refs += [Reference("INHERITS", x[1], m.start(1) + x.start(1)) for x in re.finditer(r"(?:^|[\s*\].])([A-Z]\w*)\s*(?:$|`)", m[1], re.M)]
    if rules.uses:
        # the base of a script's class is a value and no type
        bases = {r.at for r in refs if r.relation == "INHERITS"} if lang in ("typescript", "javascript") else ()
        for m in rules.uses.finditer(code):
            if m.start("n") not in found and m.start("n") not in bases and not (lang == "csharp" and m["n"] in CSHARP_WORDS):
                refs.append(Reference("USES", m["n"], m.start("n")))
    return defs, sorted(refs, key=lambda r: r.at)


GOES_ON, LINE_GOES_ON = re.compile(r"\s*[|&\[]"), re.compile(r"\s*[.?:|&=]")


def _statement_end(code: str, at: int) -> int:
    """Behind a declaration that may have a block as its value."""
    depth = 0
    for i in range(at, len(code)):
        c = code[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return i
            if not depth and c == "}" and not GOES_ON.match(code, i + 1):
                return i + 1
        elif c == ";" and not depth or c == "\n" and not depth and code[at:i].strip() and not LINE_GOES_ON.match(code, i + 1):
            return i
    return len(code)


def _python(text: str) -> tuple[list[Definition], list[Reference]]:
    starts = Lines(text).starts
    raw = text.split("\n")

    def offset(line: int, column: int) -> int:
        return starts[line - 1] + len(raw[line - 1].encode()[:column].decode(errors="ignore"))

    defs: list[Definition] = []
    refs: list[Reference] = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            first = offset(node.lineno, node.col_offset)
            name = text.index(node.name, first)
            defs.append(Definition("class" if isinstance(node, ast.ClassDef) else "function", node.name, name, offset(node.end_lineno, node.end_col_offset), first))
            if isinstance(node, ast.ClassDef):
                for base in node.bases:
                    target = base.attr if isinstance(base, ast.Attribute) else base.id if isinstance(base, ast.Name) else None
                    if target:
                        refs.append(Reference("INHERITS", target, offset(base.lineno, base.col_offset)))
        elif isinstance(node, ast.Call):
            f, at = node.func, offset(node.lineno, node.col_offset)
            if isinstance(f, ast.Name):
                refs.append(Reference("CALLS", f.id, at))
            elif isinstance(f, ast.Attribute):
                refs.append(Reference("CALLS", f.attr, at, True))
        elif isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            refs.append(Reference("USES", node.value.id, offset(node.lineno, node.col_offset)))
    return sorted(defs, key=lambda d: d.start), sorted(refs, key=lambda r: r.at)


def extract(path: str, lang: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Rows of symbols (id, name, type, start_line, end_line, start_col, is_exported) and edges (source, target, relation, line)."""
    if lang != "python" and lang not in RULES:
        return [], []
    defs, refs = _python(text) if lang == "python" else _by_rules(text, lang)
    lines = Lines(text)
    ids: dict[int, str] = {}
    first_of: dict[str, str] = {}
    symbols: dict[str, tuple] = {}
    for d in defs:
        line = lines.at(d.start)
        sid = ids[d.start] = f"{path}:{d.name}:{line}"
        symbols.setdefault(sid, (sid, d.name, d.kind, line, lines.at(d.start + len(d.name)), lines.column(d.start), d.exported))
        first_of.setdefault(d.name, sid)
    edges: dict[tuple, tuple] = {}
    keep = lang in RULES and RULES[lang].keep_members
    around: list[Definition] = []
    k = 0
    for r in refs:
        while k < len(defs) and defs[k].first <= r.at:
            around.append(defs[k])
            k += 1
        around = [d for d in around if d.end > r.at]
        if not around:
            continue
        target = first_of.get(r.name)
        if target is None and r.member and not keep:
            continue
        key = (ids[around[-1].start], target or STUB + r.name, r.relation)
        edges.setdefault(key, (*key, lines.at(r.at)))
    return list(symbols.values()), list(edges.values())


def extract_call_graph(files: DataFrame, root: str, indexed_at: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, edges and errors (path, error) of files (path, lang, text), each file read once.

    Write or checkpoint the first table's source before using more than one of them: each is a projection of one extraction.
    """
    out = extraction(files)
    folder = F.when(dirname(F.col("path")).startswith(root.rstrip("/") + "/"), F.substring(dirname(F.col("path")), len(root.rstrip("/")) + 2, 1 << 30)).when(dirname(F.col("path")) == root.rstrip("/"), "").otherwise(dirname(F.col("path")))
    at = F.lit(indexed_at).cast("long").alias("indexed_at")
    symbols = out.select("path", "lang", F.explode("symbols").alias("s")).select("s.id", "s.name", "s.type", "lang", "path", folder.alias("folder"), "s.start_line", "s.end_line", "s.start_col", "s.is_exported", at)
    edges = out.select(F.explode("edges").alias("e")).select("e.source_id", "e.target_id", "e.type_relation", F.lit(False).alias("is_cyclic"), "e.source_line", at)
    return symbols, edges, out.filter("error IS NOT NULL").select("path", "error")


def extraction(files: DataFrame) -> DataFrame:
    """path, lang, symbols, edges, error: one row a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = (("id", "name", "type", "start_line", "end_line", "start_col", "is_exported"), ("source_id", "target_id", "type_relation", "source_line"))
        for batch in batches:
            rows = []
            for path, lang, text in zip(batch["path"], batch["lang"], batch["text"], strict=True):
                try:
                    found = extract(path, lang or "", text or "")
                    rows.append((path, lang, *([dict(zip(n, r, strict=True)) for r in part] for n, part in zip(names, found, strict=True)), None))
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, lang, [], [], f"PARSE_ERROR: {e}"))
            yield pd.DataFrame(rows, columns=["path", "lang", "symbols", "edges", "error"])

    symbol = "struct<id string, name string, type string, start_line int, end_line int, start_col int, is_exported boolean>"
    edge = "struct<source_id string, target_id string, type_relation string, source_line int>"
    return files.select("path", "lang", "text").mapInPandas(run, f"path string, lang string, symbols array<{symbol}>, edges array<{edge}>, error string")


def empty_tables(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], SYMBOLS), spark.createDataFrame([], EDGES)
