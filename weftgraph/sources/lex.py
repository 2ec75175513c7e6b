"""Masks of source text: comments and the insides of strings become blanks, offsets stay."""

from __future__ import annotations

import re
from bisect import bisect_right

#: Comments and strings by family of languages.
C_LIKE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<s>`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')", re.S)
RUST = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<s>r(?P<h>#*)\".*?\"(?P=h)|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\])')", re.S)
SWIFT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<s>\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\")", re.S)
FAMILY = {"rust": RUST, "swift": SWIFT}


def _blank(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


def without_comments(text: str, lang: str = "typescript") -> str:
    """Comments blanked, strings kept."""
    return FAMILY.get(lang, C_LIKE).sub(lambda m: m[0] if m["s"] is not None else _blank(m[0]), text)


def code_only(text: str, lang: str = "typescript") -> str:
    """Comments and what stands within quotes blanked."""
    return FAMILY.get(lang, C_LIKE).sub(lambda m: m[0][0] + _blank(m[0][1:-1]) + m[0][-1] if m["s"] is not None and len(m[0]) > 1 else _blank(m[0]), text)


class Lines:
    """Line numbers from 0, and columns, of offsets."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, offset: int) -> int:
        return bisect_right(self.starts, offset) - 1

    def column(self, offset: int) -> int:
        return offset - self.starts[self.at(offset)]


def block_end(code: str, start: int) -> int:
    """Offset behind the block that the first brace from start opens; the statement's end if there is none."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(code, start):
        c = m[0]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif not depth:
            return m.end()
    return len(code)


def paren_end(code: str, start: int, pair: str = "()") -> int:
    """Offset of the bracket that closes the one at start, or the end."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(code, start):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.start()
    return len(code)


OPENS = re.compile(r"[(\[{<]")


def split_top(text: str, mark: str = ",") -> list[str]:
    """At marks outside brackets of any kind."""
    if not OPENS.search(text):
        return text.split(mark)
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and text[i - 1 : i] not in ("=", "-"):
            depth = max(0, depth - 1)
        elif c == mark and not depth:
            parts.append(text[last:i])
            last = i + 1
    return [*parts, text[last:]]
