"""A compact row format: a header with the keys, then one bracketed line a row."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPECIAL = ("\\", ",", "[", "]", "|")
NUMBER = re.compile(r"-?\d+\.?\d*\Z")
HEADER = re.compile(r"(\w+)\((.*)\)\Z")


def escaped(value: Column) -> Column:
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("\\" + s)), SPECIAL, value)


def cell(name: str, kind: T.DataType) -> Column:
    c = F.col(name)
    if isinstance(kind, T.ArrayType):
        inner = (lambda x: escaped(F.to_json(x))) if isinstance(kind.elementType, (T.StructType, T.MapType)) else (lambda x: escaped(x.cast("string")))
        out = F.array_join(F.transform(c, lambda x: F.coalesce(inner(x), F.lit(""))), "|")
    elif isinstance(kind, (T.StructType, T.MapType)):
        out = escaped(F.to_json(c))
    else:
        out = escaped(c.cast("string"))
    return F.coalesce(out, F.lit(""))


def header(columns: list[str], name: str = "data") -> str:
    return f"{name}({','.join(columns)})"


def write_rows(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """line: each row of df in brackets. Arrays are joined by |, structs are JSON, null is empty."""
    cells = [cell(f.name, f.dataType) for f in df.schema.fields]
    line = F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias("line")
    return df.select(line, *(order_by or [])).orderBy(*order_by).select("line") if order_by else df.select(line)


def _split(text: str, mark: str) -> list[str]:
    """At marks that no backslash precedes; escapes stay."""
    cuts = [m.start() for m in re.finditer(r"\\.|" + re.escape(mark), text, re.S) if m[0] == mark]
    return [text[a + 1 : b] for a, b in zip([-1, *cuts], [*cuts, len(text)], strict=True)]


def parse_cell(text: str):
    """Numbers, booleans and JSON are recognised; a mark without escape makes an array, so a string that holds one after unescaping comes back whole and an array of one as its element."""
    parts = _split(text, "|")
    if len(parts) > 1:
        return [parse_cell(p) for p in parts]
    plain = re.sub(r"\\([\\,\[\]|])", r"\1", text)
    if plain[:1] in ("{", "["):
        try:
            return json.loads(plain)
        except ValueError:
            return plain
    if NUMBER.match(plain):
        n = float(plain)
        return int(n) if n.is_integer() else n
    return {"true": True, "false": False}.get(plain, plain)


def parse(text: str) -> list[dict]:
    """Rows of a whole document; a malformed header or row raises ValueError."""
    lines = [x for x in text.strip().split("\n") if x.strip()]
    m = HEADER.match(lines[0].strip()) if lines else None
    if not m:
        raise ValueError("the header isn't name(key,...)")
    keys = m[2].split(",") if m[2] else []
    rows = []
    for line in (x.strip() for x in lines[1:]):
        if not (line.startswith("[") and line.endswith("]")):
            raise ValueError(f"not a row: {line[:80]}")
        cells = _split(line[1:-1], ",")
        if len(cells) != len(keys):
            raise ValueError(f"{len(cells)} values for {len(keys)} keys")
        rows.append({k: parse_cell(c) for k, c in zip(keys, cells, strict=True)})
    return rows


def read_documents(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """row_json of each row of each document; error names a document that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch[text_col]:
                try:
                    out += [(json.dumps(r, sort_keys=True), None) for r in parse(text or "")]
                except ValueError as e:
                    out.append((None, str(e)))
            yield pd.DataFrame(out, columns=["row_json", "error"])

    return texts.select(text_col).mapInPandas(run, "row_json string, error string")


def token_estimate(text: Column) -> Column:
    """A token for each four characters begun."""
    return F.ceil(F.length(text) / 4)


def token_savings(json_text: Column, compact_text: Column) -> Column:
    """Struct of json_tokens, compact_tokens, savings and savings_percent."""
    a, b = token_estimate(json_text), token_estimate(compact_text)
    return F.struct(a.alias("json_tokens"), b.alias("compact_tokens"), (a - b).alias("savings"), F.when(a != 0, (a - b) / a * 100).alias("savings_percent"))
