"""Tables, enumerations and checks of the code-graph model.

Tables keep snake_case columns; their schemas are DDL strings, for readers and createDataFrame. Ids of symbols are "path:name:start_line" with a
line from 0; the target of a reference that isn't resolved yet is the stub
"@@external:" and the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Fixed values of the model.
SYMBOL_TYPES = ("function", "class", "method", "interface", "type", "variable")
RELATIONS = ("CALLS", "INHERITS", "IMPLEMENTS", "USES")
LANGUAGES = ("typescript", "javascript", "python", "rust", "csharp", "go", "java", "swift")
DEPENDENCY_TYPES = ("import", "require", "export", "dynamic")
DIRECTIONS = ("outgoing", "incoming", "lateral")
CATEGORIES = ("function", "class", "variable", "interface", "type", "other")
STUB = "@@external:"
SCHEMA_VERSION = 2

FILES = ("path string not null, lang string not null, last_modified long not null, indexed_at long not null, size long")
SYMBOLS = (
    "id string not null, name string not null, type string not null, lang string not null, path string not null, folder string not null, "
    "start_line int not null, end_line int not null, start_col int not null, is_exported boolean not null, indexed_at long not null"
)
EDGES = ("source_id string not null, target_id string not null, type_relation string not null, is_cyclic boolean not null, source_line int, indexed_at long not null")
IMPORTS = ("source string not null, target string, type string not null, line int not null, module string not null")
SYMBOL_DEPS = ("source_symbol_id string not null, source_path string not null, target_symbol_id string not null, target_path string not null, is_type_only boolean, relation_type string")
PARAM = "struct<name string, type string, is_optional boolean, has_default boolean, is_rest boolean, position int>"
SIGNATURES = (f"version string, path string, symbol string, kind string, return_type string, visibility string, is_async boolean, line int, params array<{PARAM}>")

EDGE_KEY = ["source_id", "target_id", "type_relation"]


def symbol_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", path, name, line.cast("string"))


def is_stub(target: Column) -> Column:
    return target.startswith(STUB)


def stub_name(target: Column) -> Column:
    return F.substring(target, len(STUB) + 1, 1 << 30)


def invalid_rows(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows that break an enumeration: table, key, value."""
    bad_symbols = symbols.filter(~F.col("type").isin(*SYMBOL_TYPES)).select(F.lit("symbols").alias("table"), F.col("id").alias("key"), F.col("type").alias("value"))
    bad_edges = edges.filter(~F.col("type_relation").isin(*RELATIONS)).select(F.lit("edges").alias("table"), F.col("source_id").alias("key"), F.col("type_relation").alias("value"))
    return bad_symbols.unionByName(bad_edges)
