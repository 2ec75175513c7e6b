"""Breaking changes between two versions of signatures, interfaces and type aliases.

Versions meet in full outer joins by name; each rule is a condition that yields a
row: symbol, change, severity, subject (a parameter or member), old_value, new_value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = ["symbol", "change", "severity", "subject", "old_value", "new_value"]
#: How visible a member is.
LEVEL = {"public": 3, "protected": 2, "private": 1}


def _rows(joined: DataFrame, rules: list[tuple[Column, str, str, Column, Column]], subject: Column) -> DataFrame:
    made = F.array(*(F.when(when, F.struct(F.lit(change).alias("change"), F.lit(severity).alias("severity"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"))) for when, change, severity, old, new in rules))
    return joined.select("symbol", subject.alias("subject"), F.explode(F.array_compact(made)).alias("r")).select("symbol", "r.change", "r.severity", "subject", "r.old_value", "r.new_value")


def _sides(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    a = old.select(*keys, *(F.col(v).alias(f"o_{v}") for v in values), F.lit(True).alias("o"))
    b = new.select(*keys, *(F.col(v).alias(f"n_{v}") for v in values), F.lit(True).alias("n"))
    return a.join(b, keys, "full_outer")


def _common(rows: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of symbols that both versions have."""
    both = old.select("symbol").distinct().join(new.select("symbol").distinct(), "symbol")
    return rows.join(both, "symbol", "left_semi")


def parameter_changes(old: DataFrame, new: DataFrame, notes: bool = False) -> DataFrame:
    """Changes of parameters (symbol, name, type, is_optional, has_default, position) of symbols in both versions.

    Removed; added, an error if required and else a note; type changed; optional
    to required. Another name at a position is a note.
    """
    j = _common(_sides(old, new, ["symbol", "name"], ["type", "is_optional", "has_default"]), old, new)
    free = lambda s: F.coalesce(F.col(f"{s}_is_optional"), F.lit(False)) | F.coalesce(F.col(f"{s}_has_default"), F.lit(False))
    here, there, nothing = F.col("o").isNotNull(), F.col("n").isNotNull(), F.lit(None)
    shown = lambda s: F.concat(F.col("name"), F.lit(": "), F.col(f"{s}_type"))
    rules = [
        (here & ~there, "parameter-removed", "error", shown("o"), nothing),
        (~here & there & ~free("n"), "parameter-added-required", "error", nothing, shown("n")),
        (here & there & ~F.col("o_type").eqNullSafe(F.col("n_type")), "parameter-type-changed", "error", F.col("o_type"), F.col("n_type")),
        (here & there & free("o") & ~free("n"), "parameter-optional-to-required", "error", nothing, nothing),
    ]
    if notes:
        rules.append((~here & there & free("n"), "parameter-added-optional", "note", nothing, shown("n")))
    out = _rows(j, rules, F.col("name"))
    if notes:
        at = _sides(old, new, ["symbol", "position"], ["name"]).filter("o AND n AND o_name <> n_name")
        out = out.unionByName(at.select("symbol", F.lit("parameter-order-changed").alias("change"), F.lit("note").alias("severity"), F.col("position").cast("string").alias("subject"), F.col("o_name").alias("old_value"), F.col("n_name").alias("new_value")))
    return out


def exploded(signatures: DataFrame) -> DataFrame:
    """One row a parameter of signatures with a nested array."""
    return signatures.select("symbol", F.explode("params").alias("p")).select("symbol", "p.*")


def signature_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed return types and reduced visibility of symbols (symbol, return_type, visibility) in both versions; unknown visibility isn't compared."""
    j = _sides(old, new, ["symbol"], ["return_type", "visibility"]).filter("o AND n")
    level = lambda c: reduce(lambda e, kv: F.when(c == kv[0], kv[1]).otherwise(e), LEVEL.items(), F.lit(None).cast("int"))
    rules = [
        (~F.col("o_return_type").eqNullSafe(F.col("n_return_type")), "return-type-changed", "error", F.col("o_return_type"), F.col("n_return_type")),
        (level(F.col("n_visibility")) < level(F.col("o_visibility")), "visibility-reduced", "error", F.col("o_visibility"), F.col("n_visibility")),
    ]
    return _rows(j, rules, F.lit(None).cast("string"))


def interface_changes(old: DataFrame, new: DataFrame, notes: bool = False) -> DataFrame:
    """Changes of members (symbol, name, type, is_optional) of interfaces in both versions; an added required member counts as optional to required."""
    j = _common(_sides(old, new, ["symbol", "name"], ["type", "is_optional"]), old, new)
    here, there, nothing = F.col("o").isNotNull(), F.col("n").isNotNull(), F.lit(None)
    free = lambda s: F.coalesce(F.col(f"{s}_is_optional"), F.lit(False))
    rules = [
        (here & ~there, "member-removed", "error", F.col("o_type"), nothing),
        (~here & there & ~free("n"), "member-optional-to-required", "error", nothing, F.col("n_type")),
        (here & there & ~F.col("o_type").eqNullSafe(F.col("n_type")), "member-type-changed", "error", F.col("o_type"), F.col("n_type")),
        (here & there & free("o") & ~free("n"), "member-optional-to-required", "error", nothing, nothing),
    ]
    if notes:
        rules.append((~here & there & free("n"), "member-added-optional", "note", nothing, F.col("n_type")))
    return _rows(j, rules, F.col("name"))


def alias_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Type aliases (symbol, type) that changed, a warning, or were removed, an error."""
    j = _sides(old, new, ["symbol"], ["type"]).filter("o")
    there = F.col("n").isNotNull()
    rules = [
        (there & ~F.col("o_type").eqNullSafe(F.col("n_type")), "type-alias-changed", "warning", F.col("o_type"), F.col("n_type")),
        (~there, "type-alias-removed", "error", F.col("o_type"), F.lit(None)),
    ]
    return _rows(j, rules, F.lit(None).cast("string"))


def removed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols of the old version that the new one lacks; added ones aren't reported."""
    gone = old.select("symbol").distinct().join(new.select("symbol"), "symbol", "left_anti")
    none = F.lit(None).cast("string")
    return gone.select("symbol", F.lit("member-removed").alias("change"), F.lit("error").alias("severity"), none.alias("subject"), none.alias("old_value"), none.alias("new_value"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """All changes between two tables of signatures (symbol, return_type, visibility, params)."""
    return reduce(DataFrame.unionByName, [parameter_changes(exploded(old), exploded(new)), signature_changes(old, new), removed(old, new)]).select(*ROW)


def summary(changes: DataFrame) -> DataFrame:
    """symbol, n_breaking of symbols with errors or warnings."""
    return changes.filter("severity <> 'note'").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_breaking"))
