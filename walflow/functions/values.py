"""Cells to typed values: VARIANT by type OID, row images as maps, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type OIDs with their own rule. Every other type stays text.
BOOL, INTS, FLOATS, JSON = 16, (20, 21, 23), (700, 701), (114, 3802)
_INT = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def is_null(cell: Column) -> Column:
    return cell["fmt"] == "n"


def is_unchanged(cell: Column) -> Column:
    return cell["fmt"] == "u"


def as_text(cell: Column) -> Column:
    """The text of a text cell, null for any other."""
    return F.when(cell["fmt"] == "t", cell["text"])


def tuple_length(cells: Column) -> Column:
    return F.size(cells)


def is_empty(cells: Column) -> Column:
    return F.size(cells) == 0


def cell_value(oid: Column, cell: Column) -> Column:
    """VARIANT of a cell: SQL null for null and unchanged cells, `\\x` hex for binary ones, else by OID with text as the fallback."""
    text = cell["text"]
    as_text = text.cast("variant")
    number = F.when(text.rlike(_INT), F.try_cast(text, "bigint")) if hasattr(F, "try_cast") else F.when(text.rlike(_INT), text.try_cast("bigint"))
    double = F.when(text.rlike(_FLOAT), text.try_cast("double"))
    # NaN and infinities, spelt out or by overflow, have no JSON number.
    odd = F.lower(text).isin("nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity") | (F.abs(double) == float("inf"))
    return (
        F.when(cell["fmt"].isin("n", "u"), F.lit(None).cast("variant"))
        .when(cell["fmt"] == "b", F.concat(F.lit("\\x"), F.lower(F.hex(cell["bin"]))).cast("variant"))
        .when(oid == BOOL, text.isin("t", "true", "1").cast("variant"))
        .when(oid.isin(*INTS), F.coalesce(number.cast("variant"), as_text))
        .when(oid.isin(*FLOATS), F.when(odd, F.lit(None).cast("variant")).otherwise(F.coalesce(double.cast("variant"), as_text)))
        .when(oid.isin(*JSON), F.coalesce(F.try_parse_json(text), as_text))
        .otherwise(as_text)
    )


def row_plan(columns: Column) -> Column:
    """What `row_map` does with a relation's columns, worked out once: names in order (of repeated ones the last), where and of what type their cells are, and the same for the key."""
    n = F.size(columns)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    later = lambda i: F.exists(F.slice(columns, i + 2, n), lambda c: c["name"] == columns[i]["name"])
    named = F.array_sort(F.transform(F.filter(places, lambda i: ~later(i)), lambda i: F.struct(columns[i]["name"].alias("name"), i.alias("i"), columns[i]["type_oid"].alias("oid"), columns[i]["flags"].alias("flags"))))
    keys = F.filter(named, lambda x: x["flags"].bitwiseAND(1) == 1)
    cut = lambda xs: F.transform(xs, lambda x: F.struct(x["i"].alias("i"), x["oid"].alias("oid")))
    return F.struct(n.alias("n"), named["name"].alias("names"), cut(named).alias("at"), keys["name"].alias("key_names"), cut(keys).alias("key_at"))


def row_map(columns: Column, cells: Column, keys_only: bool = False, plan: Column | None = None) -> Column:
    """MAP<name, VARIANT> in name order; surplus cells are ignored, missing ones absent, of repeated names the last wins.

    With the relation's `plan`, only rows with missing cells work the order out for themselves."""
    n = F.least(F.size(columns), F.size(cells))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    later = lambda i: F.exists(F.slice(columns, i + 2, n - i - 1), lambda c: c["name"] == columns[i]["name"])
    wanted = lambda i: ~later(i) & ((columns[i]["flags"].bitwiseAND(1) == 1) if keys_only else F.lit(True))
    named = F.array_sort(F.transform(F.filter(places, wanted), lambda i: F.struct(columns[i]["name"].alias("name"), i.alias("i"))))
    entries = F.transform(named, lambda x: F.struct(x["name"].alias("key"), cell_value(columns[x["i"]]["type_oid"], cells[x["i"]]).alias("value")))
    if plan is None:
        return F.when(cells.isNotNull(), F.map_from_entries(entries))
    names, at = (plan["key_names"], plan["key_at"]) if keys_only else (plan["names"], plan["at"])
    planned = F.map_from_arrays(names, F.transform(at, lambda x: cell_value(x["oid"], cells[x["i"]])))
    return F.when(F.size(cells) >= plan["n"], planned).when(cells.isNotNull(), F.map_from_entries(entries))


def unchanged(columns: Column, cells: Column) -> Column:
    """Names of the columns whose value was not sent."""
    n = F.least(F.size(columns), F.size(cells))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(places, lambda i: cells[i]["fmt"] == "u"), lambda i: columns[i]["name"])


def field(image: Column, name: str, kind: str) -> Column:
    """One field of a row image as a SQL value."""
    return F.try_variant_get(image[name], "$", kind)


def to_json(image: Column) -> Column:
    """Canonical JSON: keys in order, nulls kept."""
    return F.to_json(image)
