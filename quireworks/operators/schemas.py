"""JSON documents against JSON Schemas: a schema is compiled to one expression that gives all errors of a document at once, each with its path.

Keywords: type (one or several), enum, const, pattern, minLength, maxLength, minimum, maximum, exclusiveMinimum, exclusiveMaximum, minItems, maxItems, required, properties, additionalProperties (false or a schema), items, and $ref
into the schema's definitions; $schema, $id, title, description, default and definitions say nothing about a document. Any other keyword, and a schema that refers to itself, is refused when it is compiled. As the standard has it,
a keyword for one type does not look at values of another, 1.0 is an integer, and `$` in a pattern is the end of the text.

Errors come as rows of path (a JSON pointer; for required and additionalProperties that of the object), keyword and detail (the property, or what the schema asks for). A text that is no JSON, null included, has the one error `json`.

Scale: documents are parsed and judged where they are, without a shuffle. A document that would be too large for one row is judged in parts: each part by the schema of its place, with the
place as path.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SILENT = {"$schema", "$id", "title", "description", "default", "definitions", "$defs", "$comment", "examples"}
_KNOWN = {"type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minItems", "maxItems", "required", "properties", "additionalProperties", "items", "$ref"}
_ERRORS = "array<struct<path:string,keyword:string,detail:string>>"


def _get(value: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(value, path, kind)


def _let(value: Column, then) -> Column:
    """then(x), an array, with x standing for the value, which is computed once however often `then` names it."""
    return F.flatten(F.transform(F.array(value), then))


def _checked_name(name: str) -> str:
    if "'" in name or "\\" in name:
        raise ValueError(f"property {name!r}: quotes and backslashes are not supported")
    return name


def _said(value) -> str:
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def pointer(name: str) -> str:
    return "/" + name.replace("~", "~0").replace("/", "~1")


class _Value:
    """A variant with its type's name and its value as number and text, and as list and map where a schema asks for these. Telling a list or a map does not read what is in it."""

    def __init__(self, value: Column, kind: Column, list_: Column | None = None, map_: Column | None = None):
        self.value, self.list, self.map = value, list_, map_
        self.kind = kind
        self.number = F.when(self._starts("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), _get(value, "double"))
        self.text = F.when(kind == "STRING", _get(value, "string"))

    def _starts(self, *names: str) -> Column:
        out = F.startswith(self.kind, F.lit(names[0]))
        for name in names[1:]:
            out = out | F.startswith(self.kind, F.lit(name))
        return out

    def is_a(self, name: str) -> Column:
        if name == "integer":
            return F.coalesce(self.number % 1 == 0, F.lit(False))
        if name == "number":
            return self.number.isNotNull()
        starts = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
        return self._starts(starts[name])

    def equals_any(self, wanted: list) -> Column:
        out = F.lit(False)
        for value in wanted:
            if value is None:
                out = out | self.is_a("null")
            elif isinstance(value, bool):
                out = out | F.coalesce(F.when(self.kind == "BOOLEAN", _get(self.value, "boolean")) == value, F.lit(False))
            elif isinstance(value, (int, float)):
                out = out | F.coalesce(self.number == float(value), F.lit(False))
            elif not isinstance(value, str):
                raise ValueError(f"{value!r}: lists and objects are not supported in enum and const")
        texts = [value for value in wanted if isinstance(value, str)]
        return out | F.coalesce(self.text.isin(texts), F.lit(False)) if texts else out


def _resolved(schema: dict, root: dict, seen: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
    while "$ref" in schema:
        name = schema["$ref"]
        if name in seen:
            raise ValueError(f"{name} refers to itself")
        seen, found = (*seen, name), root
        for part in name.removeprefix("#/").split("/"):
            found = found[part]
        schema = found
    return schema, seen


def errors(value: Column, schema: dict, at: Column | str = "", root: dict | None = None, _seen: tuple[str, ...] = ()) -> Column:
    """The errors of a variant (null: absent, no errors): an array of path, keyword, detail. at: its path."""
    root, at = root or schema, F.lit(at) if isinstance(at, str) else at
    schema, seen = _resolved(schema, root, _seen)
    if unknown := schema.keys() - _KNOWN - _SILENT:
        raise ValueError(f"keywords that are not supported: {', '.join(sorted(unknown))}")
    none = F.array().cast(_ERRORS)
    names = schema.get("type", [])
    names = names if isinstance(names, list) else [names]
    opened = [F.lit(None).cast("array<variant>"), F.lit(None).cast("map<string,variant>")]
    if "array" in names or schema.keys() & {"items", "minItems", "maxItems"}:
        opened[0] = "array<variant>"
    if "object" in names or schema.keys() & {"properties", "required", "additionalProperties"}:
        opened[1] = "map<string,variant>"

    def looked(v: Column) -> Column:
        if not schema.keys() & _KNOWN:
            return none
        if all(isinstance(x, Column) for x in opened):
            return _let(F.schema_of_variant(v), lambda kind: _found(_Value(v, kind), schema, names, at, root, seen))
        list_, map_ = (x if isinstance(x, Column) else _get(v, x) for x in opened)

        def inside(x: Column) -> Column:
            kind = F.when(x["map"].isNotNull(), "OBJECT").when(x["list"].isNotNull(), "ARRAY").otherwise(F.schema_of_variant(v))
            return _found(_Value(v, kind, x["list"], x["map"]), schema, names, at, root, seen)

        return _let(F.struct(list_.alias("list"), map_.alias("map")), inside)

    return _let(value, lambda v: F.when(v.isNull(), none).otherwise(looked(v)))


def _found(x: _Value, schema: dict, names: list[str], at: Column, root: dict, seen: tuple[str, ...]) -> Column:
    """The errors of a value that is there."""
    none = F.array().cast(_ERRORS)
    found: list[Column] = []

    def ask(keyword: str, holds: Column, detail) -> None:
        found.append(F.when(~holds, F.struct(at.alias("path"), F.lit(keyword).alias("keyword"), F.lit(_said(detail)).alias("detail"))))

    if names:
        holds = x.is_a(names[0])
        for name in names[1:]:
            holds = holds | x.is_a(name)
        ask("type", holds, ", ".join(names))
    if "enum" in schema:
        ask("enum", x.equals_any(schema["enum"]), ", ".join(map(_said, schema["enum"])))
    if "const" in schema:
        ask("const", x.equals_any([schema["const"]]), schema["const"])
    if "pattern" in schema:
        ask("pattern", F.regexp_like(x.text, F.lit(re.sub(r"(?<!\\)\$\Z", r"\\z", schema["pattern"]))), schema["pattern"])
    size, items = F.char_length(x.text), None if x.list is None else F.when(x.list.isNotNull(), F.size(x.list))
    for keyword, of, holds in [
        ("minLength", size, lambda a, b: a >= b), ("maxLength", size, lambda a, b: a <= b), ("minimum", x.number, lambda a, b: a >= b), ("maximum", x.number, lambda a, b: a <= b),
        ("exclusiveMinimum", x.number, lambda a, b: a > b), ("exclusiveMaximum", x.number, lambda a, b: a < b), ("minItems", items, lambda a, b: a >= b), ("maxItems", items, lambda a, b: a <= b),
    ]:
        if keyword in schema:
            ask(keyword, holds(of, schema[keyword]), schema[keyword])
    for name in schema.get("required", []):
        ask("required", F.map_contains_key(x.map, _checked_name(name)), name)

    parts = [F.array_compact(F.array(*found)).cast(_ERRORS)] if found else []
    known = schema.get("properties", {})
    for name, inner in known.items():
        if _resolved(inner, root, seen)[0]:
            parts.append(errors(F.try_element_at(x.map, F.lit(_checked_name(name))), inner, F.concat(at, F.lit(pointer(name))), root, seen))
    more = schema.get("additionalProperties", True)
    fields = F.array(*map(F.lit, known)).cast("array<string>")
    if more is False:
        extra = F.array_sort(F.array_except(F.map_keys(x.map), fields))
        parts.append(F.transform(extra, lambda n: F.struct(at.alias("path"), F.lit("additionalProperties").alias("keyword"), n.alias("detail"))).cast(_ERRORS))
    elif isinstance(more, dict) and more:
        escaped = lambda n: F.concat(at, F.lit("/"), F.replace(F.replace(n, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
        extra = F.array_sort(F.filter(F.map_entries(x.map), lambda e: ~F.array_contains(fields, e["key"])), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        parts.append(F.flatten(F.transform(extra, lambda e: errors(e["value"], more, escaped(e["key"]), root, seen))))
    if schema.get("items"):
        parts.append(F.flatten(F.transform(x.list, lambda v, i: errors(v, schema["items"], F.concat(at, F.lit("/"), i.cast("string")), root, seen))))
    return F.concat(*(F.coalesce(p, none) for p in parts)) if parts else none


def violations(rows: DataFrame, json: str, schema: dict, at: Column | str = "", root: dict | None = None) -> DataFrame:
    """rows with a column of JSON texts: the other columns, path, keyword, detail, one row for each error. For parts of a document: at is their place, root the schema that holds the definitions."""
    # The parser stops at a value's end; whatever follows that spoils the list or the object around it.
    # Each step is a column of its own: a generator computes whatever its expression repeats as often as it is there.
    alone, inside = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"":'), json, F.lit("}")))
    others = [F.col(f"`{c}`") for c in rows.columns if c != json]
    rows = rows.select(*others, _get(alone, "array<variant>").alias("variant_of_list"), inside.isNotNull().alias("variant_is_whole"))
    value = F.when(F.col("variant_is_whole") & (F.size("variant_of_list") == 1), F.get("variant_of_list", F.lit(0)))
    rows, value = rows.select(*others, value.alias("variant_value")), F.col("variant_value")
    broken = F.array(F.struct((F.lit(at) if isinstance(at, str) else at).alias("path"), F.lit("json").alias("keyword"), F.lit("a JSON text").alias("detail"))).cast(_ERRORS)
    found = F.when(value.isNull(), broken).otherwise(errors(value, schema, at, root))
    return rows.select(*others, F.inline(found))


def checked(rows: DataFrame, json: str, schema: dict) -> DataFrame:
    """rows, unless one of their documents has an error: then the first errors are raised, and nothing is written."""
    found = violations(rows, json, schema).limit(5).collect()
    if found:
        raise ValueError("invalid documents: " + ", ".join(f"{e.path or '/'}: {e.keyword} {e.detail}" for e in found))
    return rows
