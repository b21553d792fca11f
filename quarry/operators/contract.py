"""JSON contracts compiled to columns.

``violations(text, schema)`` turns a JSON Schema (``type``, ``required``,
``properties``, ``additionalProperties``, ``enum``, ``items``, ``minimum``,
``maximum``, ``minLength``, ``maxLength``) into one Column over the parsed
text: an array of ``path: rule`` strings, empty for a valid text. Rules of an
array's items hold for each item, with its number in the path. All of it runs
in the JVM; a schema is walked once, on the driver, when the plan is built.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "array<string>"
KEYWORDS = {"type", "required", "properties", "additionalProperties", "enum", "items", "minimum", "maximum", "minLength",
            "maxLength", "title", "description", "$schema"}


def _rule(path: Column, rule: str, broken: Column) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.array(F.concat(path, F.lit(f": {rule}")))).otherwise(F.array().cast(NONE))


def _is(kind: Column, value: Column, name: str) -> Column:
    number = kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    as_number = F.try_variant_get(value, "$", "double")
    return {
        "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID", "number": number,
        "integer": number & F.coalesce(as_number == F.rint(as_number), F.lit(False)),
        "array": kind.startswith("ARRAY<"), "object": kind.startswith("OBJECT<"),
    }[name]


def _walk(value: Column, schema: dict[str, Any], path: Column) -> Column:
    """Violations of one present value."""
    unknown = set(schema) - KEYWORDS
    if unknown:
        raise ValueError(f"keywords not supported: {sorted(unknown)}")
    kind = F.schema_of_variant(value)
    found: list[Column] = []
    types = schema.get("type")
    if types is not None:
        fits = F.lit(False)
        for name in [types] if isinstance(types, str) else types:
            fits = fits | _is(kind, value, name)
        found.append(_rule(path, "type", ~fits))
    if "enum" in schema:
        texts = [x for x in schema["enum"] if isinstance(x, str)]
        if len(texts) != len(schema["enum"]):
            raise ValueError("only texts are supported in an enum")
        found.append(_rule(path, "enum", (kind == "STRING") & ~F.try_variant_get(value, "$", "string").isin(*texts)))
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    is_number = _is(kind, value, "number")
    for rule, broken in (("minimum", lambda x: is_number & (number < x)), ("maximum", lambda x: is_number & (number > x)),
                         ("minLength", lambda x: (kind == "STRING") & (F.char_length(text) < x)),
                         ("maxLength", lambda x: (kind == "STRING") & (F.char_length(text) > x))):
        if rule in schema:
            found.append(_rule(path, rule, broken(F.lit(schema[rule]))))
    is_object = kind.startswith("OBJECT<")
    properties = schema.get("properties", {})
    child = lambda name: F.try_variant_get(value, f"$['{name}']", "variant")
    for name in schema.get("required", ()):
        found.append(_rule(F.concat(path, F.lit(f".{name}")), "required", is_object & child(name).isNull()))
    for name, inner in properties.items():
        if inner:
            found.append(F.when(is_object & child(name).isNotNull(), _walk(child(name), inner, F.concat(path, F.lit(f".{name}"))))
                         .otherwise(F.array().cast(NONE)))
    if schema.get("additionalProperties") is False:
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        more = F.sort_array(F.array_except(keys, F.array(*[F.lit(p) for p in properties]).cast(NONE)))
        found.append(F.when(is_object, F.transform(more, lambda k: F.concat(path, F.lit("."), k, F.lit(": additionalProperties"))))
                     .otherwise(F.array().cast(NONE)))
    if schema.get("items"):
        items = F.try_variant_get(value, "$", "array<variant>")
        inside = F.flatten(F.transform(items, lambda x, i: _walk(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        found.append(F.when(kind.startswith("ARRAY<"), inside).otherwise(F.array().cast(NONE)))
    out = [F.coalesce(x, F.array().cast(NONE)) for x in found]
    return F.concat(*out) if len(out) > 1 else out[0] if out else F.array().cast(NONE)


def walk_value(value: Column, schema: dict[str, Any]) -> Column:
    """Violations of a variant value, with paths from ``$``."""
    return _walk(value, schema, F.lit("$"))


def violations(text: Column, schema: dict[str, Any]) -> Column:
    """``path: rule`` of everything in a JSON text that breaks ``schema``, in
    the schema's order. A NULL text has NULL, a text that is no JSON ``$: json``."""
    value = F.try_parse_json(text)
    return F.when(text.isNull(), F.lit(None).cast(NONE)).when(value.isNull(), F.array(F.lit("$: json"))) \
            .otherwise(_walk(value, schema, F.lit("$")))
