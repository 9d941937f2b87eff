"""JSON text as documents: containment, keys, merging and setting, as column expressions over variants."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _members(value: Column) -> Column:
    return value.try_cast("map<string,variant>")


def _within(value: Column, part) -> Column:
    if isinstance(part, dict):
        held = [F.map_contains_key(_members(value), F.lit(k)) & _within(F.try_element_at(_members(value), F.lit(k)), v) for k, v in part.items()]
        out = _members(value).isNotNull()
        for h in held:
            out = out & F.coalesce(h, F.lit(False))
        return out
    items = value.try_cast("array<variant>")
    if isinstance(part, list):
        out = items.isNotNull()
        for x in part:
            out = out & F.coalesce(F.exists(items, _holds(x)), F.lit(False))
        return out
    return F.to_json(value) == F.lit(json.dumps(part))


def _holds(part):
    return lambda value: F.coalesce(_within(value, part), F.lit(False))


def contains(text: Column, part) -> Column:
    """Whether JSON holds ``part``, given in Python: objects hold all its keys with what they hold, lists each of its elements somewhere, scalars are
    equal; a list at the top also holds a scalar that is one of its elements. False for what isn't JSON, null for null."""
    value = F.try_parse_json(text)
    found = _within(value, part)
    if not isinstance(part, (dict, list)):
        found = F.coalesce(found, F.lit(False)) | F.coalesce(F.exists(value.try_cast("array<variant>"), _holds(part)), F.lit(False))
    return F.when(text.isNotNull(), F.coalesce(found, F.lit(False)))


def has_key(text: Column, key: str) -> Column:
    """Whether a top-level object has the key, or a top-level list the string."""
    value = F.try_parse_json(text)
    named = F.coalesce(F.map_contains_key(_members(value), F.lit(key)), F.lit(False))
    listed = F.coalesce(F.exists(value.try_cast("array<variant>"), lambda v: F.to_json(v) == F.lit(json.dumps(key))), F.lit(False))
    return F.when(text.isNotNull(), named | listed)


def merged(text: Column, other: Column) -> Column:
    """Two objects as one; keys of the second win, whole. Null unless both are objects. Keys come in order."""
    a, b = _members(F.try_parse_json(text)), _members(F.try_parse_json(other))
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return _ordered(F.map_concat(kept, b))


def with_key(text: Column, key: str, value: Column) -> Column:
    """An object with ``value`` (JSON text) at a top-level key, which is made if it isn't there. Null unless it is an object."""
    a = _members(F.try_parse_json(text))
    kept = F.map_filter(a, lambda k, _: k != F.lit(key))
    return _ordered(F.map_concat(kept, F.create_map(F.lit(key), F.parse_json(value))))


def _ordered(members: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_keys(members)), lambda k: F.concat(F.regexp_extract(F.to_json(F.struct(k.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit(":"), F.to_json(F.element_at(members, k))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def appended(text: Column, key: str, element: str) -> Column:
    """An object whose list at a key has ``element`` (a string) at its end; no change if the list has it already. A missing list is made."""
    held = F.coalesce(F.try_variant_get(F.try_parse_json(text), f"$.{key}", "array<string>"), F.array().cast("array<string>"))
    longer = F.to_json(F.concat(held, F.array(F.lit(element))))
    return F.when(F.array_contains(held, element), text).otherwise(with_key(text, key, longer))
