"""JSON as text: reading in built-in functions, writing in Arrow-batched functions over Python's json."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(path: tuple[str | int, ...]) -> str:
    """A path of keys and indexes from 0, with every key in quotes that it doesn't hold."""
    quote = lambda k: f"['{k}']" if "'" not in k else f'["{k}"]'
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else quote(p) for p in path)


def text_at(j: Column, *path: str | int) -> Column:
    """->> and #>>: the text at a path of keys and indexes from 0."""
    if any(isinstance(p, str) and "'" in p for p in path):
        return F.try_variant_get(F.try_parse_json(j), _path(path), "string")
    return F.get_json_object(j, _path(path))


def integer_at(j: Column, *path: str | int) -> Column:
    """The number at a path as a whole one, cut towards zero; null if it is none."""
    return F.try_variant_get(F.try_parse_json(j), _path(path), "double").cast("bigint")


def double_at(j: Column, *path: str | int) -> Column:
    return F.try_variant_get(F.try_parse_json(j), _path(path), "double")


def object_at(j: Column, *path: str | int) -> Column:
    """-> and #>: the JSON at a path, strings with their quotes."""
    return F.to_json(F.try_variant_get(F.parse_json(j), _path(path), "variant"))


def canonical(j: Column) -> Column:
    """The same JSON with sorted keys and no spaces."""
    return F.to_json(F.parse_json(j))


def is_json(s: Column) -> Column:
    return F.when(s.isNotNull(), F.try_parse_json(s).isNotNull())


def _kind(j: Column) -> Column:
    return F.schema_of_variant(F.try_parse_json(j))


def is_object(s: Column) -> Column:
    return F.when(s.isNotNull(), F.coalesce(_kind(s).startswith("OBJECT"), F.lit(False)))


def is_array(s: Column) -> Column:
    return F.when(s.isNotNull(), F.coalesce(_kind(s).startswith("ARRAY"), F.lit(False)))


def is_scalar(s: Column) -> Column:
    return is_json(s) & ~is_object(s) & ~is_array(s)


def type_of(j: Column) -> Column:
    """object, array, string, boolean, null or number."""
    k = _kind(j)
    return F.when(k.startswith("OBJECT"), "object").when(k.startswith("ARRAY"), "array").when(k == "STRING", "string").when(k == "BOOLEAN", "boolean").when(k == "VOID", "null").otherwise(F.when(k.isNotNull(), "number"))


def _names(j: Column) -> Column:
    """The keys of an object, the strings of an array, or the string that the JSON is; none of other values, null of null."""
    value = F.try_parse_json(j)
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    strings = F.transform(F.filter(F.try_variant_get(value, "$", "array<variant>"), is_text), lambda v: v.cast("string"))
    alone = F.when(is_text(value), F.array(F.try_variant_get(value, "$", "string")))
    return F.when(j.isNotNull(), F.coalesce(F.json_object_keys(j), strings, alone, F.array().cast("array<string>")))


def has_key(j: Column, key: str) -> Column:
    """?: whether the text is a key of the object or a string of the array."""
    return F.array_contains(_names(j), key)


def has_any_key(j: Column, keys: list[str]) -> Column:
    return F.arrays_overlap(_names(j), F.array(*map(F.lit, keys)))


def has_all_keys(j: Column, keys: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, keys)), _names(j))) == 0


def array_length(j: Column) -> Column:
    return F.json_array_length(j)


def scalar(c: Column) -> Column:
    """Any value as JSON; null as JSON null."""
    return F.coalesce(F.to_json(c.cast("variant")), F.lit("null"))


def build_array(*values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.array(*map(scalar, values)), ","), F.lit("]"))


def object_of_pairs(texts: Column) -> Column:
    """json_object(text[]): an object of an array of keys and values by turns, all of them strings; an odd number is an error. Flatten arrays of pairs first."""
    at = lambda first: F.transform(F.sequence(F.lit(0), (F.size(texts) / 2).cast("int") - 1), lambda i: F.get(texts, 2 * i + first))
    whole = F.when(F.size(texts) % 2 != 0, F.raise_error(F.lit("array must have even number of elements")).cast("string"))
    return whole.when(F.size(texts) == 0, "{}").otherwise(F.to_json(F.map_from_arrays(at(0), at(1)), {"ignoreNullFields": "false"}))


def group_array(c: Column, *order: Column, where: Column | None = None, json: bool = False) -> Column:
    """json_group_array: the values of a group as one array, nulls kept, in the order of other columns if there are any; where is its FILTER, json says that the values are JSON already."""
    value = c if json else scalar(c)
    return F.concat(F.lit("["), F.array_join(_gathered(value, order, where), ","), F.lit("]"))


def group_object(key: Column, c: Column, *order: Column, where: Column | None = None, json: bool = False) -> Column:
    """json_group_object: the keys and values of a group as one object, null values kept, rows without a key left out. Keys that stand twice stay twice."""
    pair = F.concat(scalar(key.cast("string")), F.lit(":"), c if json else scalar(c))
    there = key.isNotNull() if where is None else key.isNotNull() & where
    return F.concat(F.lit("{"), F.array_join(_gathered(pair, order, there), ","), F.lit("}"))


def _gathered(text: Column, order: tuple[Column, ...], where: Column | None) -> Column:
    row = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.coalesce(text, F.lit("null")).alias("v"))
    rows = F.collect_list(row if where is None else F.when(where, row))
    return F.transform(F.sort_array(rows) if order else rows, lambda r: r["v"])


def object_of(keys: Column, values: Column) -> Column:
    return F.to_json(F.map_from_arrays(keys, values))


def row_to_json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def populate(j: Column, ddl: str) -> Column:
    return F.from_json(j, ddl)


def _dump(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def _writer(change):
    """A column function of a JSON text; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else change(t))

    return run


def _writer_of_two(change):
    """A column function of a JSON text and of a JSON text or an array of texts; null of null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else change(a, b) for a, b in zip(texts, others, strict=True)], dtype=object)

    return run


def _column(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _contained(part: Any, whole: Any) -> bool:
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and _contained(v, whole[k]) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(_contained(p, w) for w in whole) for p in part)
    if isinstance(whole, list):
        return any(type(w) is type(part) and w == part for w in whole)
    return type(part) is type(whole) and part == whole


def contains(j: Column, part: str | Column) -> Column:
    """@>: deep containment of a JSON text or of a column of them."""
    if isinstance(part, Column):
        return _writer_of_two(lambda whole, own: str(_contained(json.loads(own), json.loads(whole))))(j, part).cast("boolean")
    value = json.loads(part)
    return _writer(lambda t: str(_contained(value, json.loads(t))))(j).cast("boolean")


def is_contained_by(j: Column, whole: str | Column) -> Column:
    """<@: deep containment the other way round."""
    return contains(_column(whole), j)


def _step(node: Any, key: str | int) -> tuple[Any, bool]:
    """The place of key in node, and whether it is there."""
    if isinstance(node, list):
        i = int(key) + (len(node) if int(key) < 0 else 0)
        return i, 0 <= i < len(node)
    return key, isinstance(node, dict) and key in node


def _at_parent(value: Any, path: list[str | int], change) -> Any:
    node = value
    for p in path[:-1]:
        at, there = _step(node, p)
        if not there:
            return value
        node = node[at]
    if isinstance(node, (dict, list)):
        change(node, *_step(node, path[-1]))
    return value


def remove(j: Column, *path: str | int) -> Column:
    """- and #-: without what is at a path."""

    def change(node: Any, at: Any, there: bool) -> None:
        if there:
            del node[at]

    return _writer(lambda t: _dump(_at_parent(json.loads(t), list(path), change)))(j)


def set_at(j: Column, path: list[str | int], value: str, create: bool = True) -> Column:
    """The value put at a path; a missing key is made if create, an index beyond the end appends, one before the start prepends."""
    new = json.loads(value)

    def change(node: Any, at: Any, there: bool) -> None:
        if there:
            node[at] = new
        elif create:
            if isinstance(node, list):
                node.insert(0 if at < 0 else len(node), new)
            else:
                node[at] = new

    return _writer(lambda t: _dump(_at_parent(json.loads(t), path, change)))(j)


def set_lax(j: Column, path: list[str | int], value: str | None, nulls: str = "use_json_null") -> Column:
    """set_at; a null value raises, is JSON null, deletes the key or returns the target."""
    if value is not None:
        return set_at(j, path, value)
    if nulls == "raise_exception":
        raise ValueError("JSON value must not be null")
    return {"use_json_null": lambda: set_at(j, path, "null"), "delete_key": lambda: remove(j, *path), "return_target": lambda: canonical(j)}[nulls]()


def insert_at(j: Column, path: list[str | int], value: str, after: bool = False) -> Column:
    """The value put before (or after) an array element, or under a new key; a key that is there is an error."""
    new = json.loads(value)

    def change(node: Any, at: Any, there: bool) -> None:
        if isinstance(node, list):
            node.insert(max(0, min(len(node), at + (1 if after and there else 0))), new)
        elif there:
            raise ValueError("cannot replace existing key")
        else:
            node[at] = new

    return _writer(lambda t: _dump(_at_parent(json.loads(t), path, change)))(j)


def pretty(j: Column, indent: int = 4) -> Column:
    return _writer(lambda t: json.dumps(json.loads(t), indent=indent, sort_keys=True, ensure_ascii=False))(j)


def _strip(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _strip(v) for k, v in value.items() if v is not None}
    return [_strip(v) for v in value] if isinstance(value, list) else value


def strip_nulls(j: Column) -> Column:
    return _writer(lambda t: _dump(_strip(json.loads(t))))(j)


def _patch(target: Any, patch: Any) -> Any:
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patch(out.get(k), v)
    return out


def merge_patch(j: Column, patch: str | Column) -> Column:
    """RFC 7396, of a JSON text or of a column of them."""
    if isinstance(patch, Column):
        return _writer_of_two(lambda t, own: _dump(_patch(json.loads(t), json.loads(own))))(j, patch)
    p = json.loads(patch)
    return _writer(lambda t: _dump(_patch(json.loads(t), p)))(j)


def concat(j: Column, other: str | Column) -> Column:
    """||: objects are joined, the right one's keys win; other values make arrays."""

    def change(t: str, own: str) -> str:
        left, right = json.loads(t), json.loads(own)
        if isinstance(left, dict) and isinstance(right, dict):
            return _dump({**left, **right})
        return _dump((left if isinstance(left, list) else [left]) + (right if isinstance(right, list) else [right]))

    return _writer_of_two(change)(j, other) if isinstance(other, Column) else _writer(lambda t: change(t, other))(j)


_PART = re.compile(r"""\.(?:"([^"]*)"|([^.\[]+))|\[(\d+|\#(?:-\d+)?)\]""")


def _steps(path: str) -> list[str]:
    """The keys and indexes of a path like $.a."b.c"[0][#-1]; indexes keep their brackets."""
    parts, at = [], 1
    while at < len(path):
        m = _PART.match(path, at)
        if path[0] != "$" or not m:
            raise ValueError(f"bad JSON path: {path}")
        parts.append(f"[{m[3]}]" if m[3] is not None else m[1] if m[1] is not None else m[2])
        at = m.end()
    return parts


def _edit_at(value: Any, steps: list[str], new: Any, insert: bool, put: bool) -> Any:
    """value with new at the end of the steps: where nothing is yet if insert, where something is if put."""
    if not steps:
        return new if put else value
    head, rest = steps[0], steps[1:]
    if head[:1] == "[" and head[-1:] == "]":
        if not isinstance(value, list):
            return value
        at = len(value) + int(head[2:-1] or 0) if head[1] == "#" else int(head[1:-1])
        if 0 <= at < len(value):
            value[at] = _edit_at(value[at], rest, new, insert, put)
        elif at == len(value) and insert and not rest:
            value.append(new)
    elif isinstance(value, dict):
        if head in value:
            value[head] = _edit_at(value[head], rest, new, insert, put)
        elif insert and not rest:
            value[head] = new
    return value


def _edited(j: Column, changes: tuple[tuple[str, Column | str], ...], insert: bool, put: bool) -> Column:
    paths = [_steps(p) for p, _ in changes]

    def change(text: str, values: list[str]) -> str:
        out = json.loads(text)
        for steps, v in zip(paths, values, strict=True):
            out = _edit_at(out, steps, json.loads(v), insert, put)
        return _dump(out)

    return _writer_of_two(change)(j, F.array(*[_column(v) for _, v in changes]))


def insert_paths(j: Column, *changes: tuple[str, Column | str]) -> Column:
    """json_insert: (path, JSON text or a column of it) one after another, each put only where nothing is yet; [#] is the end of an array. No parents are made."""
    return _edited(j, changes, True, False)


def replace_paths(j: Column, *changes: tuple[str, Column | str]) -> Column:
    """json_replace: each put only where something is."""
    return _edited(j, changes, False, True)


def set_paths(j: Column, *changes: tuple[str, Column | str]) -> Column:
    """json_set: each put whether something is there or not."""
    return _edited(j, changes, True, True)


def remove_paths(j: Column, *paths: str) -> Column:
    """json_remove with several paths, one after another; null if the whole is removed."""
    ways = [_steps(p) for p in paths]

    def change(t: str) -> str | None:
        out = json.loads(t)
        for steps in ways:
            if not steps:
                return None
            node = out
            for i, head in enumerate(steps):
                if head[:1] == "[" and head[-1:] == "]":
                    at = (len(node) + int(head[2:-1] or 0) if head[1] == "#" else int(head[1:-1])) if isinstance(node, list) else -1
                    there = isinstance(node, list) and 0 <= at < len(node)
                else:
                    at, there = head, isinstance(node, dict) and head in node
                if not there:
                    break
                if i + 1 == len(steps):
                    del node[at]
                else:
                    node = node[at]
        return _dump(out)

    return _writer(change)(j)


_NUMBERS = re.compile(r'"(?:[^"\\]|\\.)*"|(-?Infinity|NaN)')


def error_position(s: Column) -> Column:
    """0 for JSON, else the place from 1 of the first character that isn't."""

    def place(t: str) -> str:
        try:
            json.loads(t)
        except json.JSONDecodeError as e:
            # A trailing comma is told by its own place; what can't stand is the character after it.
            return str(len(t) - len(t[e.pos + 1 :].lstrip()) + 1 if "trailing comma" in e.msg else e.pos + 1)
        # Names of numbers that JSON lacks, outside strings.
        return next((str(m.start() + 1) for m in _NUMBERS.finditer(t) if m[1]), "0")

    return _writer(place)(s).cast("int")
