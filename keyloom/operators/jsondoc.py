"""JSON documents as text: reads by built-in functions, writes at any path by one vectorised function."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def get(doc: Column, path: str = "$") -> Column:
    """JSON.GET and JSON.MGET at one path; null where nothing is found."""
    return F.get_json_object(doc, path)


def kind(doc: Column, path: str = "$") -> Column:
    """JSON.TYPE: object, array, string, number, boolean or null."""
    s = F.schema_of_variant(F.variant_get(F.try_parse_json(doc), path, "variant"))
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.isNotNull(), "number")
    )


def arr_len(doc: Column, path: str = "$") -> Column:
    return F.json_array_length(get(doc, path)).cast("bigint")


def obj_keys(doc: Column, path: str = "$") -> Column:
    return F.json_object_keys(get(doc, path))


def obj_len(doc: Column, path: str = "$") -> Column:
    return F.nullif(F.size(F.json_object_keys(get(doc, path))), F.lit(-1)).cast("bigint")


def str_len(doc: Column, path: str = "$") -> Column:
    """JSON.STRLEN in bytes."""
    return F.octet_length(F.try_variant_get(F.try_parse_json(doc), path, "string")).cast("bigint")


def number(doc: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(doc), path, "double")


def steps(path: str) -> list[str | int]:
    """The steps of a simple path: ``$.a[0].b`` or ``a.b``; quoted names in brackets may hold any character."""
    out: list[str | int] = []
    rest = path.removeprefix("$")
    while rest:
        if rest[0] == "[":
            inside, _, rest = rest[1:].partition("]")
            out.append(inside[1:-1] if inside[:1] in "'\"" else int(inside))
        else:
            rest = rest.removeprefix(".")
            end = min((k for k in (rest.find("."), rest.find("[")) if k >= 0), default=len(rest))
            if end:
                out.append(rest[:end])
            rest = rest[end:]
    return out


def _place(root: object, path: list[str | int]) -> tuple[object, str | int] | None:
    """(container, step) of the last step, or None where a container is missing."""
    for step in path[:-1]:
        try:
            root = root[step]  # type: ignore[index]
        except (KeyError, IndexError, TypeError):
            return None
    last = path[-1]
    if isinstance(root, dict) and isinstance(last, str) or isinstance(root, list) and isinstance(last, int) and -len(root) <= last < len(root):
        return root, last
    return None


MISSING = object()


def _numbers(x: float) -> float | int:
    return int(x) if float(x).is_integer() and abs(x) < 2**63 else x


def update(path: str, change: Callable[[object], object]):
    """A function of a text column: documents with ``change`` applied to the value at ``path``.

    ``change`` gets ``MISSING`` where nothing is there and may return it to remove
    the value. Documents that do not parse or lack the container stay as they are.
    Numbers become doubles on arithmetic, printed without a fraction if whole.
    """
    parts = steps(path)

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                root = {"": json.loads(text)}
            except ValueError:
                return text
            where = _place(root, ["", *parts])
            if where is None:
                return text
            box, step = where
            old = box.get(step, MISSING) if isinstance(box, dict) else box[step]
            new = change(old)
            if new is MISSING:
                if old is not MISSING:
                    if parts:
                        del box[step]
                    else:
                        box[step] = None
            else:
                box[step] = new
            return json.dumps(root[""], separators=(",", ":"), ensure_ascii=False)

        return docs.map(one)

    return run


def set_value(path: str, value: object, mode: str = ""):
    """JSON.SET with NX or XX."""
    return update(path, lambda old: old if (mode == "NX" and old is not MISSING) or (mode == "XX" and old is MISSING) else value)


def remove(path: str):
    """JSON.DEL; the root becomes null."""
    return update(path, lambda old: MISSING)


def incr(path: str, by: float):
    """JSON.NUMINCRBY, in doubles."""
    return update(path, lambda old: _numbers(float(old) + by) if isinstance(old, (int, float)) and not isinstance(old, bool) else old)


def mult(path: str, by: float):
    """JSON.NUMMULTBY, in doubles."""
    return update(path, lambda old: _numbers(float(old) * by) if isinstance(old, (int, float)) and not isinstance(old, bool) else old)


def toggle(path: str):
    return update(path, lambda old: not old if isinstance(old, bool) else old)


def clear(path: str):
    """JSON.CLEAR: empty containers and strings, zero numbers."""

    def change(old: object) -> object:
        if isinstance(old, bool) or old is None or old is MISSING:
            return old
        return {dict: {}, list: [], str: ""}.get(type(old), 0)

    return update(path, change)


def str_append(path: str, more: str):
    return update(path, lambda old: old + more if isinstance(old, str) else old)


def arr_append(path: str, *values: object):
    """JSON.ARRAPPEND; a missing or null target becomes an array."""
    return update(path, lambda old: [*old, *values] if isinstance(old, list) else list(values) if old is MISSING or old is None else old)


def arr_insert(path: str, at: int, *values: object):
    """JSON.ARRINSERT before ``at``, negative from the end, clamped."""

    def change(old: object) -> object:
        if not isinstance(old, list):
            return old
        i = min(max(at if at >= 0 else len(old) + at, 0), len(old))
        return [*old[:i], *values, *old[i:]]

    return update(path, change)


def arr_pop(path: str, at: int = -1):
    return update(path, lambda old: [x for i, x in enumerate(old) if i != (at if at >= 0 else len(old) + at)] if isinstance(old, list) else old)


def arr_trim(path: str, start: int, stop: int):
    def change(old: object) -> object:
        if not isinstance(old, list):
            return old
        n = len(old)
        a, b = max(start if start >= 0 else n + start, 0), (stop if stop >= 0 else n + stop)
        return old[a : b + 1] if b >= a else []

    return update(path, change)


def arr_index(doc: Column, path: str, value: str) -> Column:
    """JSON.ARRINDEX of a value given as JSON text: first position or -1, null if there is no array."""
    items = F.from_json(get(doc, path), "array<string>")
    return F.when(items.isNotNull(), F.coalesce(F.array_position(items, F.get_json_object(F.lit(value), "$")) - 1, F.lit(-1))).cast("bigint")


def merge(path: str, other: object):
    """JSON.MERGE: shallow for objects, concatenation for arrays; other types stay."""

    def change(old: object) -> object:
        if isinstance(old, dict) and isinstance(other, dict):
            return old | other
        if isinstance(old, list) and isinstance(other, list):
            return old + other
        return old

    return update(path, change)
