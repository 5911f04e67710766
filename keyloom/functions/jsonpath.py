"""JSONPath over text documents where the built-in path language ends: recursive descent, unions, slices, filters."""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\.\.|\.|\[\?\((?P<filter>[^)]*)\)\]|\[(?P<inside>[^\]]*)\]|(?P<name>[^.\[]+)")
_TEST = re.compile(r"^@\.?(?P<path>[^<>=!]*?)\s*(?:(?P<op>==|!=|<=|>=|<|>)\s*(?P<value>.+))?$")
_OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_NONE = object()


def parse(path: str) -> list[tuple[str, object]]:
    """Steps (kind, argument) of a path: child, all, deep, slice, union, filter."""
    out: list[tuple[str, object]] = []
    at = 1 if path.startswith("$") else 0
    while at < len(path):
        m = _TOKEN.match(path, at)
        if not m:
            raise ValueError(f"bad path {path!r} at {at}")
        at = m.end()
        if m[0] == "..":
            out.append(("deep", None))
        elif m["filter"] is not None:
            test = _TEST.match(m["filter"].strip())
            if not test:
                raise ValueError(f"bad filter {m['filter']!r}")
            value = json.loads(test["value"].strip().replace("'", '"')) if test["op"] else None
            out.append(("filter", (parse(test["path"].strip()), test["op"], value)))
        elif m["inside"] is not None:
            inside = m["inside"].strip()
            if inside == "*":
                out.append(("all", None))
            elif ":" in inside:
                out.append(("slice", slice(*(int(x) if x.strip() else None for x in inside.split(":")))))
            else:
                names = [x.strip() for x in inside.split(",")]
                out.append(("union", [x[1:-1] if x[:1] in "'\"" else int(x) for x in names]))
        elif m["name"] is not None:
            out.append(("all", None) if m["name"] == "*" else ("union", [m["name"]]))
    return out


def _children(x: object) -> Iterator[object]:
    yield from x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()


def _everything(x: object) -> Iterator[object]:
    yield x
    for child in _children(x):
        yield from _everything(child)


def find(x: object, steps: list[tuple[str, object]]) -> list[object]:
    """All values that a path reaches, in document order."""
    found = [x]
    for kind, arg in steps:
        if kind == "deep":
            found = [y for v in found for y in _everything(v)]
        elif kind == "all":
            found = [y for v in found for y in _children(v)]
        elif kind == "slice":
            found = [y for v in found if isinstance(v, list) for y in v[arg]]
        elif kind == "union":
            found = [
                v[k] for v in found for k in arg
                if isinstance(v, dict) and isinstance(k, str) and k in v or isinstance(v, list) and isinstance(k, int) and -len(v) <= k < len(v)
            ]
        else:
            path, op, value = arg
            found = [y for v in found for y in _children(v) if _holds(y, path, op, value)]
    return found


def _holds(y: object, path: list[tuple[str, object]], op: str | None, value: object) -> bool:
    got = next(iter(find(y, path)), _NONE)
    if op is None or got is _NONE:
        return got is not _NONE
    try:
        return _OPS[op](got, value)
    except TypeError:
        return op == "!="


def query(path: str):
    """A function of a text column: JSON array of all hits; null for null and for text that is no JSON."""
    steps = parse(path)

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(find(json.loads(text), steps), separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return docs.map(one)

    return run
