"""JSON functions that build or change documents, as Arrow-batched Python functions: the built-ins cannot express them.

Paths are $.a.b[0], with one index in a segment and no wildcards. Text that is not JSON gives NULL. Results have sorted keys and no spaces.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_SEGMENT = re.compile(r"\.([^.\[\]]+)|\[(\d+)\]")
_BAD = object()


def steps(path: str | None) -> list[str | int] | None:
    """The keys and indexes of a path; None if it is not one."""
    if path is None or not path.startswith("$"):
        return None
    out, at = [], 1
    while at < len(path):
        m = _SEGMENT.match(path, at)
        if not m:
            return None
        out.append(m[1] if m[1] is not None else int(m[2]))
        at = m.end()
    return out


def load(text: str | None):
    if text is None:
        return _BAD
    try:
        return json.loads(text)
    except ValueError:
        return _BAD


def dump(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _get(doc, at):
    for s in at:
        if isinstance(s, str) and isinstance(doc, dict) and s in doc:
            doc = doc[s]
        elif isinstance(s, int) and isinstance(doc, list) and s < len(doc):
            doc = doc[s]
        else:
            return _BAD
    return doc


def _holds(doc, wanted) -> bool:
    """Whether a value stands anywhere in a document; an array stands in one that holds each of its elements, an object only as a whole."""
    if type(doc) is type(wanted) and dump(doc) == dump(wanted):
        return True
    if isinstance(doc, dict):
        return any(_holds(v, wanted) for v in doc.values())
    if isinstance(doc, list):
        return all(any(_holds(c, w) for c in doc) for w in wanted) if isinstance(wanted, list) else any(_holds(c, wanted) for c in doc)
    return False


def contains_value(text, target, path=None) -> bool | None:
    doc, wanted, at = load(text), load(target), steps(path or "$")
    if doc is _BAD or wanted is _BAD or at is None:
        return None
    part = _get(doc, at)
    return None if part is _BAD else _holds(part, wanted)


def _embedded(value):
    """Text that is JSON is taken as such; other text is a string."""
    got = load(value) if isinstance(value, str) else _BAD
    return value if got is _BAD else got


def change(text: str | None, path: str | None, value: str | None, how: str) -> str | None:
    """set: puts a value at the path, whether or not there is one; insert: only if not; replace: only if so; remove: takes it out."""
    doc, at = load(text), steps(path)
    if doc is _BAD or at is None:
        return None
    new = _embedded(value)
    if not at:
        return dump(new) if how in ("set", "replace") else dump(doc)
    parent = _get(doc, at[:-1])
    last = at[-1]
    if isinstance(last, str) and parent is not _BAD and isinstance(parent, dict):
        there = last in parent
        if how == "remove":
            parent.pop(last, None)
        elif how == "set" or how == "insert" and not there or how == "replace" and there:
            parent[last] = new
    elif isinstance(last, int) and isinstance(parent, list):
        there = last < len(parent)
        if how == "remove" and there:
            parent.pop(last)
        elif how in ("set", "replace") and there:
            parent[last] = new
        elif how in ("set", "insert") and not there:
            parent.append(new)
    return dump(doc)


def _changer(how: str):
    @F.pandas_udf("string")
    def run(text: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([change(t, p, v, how) for t, p, v in zip(text, path, value, strict=True)], dtype=object)

    return run


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def json_contains(j: Column, target: Column | str, path: Column | str = "$") -> Column:
    @F.pandas_udf("boolean")
    def run(text: pd.Series, wanted: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([contains_value(*x) for x in zip(text, wanted, at, strict=True)], dtype=object)

    return run(j, _col(target), _col(path))


def json_set(j: Column, path: Column | str, value: Column | str) -> Column:
    return _changer("set")(j, _col(path), _col(value).cast("string"))


def json_insert(j: Column, path: Column | str, value: Column | str) -> Column:
    return _changer("insert")(j, _col(path), _col(value).cast("string"))


def json_replace(j: Column, path: Column | str, value: Column | str) -> Column:
    return _changer("replace")(j, _col(path), _col(value).cast("string"))


def json_remove(j: Column, path: Column | str) -> Column:
    return _changer("remove")(j, _col(path), F.lit(None).cast("string"))


def _values(cols: tuple[Column, ...]) -> list[Column]:
    """Each value as JSON text: strings stay strings (embedded later if they are JSON), others become their JSON form."""
    return [F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) for c in map(_col, cols)]


def _built(text: str):
    return _embedded(json.loads(text)["v"])


def json_object(*pairs: Column | str) -> Column:
    """A document from name, value, name, value, … ."""
    if len(pairs) % 2:
        raise ValueError("json_object takes names and values in pairs")
    names, values = [_col(x).cast("string") for x in pairs[::2]], _values(pairs[1::2])

    @F.pandas_udf("string")
    def run(*cols: pd.Series) -> pd.Series:
        n = len(cols) // 2
        return pd.Series([dump({k: _built(v) for k, v in zip(row[:n], row[n:], strict=True)}) for row in zip(*cols, strict=True)], dtype=object)

    return run(*names, *values)


def json_array(*items: Column | str) -> Column:
    """An array of values of any types."""

    @F.pandas_udf("string")
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([dump([_built(v) for v in row]) for row in zip(*cols, strict=True)], dtype=object)

    return run(*_values(items)) if items else F.lit("[]")


def register(spark: SparkSession) -> None:
    """The same functions for SQL text, under their names with the dialect's prefix."""
    from millrace.functions.dialect import PREFIX

    for how in ("set", "insert", "replace"):
        spark.udf.register(f"{PREFIX}json_{how}", _changer(how))

    @F.pandas_udf("string")
    def remove(text: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([change(t, p, None, "remove") for t, p in zip(text, path, strict=True)], dtype=object)

    @F.pandas_udf("boolean")
    def contains(*cols: pd.Series) -> pd.Series:
        return pd.Series([contains_value(*x) for x in zip(*cols, strict=True)], dtype=object)

    spark.udf.register(f"{PREFIX}json_remove", remove)
    spark.udf.register(f"{PREFIX}json_contains", contains)
