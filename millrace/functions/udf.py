"""A registry of vectorised user functions over the session's own."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class Registry:
    """Scalar (pandas), aggregate (grouped pandas) and table functions by name, whatever its case. Registered ones can be used in SQL too."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._known: dict[str, tuple[str, str, Callable]] = {}

    def register(self, name: str, fn: Callable, returns: str, kind: str = "scalar") -> Callable:
        key = name.lower()
        if key in self._known:
            raise ValueError(f"function {name} exists already")
        if kind == "table":
            f = F.udtf(fn, returnType=returns) if isinstance(fn, type) else fn
            self.spark.udtf.register(key, f)
        elif kind in ("scalar", "aggregate"):
            f = F.pandas_udf(fn, returns)
            self.spark.udf.register(key, f)
        else:
            raise ValueError(f"no such kind of function: {kind}")
        self._known[key] = (kind, returns, f)
        return f

    def unregister(self, name: str) -> bool:
        key = name.lower()
        if self._known.pop(key, None) is None:
            return False
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS `{key}`")
        return True

    def get(self, name: str) -> Callable | None:
        got = self._known.get(name.lower())
        return got[2] if got else None

    def list(self) -> list[tuple[str, str, str]]:
        return sorted((k, kind, returns) for k, (kind, returns, _) in self._known.items())

    def call(self, name: str, *cols: Column) -> Column:
        if (f := self.get(name)) is None:
            raise KeyError(f"no function {name}")
        return f(*cols)


def strlen(s: pd.Series) -> pd.Series:
    return s.str.len().astype("Int64")


def square(x: pd.Series) -> pd.Series:
    return x * x
