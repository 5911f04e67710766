"""Scripts as user functions: loaded by content, called by SHA-1, over columns or whole keys."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Scripts:
    """EVAL, EVALSHA, SCRIPT LOAD, EXISTS and FLUSH. A script is a Python function of pandas objects."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[Callable, str]] = {}

    def load(self, f: Callable, returns: str) -> str:
        """The SHA-1 of the function's source, by which it is called from now on."""
        sha = hashlib.sha1(inspect.getsource(f).encode()).hexdigest()
        self.known[sha] = (f, returns)
        return sha

    def exists(self, *shas: str) -> list[bool]:
        return [s in self.known for s in shas]

    def flush(self) -> None:
        self.known.clear()

    def call(self, sha: str, *args: Column) -> Column:
        """A script of series, vectorised over rows."""
        f, returns = self.known[sha]

        def run(*series: pd.Series) -> pd.Series:
            return f(*series)

        return F.pandas_udf(run, returns, F.PandasUDFType.SCALAR)(*args)

    def call_by_key(self, sha: str, rows: DataFrame, *keys: str) -> DataFrame:
        """A script of all rows of a key."""
        f, returns = self.known[sha]
        return rows.groupBy(*keys).applyInPandas(f, returns)
