"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; a side is counted before and joined by shuffle beyond this.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is configured, a local session gets a temporary one and a cluster an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not sc._jsc.isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Paths of the tables that ``cut`` wrote, by the scopes that are open in this thread or task, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` computed once, as a table in the shared folder; survives the loss of executors.

    A table rather than ``checkpoint()``: it is columnar, and its size is known
    to the planner, while a checkpoint keeps the estimate of its whole history.
    It belongs to the innermost ``scratch``, with ``keep`` to the one around that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    open_scopes = _scopes.get()
    if len(open_scopes) > keep:
        open_scopes[-1 - keep].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """A scope: the tables that ``cut`` writes inside are deleted at its end, save those written with ``keep``.

    Yields the list of paths, oldest first.
    """
    mine: list[str] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield mine
    finally:
        _scopes.reset(token)
        drop(spark, mine)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more and take them off their list."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del paths[:]


def bound(value: str, name: str, use: str) -> str:
    """SQL of ``use`` with ``value`` as ``name``, computed once a row however often ``use`` or its lambdas name it."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def rekey(c: Column) -> Column:
    """The same number as an expression of its own.

    A join on it is dealt out anew on both sides, which lets adaptive execution
    split a hot key on the other side (it can't split below an aggregate).
    """
    return c.bitwiseXOR(F.lit(0).cast("long"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is. Counts ``df``: cut it before."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
