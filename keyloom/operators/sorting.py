"""SORT: weights and projections dereferenced from other keys, order, limit, store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dereference(elements: DataFrame, pattern: str, name: str, strings: DataFrame | None = None, hashes: DataFrame | None = None, elem: str = "elem") -> DataFrame:
    """The value of ``pat*`` (a string) or ``pat*->field`` (a hash field) for each element, null where it is missing; ``#`` is the element."""
    if pattern == "#":
        return elements.withColumn(name, F.col(elem).cast("string"))
    key_pattern, _, field = pattern.partition("->")
    before, _, after = key_pattern.partition("*")
    wanted = F.concat(F.lit(before), F.col(elem).cast("string"), F.lit(after))
    source = hashes.where(F.col("field") == field) if field else strings
    if source is None:
        raise ValueError(f"no table for {pattern!r}")
    values = source.select(F.col("key").alias("_k"), F.col("value").alias(name))
    return elements.withColumn("_w", wanted).join(values, F.col("_w") == F.col("_k"), "left").drop("_w", "_k")


def sort(elements: DataFrame, by: str | None = None, get: tuple[str, ...] = ("#",), offset: int = 0, limit: int | None = None, desc: bool = False, alpha: bool = False, strings: DataFrame | None = None, hashes: DataFrame | None = None, elem: str = "elem") -> DataFrame:
    """(pos, get_1, get_2, ...) of one list or set. Ties go by element, and DESC reverses both; text that is no number weighs 0.

    The limit is taken before GET, so only what is returned is dereferenced.
    """
    rows = elements.select(elem)
    rows = rows.withColumn("_weight", F.col(elem).cast("string")) if by in (None, "nosort") else dereference(rows, by, "_weight", strings, hashes, elem)
    weight = F.coalesce("_weight", F.lit("")) if alpha or by == "nosort" else F.coalesce(F.col("_weight").try_cast("double"), F.lit(0.0))
    order: list[Column] = [c.desc() if desc else c.asc() for c in (weight, F.col(elem))]
    top = rows.orderBy(*order)
    top = top.limit(offset + limit) if limit is not None else top
    # numbering: few rows under a limit; without one a global order has to be numbered
    out = top.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1).where(F.col("pos") >= offset).withColumn("pos", F.col("pos") - offset)
    names = []
    for i, g in enumerate(get, 1):
        out = dereference(out, g, f"get_{i}", strings, hashes, elem)
        names.append(f"get_{i}")
    return out.select("pos", *names)
