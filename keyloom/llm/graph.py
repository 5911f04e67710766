"""Connected components as DataFrames, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut, drop, rekey, scratch


def _least_neighbour(sym: DataFrame) -> DataFrame:
    """k -> the smallest of k and its neighbours, keyed so that a hot vertex can be split in the join that follows."""
    return sym.groupBy("u").agg(F.min("v").alias("m")).select(rekey(F.col("u")).alias("k"), F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex in ``edges``; component is the smallest id reachable.

    Each round replaces the edges of a vertex by edges to its smallest neighbour
    (first towards larger, then towards smaller ones), so no adjacency list is
    ever gathered: only minima are aggregated. Rounds are logarithmic in the
    size of the largest component; each is cut in the shared folder. Self-loops
    and null ends are dropped. An empty input gives an empty result.
    """
    spark = edges.sparkSession
    plain = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(
        F.col("u").isNotNull() & (F.col("u") > F.col("v")) & F.col(a).isNotNull() & F.col(b).isNotNull()
    )
    with scratch(spark) as tables:
        live, seen = cut(plain.distinct()), None
        while True:
            sym = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = (
                sym.join(_least_neighbour(sym), F.col("u") == F.col("k")).where("v > u")
                .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
            )
            low = large.groupBy("u").agg(F.min("v").alias("m")).select(rekey(F.col("u")).alias("k"), "m")
            live = cut(
                large.join(low, F.col("u") == F.col("k"))
                .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                .select("e.u", "e.v").where("u > v").distinct()
            )
            now = live.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            last = [tables.pop()]
            drop(spark, tables)
            tables += last
            if now == seen:
                break
            seen = now
        ends = live.select(F.col("u").alias("id"), F.col("v").alias("component"))
        return cut(ends.unionByName(live.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), keep=True)
