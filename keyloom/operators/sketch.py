"""Cardinality and membership sketches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTERS_LOG2 = 14


def pfadd(rows: DataFrame, keys: list[str], element: str) -> DataFrame:
    """PFADD: one native sketch of 2^14 registers a key."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(element, F.lit(REGISTERS_LOG2)).alias("sketch"))


def pfmerge(sketches: DataFrame, keys: list[str], sketch: str = "sketch") -> DataFrame:
    """PFMERGE: the union of the sources."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg(sketch).alias("sketch"))


def pfcount(sketches: DataFrame, keys: list[str], sketch: str = "sketch") -> DataFrame:
    """PFCOUNT over one or several keys."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg(sketch)).alias("n"))


def registers(rows: DataFrame, keys: list[str], element: str) -> DataFrame:
    """(keys, idx, rho): explicit registers, for merging by plain aggregates. Hash: xxhash64, spread once more."""
    h = F.xxhash64(F.col(element), F.lit("hll"))
    rest = F.shiftleft(h, REGISTERS_LOG2)
    zeros = F.when(rest == 0, F.lit(64)).otherwise(64 - F.length(F.regexp_replace(F.conv(F.hex(rest), 16, 2), "^0+", "")))
    rho = F.least(zeros, F.lit(64 - REGISTERS_LOG2)) + 1
    return rows.groupBy(*keys, F.shiftrightunsigned(h, 64 - REGISTERS_LOG2).cast("int").alias("idx")).agg(F.max(rho).alias("rho"))


def registers_count(regs: DataFrame, keys: list[str]) -> DataFrame:
    """Estimate from explicit registers, with linear counting in the small range; merging is just grouping by fewer keys."""
    m = float(1 << REGISTERS_LOG2)
    merged = regs.groupBy(*keys, "idx").agg(F.max("rho").alias("rho"))
    s = merged.groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("_s"), F.count("*").alias("_used"))
    zeros = F.lit(m) - F.col("_used")
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("_s") + zeros)
    return s.select(*keys, F.floor(F.when((raw <= 2.5 * m) & (zeros > 0), m * F.log(F.lit(m) / zeros)).otherwise(raw)).cast("bigint").alias("n"))


def bloom_size(capacity: int, error: float) -> tuple[int, int]:
    """(bits, hashes) for a capacity and an error rate. Bits are counted as bits, which a server that mixes bytes in does not."""
    bits = max(8, math.ceil(-capacity * math.log(error) / math.log(2) ** 2))
    return -(-bits // 8) * 8, max(1, round(bits / capacity * math.log(2)))


def bloom_positions(item: Column, bits: int, hashes: int) -> Column:
    """The bits of an item: two hashes combined linearly."""
    h1, h2 = F.xxhash64(item), F.xxhash64(item, F.lit("second"))
    return F.array(*(F.pmod(F.xxhash64(h1, h2, F.lit(i)), F.lit(bits)) for i in range(hashes)))


def bloom_add(rows: DataFrame, keys: list[str], item: str, bits: int, hashes: int) -> DataFrame:
    """BF.ADD, BF.MADD, BF.INSERT in bulk: rows (keys, bit) of the filter."""
    return rows.select(*keys, F.explode(bloom_positions(F.col(item), bits, hashes)).alias("bit")).distinct()


def bloom_exists(requests: DataFrame, filters: DataFrame, keys: list[str], item: str, bits: int, hashes: int) -> DataFrame:
    """BF.EXISTS, BF.MEXISTS: each request with 1 (maybe) or 0 (surely not)."""
    asked = requests.select(*keys, item).distinct().withColumn("bit", F.explode(F.array_distinct(bloom_positions(F.col(item), bits, hashes))))
    have = filters.withColumn("_have", F.lit(1))
    seen = asked.join(have, [*keys, "bit"], "left").groupBy(*keys, item).agg(F.min(F.coalesce("_have", F.lit(0))).cast("bigint").alias("maybe"))
    return requests.join(seen, [*keys, item], "left")


def bloom_card(rows: DataFrame, keys: list[str], item: str, seq: str, bits: int, hashes: int) -> DataFrame:
    """BF.CARD: adds that set a new bit, in order of ``seq``: a bit is new to the first row that holds it."""
    first = rows.select(*keys, seq, F.explode(bloom_positions(F.col(item), bits, hashes)).alias("bit")).groupBy(*keys, "bit").agg(F.min(seq).alias(seq))
    return first.groupBy(*keys).agg(F.count_distinct(seq).alias("n"))


def murmur3_high(values: Column):
    """The first half of MurmurHash3 x64 128 of text, for registers that must equal another implementation's."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else murmur3_x64_128(t.encode())[0], na_action="ignore").astype("Int64")

    return run(values)


def murmur3_x64_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """MurmurHash3 x64 128 as two signed 64-bit numbers, after the public description of the algorithm."""
    mask = (1 << 64) - 1
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    rot = lambda x, r: (x << r | x >> (64 - r)) & mask

    def final(k: int) -> int:
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            k = ((k ^ k >> 33) * c) & mask
        return k ^ k >> 33

    h1 = h2 = seed
    whole = len(data) // 16 * 16
    for at in range(0, whole, 16):
        k1, k2 = (int.from_bytes(data[at + o : at + o + 8], "little") for o in (0, 8))
        h1 ^= rot(k1 * c1 & mask, 31) * c2 & mask
        h1 = ((rot(h1, 27) + h2) * 5 + 0x52DCE729) & mask
        h2 ^= rot(k2 * c2 & mask, 33) * c1 & mask
        h2 = ((rot(h2, 31) + h1) * 5 + 0x38495AB5) & mask
    k1, k2 = (int.from_bytes(data[whole + o : whole + o + 8], "little") for o in (0, 8))
    h2 ^= rot(k2 * c2 & mask, 33) * c1 & mask
    h1 ^= rot(k1 * c1 & mask, 31) * c2 & mask
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & mask
    h2 = (h2 + h1) & mask
    h1, h2 = final(h1), final(h2)
    h1 = (h1 + h2) & mask
    h2 = (h2 + h1) & mask
    return tuple(int(x) for x in np.array([h1, h2], dtype=np.uint64).view(np.int64))
