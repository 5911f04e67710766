"""Bitmaps: rows (key, bit) as the canonical form, bytes with the most significant bit first at the edge."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block of a bitmap that is written out.
BLOCK = 1 << 16


def set_bits(log: DataFrame, keys: list[str], bit: str = "bit", on: str = "on", seq: str = "seq") -> DataFrame:
    """SETBIT fold: the bits whose last write was 1."""
    return log.groupBy(*keys, bit).agg(F.max_by(on, seq).alias("_on")).where(F.col("_on") == 1).drop("_on")


def bit_count(bits: DataFrame, keys: list[str], bit: str = "bit", first_byte: int = 0, last_byte: int | None = None) -> DataFrame:
    """BITCOUNT over an inclusive range of bytes."""
    rows = bits.where(F.col(bit) >= 8 * first_byte)
    if last_byte is not None:
        rows = rows.where(F.col(bit) < 8 * (last_byte + 1))
    return rows.groupBy(*keys).agg(F.count_distinct(bit).alias("n"))


def bit_pos(bits: DataFrame, keys: list[str], bit: str = "bit", want: int = 1) -> DataFrame:
    """BITPOS: the first bit that is ``want``; for 0 that is the first gap, or one past the last byte if it is full."""
    if want == 1:
        return bits.groupBy(*keys).agg(F.min(bit).alias("pos"))
    from pyspark.sql import Window

    ranked = bits.select(*keys, bit).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(bit)) - 1)
    return ranked.groupBy(*keys).agg(F.count_if(F.col(bit) == F.col("_r")).alias("pos"))  # the length of the run from 0


def bit_op(bits: DataFrame, op: str, sources: list[str], key: str = "key", bit: str = "bit") -> DataFrame:
    """BITOP AND, OR, XOR over the named keys; NOT of one key up to the end of its last byte."""
    rows = bits.where(F.col(key).isin(sources)).select(key, bit).distinct()
    if op == "NOT":
        if len(sources) != 1:
            raise ValueError("NOT takes one source")
        width = rows.agg(((F.floor(F.max(bit) / 8) + 1) * 8).alias("_n"))
        # blocks first, so that no row holds all bits of a wide bitmap
        block = width.where("_n > 0").select("_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / BLOCK))).alias("_b"))
        top = F.least(F.col("_n"), (F.col("_b") + 1) * BLOCK) - 1
        every = block.select(F.explode(F.sequence(F.col("_b") * BLOCK, top)).alias(bit))
        return every.join(rows.select(F.col(bit).cast("bigint").alias(bit)), bit, "left_anti")
    n = rows.groupBy(bit).agg(F.count("*").alias("_n"))
    keep = {"AND": F.col("_n") == len(set(sources)), "OR": F.lit(True), "XOR": F.col("_n") % 2 == 1}[op]
    return n.where(keep).drop("_n")


def get_bit(value: Column, offset: int) -> Column:
    """GETBIT on bytes, 0 past the end."""
    byte = F.conv(F.hex(F.substring(value.cast("binary"), offset // 8 + 1, 1)), 16, 10).cast("int")
    return F.coalesce(F.shiftright(byte, 7 - offset % 8).bitwiseAND(1), F.lit(0)).cast("bigint")


def byte_bit_count(value: Column) -> Column:
    """BITCOUNT on whole bytes."""
    digits = F.split(F.hex(value.cast("binary")), "")
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a + F.bit_count(F.coalesce(F.conv(F.nullif(d, F.lit("")), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))))


def to_bytes(bits: DataFrame, keys: list[str], bit: str = "bit") -> DataFrame:
    """The bytes of each bitmap. Bits are gathered by byte first; a value is one row, as in the store."""
    byte = F.floor(F.col(bit) / 8).cast("bigint")
    each = bits.groupBy(*keys, byte.alias("_b")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (7 - F.col(bit) % 8).cast("int"))).alias("_v"))
    m = F.map_from_entries(F.collect_list(F.struct("_b", "_v")))
    hexes = F.transform(F.sequence(F.lit(0).cast("bigint"), F.max("_b")), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at(m, i), F.lit(0))), 2, "0"))
    return each.groupBy(*keys).agg(F.unhex(F.array_join(hexes, "")).alias("value"))


def bitfield(program: list[tuple], value: Column):
    """BITFIELD: (new value, results as text) of a program of ("GET", type, offset), ("SET"|"INCRBY", type, offset, n), ("OVERFLOW", how).

    Types are i1-i64 and u1-u63, bits counted from the most significant one.
    WRAP stores and returns the sum cut to the field's width, which for INCRBY is
    a deliberate divergence from a server that returns the sum before cutting.
    SAT clips, FAIL gives null and writes nothing.
    """

    @F.pandas_udf("value binary, results string")
    def run(values: pd.Series) -> pd.DataFrame:
        out, texts = [], []
        for raw in values:
            data, how, results = bytearray(raw or b""), "WRAP", []
            for op, *args in program:
                if op == "OVERFLOW":
                    how = args[0]
                    continue
                kind, offset = args[0], args[1]
                width, signed = int(kind[1:]), kind[0] == "i"
                need = (offset + width + 7) // 8
                data.extend(bytes(max(0, need - len(data))))
                whole = int.from_bytes(data, "big")
                shift = 8 * len(data) - offset - width
                old = whole >> shift & (1 << width) - 1
                old = old - (1 << width) if signed and old >> (width - 1) else old
                if op == "GET":
                    results.append(str(old))
                    continue
                new = args[2] if op == "SET" else old + args[2]
                low, high = (-(1 << width - 1), (1 << width - 1) - 1) if signed else (0, (1 << width) - 1)
                if not low <= new <= high and how == "FAIL":
                    results.append("")
                    continue
                new = min(max(new, low), high) if how == "SAT" else new
                cut = new & (1 << width) - 1
                shown = cut - (1 << width) if signed and cut >> (width - 1) else cut
                whole = whole & ~((1 << width) - 1 << shift) | cut << shift
                data = bytearray(whole.to_bytes(len(data), "big"))
                results.append(str(old if op == "SET" else shown))
            out.append(bytes(data))
            texts.append(",".join(results))
        return pd.DataFrame({"value": out, "results": texts})

    return run(value.cast("binary"))


