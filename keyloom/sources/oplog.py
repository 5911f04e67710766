"""The op log and snapshots: RESP-encoded commands as a source and sink, Parquet as the native form.

A log file is split by Spark's text reader; a command begins with ``*n`` and
its length-prefixed arguments follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.keyspace import last_write


def encode(args: list[str]) -> str:
    """One command as RESP."""
    return f"*{len(args)}\r\n" + "".join(f"${len(a.encode())}\r\n{a}\r\n" for a in args)


def decode(data: bytes) -> Iterator[list[str]]:
    """The whole commands at the front of ``data``; a torn tail is ignored, anything else that is not RESP is an error."""
    at = 0

    def line() -> bytes | None:
        nonlocal at
        end = data.find(b"\r\n", at)
        if end < 0:
            return None
        out, at = data[at:end], end + 2
        return out

    while at < len(data):
        head = line()
        if head is None:
            return
        if head[:1] != b"*":
            raise ValueError(f"no command at byte {at}: {head[:20]!r}")
        args = []
        for _ in range(int(head[1:])):
            size = line()
            if size is None or at + int(size[1:]) + 2 > len(data):
                return
            args.append(data[at : at + int(size[1:])].decode("utf-8", "replace"))
            at += int(size[1:]) + 2
        yield args


def read_aof(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(file, seq, tx_id, args) of log files, in order within each file; rows of one MULTI block share a tx_id, unfinished blocks are dropped.

    One file is one task: bytes of a log can't be split without reading what
    stands before. A log is rotated into files of bounded size. With ``stream`` new
    files are read as they appear, as a replica follows its source.
    """
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile") if stream else spark.read.format("binaryFile")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows, block, tx = [], None, 0
                for seq, args in enumerate(decode(bytes(content))):
                    name = args[0].upper() if args else ""
                    if name == "MULTI":
                        block, tx = [], tx + 1
                    elif name == "EXEC":
                        rows += block or []
                        block = None
                    elif block is not None:
                        block.append((file, seq, f"{file}#{tx}", args))
                    else:
                        rows.append((file, seq, None, args))
                yield pd.DataFrame(rows, columns=["file", "seq", "tx_id", "args"])

    return reader.load(path).select("path", "content").mapInPandas(run, "file string, seq long, tx_id string, args array<string>")


def write_aof(commands: DataFrame, path: str, args: str = "args") -> None:
    """Commands (array of text) as RESP files, in the order of each partition."""
    parts = F.transform(F.col(args), lambda a: F.concat(F.lit("$"), F.octet_length(a).cast("string"), F.lit("\r\n"), a, F.lit("\r\n")))
    text = F.concat(F.lit("*"), F.size(args).cast("string"), F.lit("\r\n"), F.array_join(parts, ""))
    # the writer ends each row with the separator, which is the last line end of the command
    commands.select(F.substring(text, F.lit(1), F.length(text) - 2).alias("value")).write.option("lineSep", "\r\n").text(path)


def compact(log: DataFrame, keys: list[str], values: list[str], seq: str = "seq", tombstone: str = "deleted") -> DataFrame:
    """Log rewrite: the last write of each key, without the deleted ones."""
    return last_write(log, keys, [*values, tombstone], seq).where(~F.col(tombstone)).drop(tombstone)


def save_snapshot(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """SAVE, BGSAVE, BACKUP: Parquet, replaced as a whole."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
