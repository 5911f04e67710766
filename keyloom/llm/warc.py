"""WARC archives: written by Spark's text writer, read in splits with boundary chains.

Reading cuts every file at the magic line in parallel, so a magic inside a
payload looks like a record too. Each task gives its candidates with the offset
at which their successor must start (header, Content-Length, end of record).
Only what is reachable from the start of a file is a record: inside a block the
links are followed by pointer doubling down to the exit from the block, and over
the blocks of a file jump pointers are squared until nothing new is reached.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import cut, drop, scratch, shared_dir, small

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$")


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: five hex digits make four letters."""
    letters = []
    for k in range(0, 40, 5):
        bits = F.conv(F.substring(digest, k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """One record a row of ``pages`` (page_id, url, html), payload the html in UTF-8, null as empty.

    Of rows with equal payloads of at least ``least`` bytes the smallest page_id is
    a response; the others are revisit records without content that refer to it.
    A row with a null page_id is a revisit where an equal payload has an id. A
    record's id is made of the page's id, url and payload: only rows that are
    equal in all three share one. Payloads of any length are written whole.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("hex", F.sha1(F.col("html").cast("binary")))
    rows = rows.withColumn("tag", F.hex(F.xxhash64("url", "hex")))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "tag"))).alias("first")
    same = rows.where(F.octet_length("html") >= least).groupBy("hex").agg(first, F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("hex").alias("copied"), F.col("first.page_id").alias("response"), F.col("first.tag").alias("response_tag"))
    rows = rows.join(small(cut(same)), F.col("hex") == F.col("copied"), "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    urn = lambda c, tag: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(":"), tag, F.lit(">"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    size = F.octet_length("html").cast("string")
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id", "tag")),
        line("WARC-Date", F.lit(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("hex")))),
        line("X-Payload-Length", size),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn("response", "response_tag")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(size)),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("html")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what stands between magics, in file order inside a block of a file."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, rel, n, head, body, sha1): rel is the place after the magic, counted from the block's first piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[str, int], int] = {}
        for batch in batches:
            rows = []
            for file, block, value in zip(*batch.columns, strict=True):
                key, v = (file.as_py(), block.as_py()), value.as_py()
                rel = at.get(key, 0)
                at = {key: rel + len(v) + len(MAGIC)}
                split = v.find(b"\r\n\r\n")
                length = _LENGTH.search(v[: split + 2]) if split >= 0 else None
                if length:
                    size = int(length[1])
                    body = v[split + 4 : split + 4 + size]
                    rows.append((*key, rel, len(v), v[:split].decode("utf-8", "replace"), split + 4, size, hashlib.sha1(body).hexdigest() if len(body) == size else None))
                else:
                    rows.append((*key, rel, len(v), None, None, None, None))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            names = ["file", "block", "rel", "n", "head", "skip", "size", "sha1"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)

    return _pieces(spark, path).mapInArrow(run, "file string, block long, rel long, n long, head string, skip long, size long, sha1 string")


def _jump(at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted offsets and their successors: the index of the successor, or its own with a flag where the chain leaves."""
    k = np.searchsorted(at, to)
    inside = (k < len(at)) & (at[np.minimum(k, len(at) - 1)] == to)
    return np.where(inside, k, np.arange(len(at))), ~inside


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per candidate of a block, the first offset of its chain that is no candidate of the block."""
    pdf = pdf.sort_values("at")
    at, to = pdf["at"].to_numpy(), pdf["to"].to_numpy()
    jump, _ = _jump(at, to)
    while True:
        twice = jump[jump]
        if (twice == jump).all():
            break
        jump = twice
    return pd.DataFrame({"file": pdf["file"], "at": at, "exit": to[jump]})


def _marked(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block that its entries reach."""
    pdf = pdf.sort_values("at").reset_index(drop=True)
    jump, _ = _jump(pdf["at"].to_numpy(), pdf["to"].to_numpy())
    on = pdf["entry"].to_numpy().copy()
    while True:
        more = on.copy()
        more[jump[on]] = True
        if (more == on).all():
            break
        on, jump = more, jump[jump]
    return pdf.loc[on, ["file", "at", "to", "n", "head", "skip", "size", "sha1"]]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, to, n, head, skip, size, sha1) of every true record below ``path``.

    ``at`` is the offset after the magic, ``to`` that of the next record; ``head``
    the header lines, ``size`` the content's length and ``sha1`` its digest in
    hexadecimal. A chain ends where its successor is missing, so a file that is
    cut off gives the records before the cut and the cut one with a null digest.
    """
    found = cut(_candidates(spark, path))
    sizes = found.groupBy("file", "block").agg(F.sum(F.col("n") + len(MAGIC)).alias("bytes"))
    base = cut(sizes.select("file", "block", (F.sum("bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("bytes")).alias("base")))
    placed = found.join(small(base), ["file", "block"]).withColumn("at", F.col("base") + F.col("rel"))
    links = placed.where("head is not null and at > 0").withColumn("to", F.col("at") + F.col("skip") + F.col("size") + len(END) + len(MAGIC))
    exits = cut(links.select("file", "block", "at", "to").groupBy("file", "block").applyInPandas(_exits, "file string, at long, exit long"))

    reached = cut(links.where(F.col("at") == len(MAGIC)).select("file", "at"))
    entries = exits.join(exits.select("file", F.col("exit").alias("at")).unionByName(reached).distinct(), ["file", "at"], "left_semi")
    jumps, n = cut(entries.select("file", F.col("at").alias("source"), F.col("exit").alias("target"))), -1
    with scratch(spark) as tables:
        while (now := reached.count()) != n:
            n, old = now, tables[:]
            far = reached.join(jumps, (reached["file"] == jumps["file"]) & (reached["at"] == jumps["source"])).select(jumps["file"], jumps["target"].alias("at"))
            again = jumps.select("file", F.col("source").alias("target"), F.col("target").alias("to"))
            reached = cut(reached.unionByName(far).distinct())
            jumps = cut(jumps.join(again, ["file", "target"], "left").select("file", "source", F.coalesce("to", "target").alias("target")))
            del tables[: len(old)]
            drop(spark, old)
        reached = cut(reached, keep=True)
    entry = reached.select("file", "at", F.lit(True).alias("entry"))
    flagged = links.join(small(entry), ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    records = cut(flagged.select("file", "block", "at", "to", "n", "head", "skip", "size", "sha1", "entry").groupBy("file", "block").applyInPandas(
        _marked, "file string, at long, to long, n long, head string, skip long, size long, sha1 string"
    ))
    torn = records.where("sha1 is null").select("file", "at", "to", "skip", "size")
    if torn.isEmpty():
        return records
    whole = _contents(spark, path, base, cut(torn)).select("file", "at", F.when(F.octet_length("content") == F.col("size"), F.sha1("content")).alias("late"))
    return records.join(cut(whole), ["file", "at"], "left").withColumn("sha1", F.coalesce("sha1", "late")).drop("late")


def _contents(spark: SparkSession, path: str, base: DataFrame, records: DataFrame) -> DataFrame:
    """(file, at, size, content) of records, put together from the pieces that lie inside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[str, int], int] = {}
        for batch in batches:
            rel = []
            for file, block, value in zip(*batch.columns, strict=True):
                key = (file.as_py(), block.as_py())
                rel.append(at.get(key, 0))
                at = {key: rel[-1] + len(value.as_buffer()) + len(MAGIC)} if value.is_valid else at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rel, pa.int64())], names=["file", "block", "value", "rel"])

    pieces = _pieces(spark, path).mapInArrow(run, "file string, block long, value binary, rel long").join(small(base), ["file", "block"])
    pieces = pieces.select(F.col("file").alias("in"), (F.col("base") + F.col("rel")).alias("place"), "value")
    # a piece belongs to the last record that begins at it or before it, if that is not over
    begins = records.select(F.col("file").alias("in"), F.col("at").alias("place"), F.struct("file", "at", "to", "skip", "size").alias("begin"))
    both = begins.unionByName(pieces.select("in", "place"), allowMissingColumns=True)
    last = F.last("begin", ignorenulls=True).over(Window.partitionBy("in").orderBy("place", F.col("begin").isNull()))
    held = both.withColumn("record", last).where(F.col("begin").isNull() & (F.col("place") < F.col("record.to") - len(MAGIC))).select(F.col("in").alias("of"), F.col("place").alias("there"), "record.*")
    own = pieces.join(held, (F.col("in") == F.col("of")) & (F.col("place") == F.col("there")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.hex("value").alias("h")))), lambda p: p["h"]), MAGIC.encode().hex().upper())
    grouped = own.groupBy("file", "at", "skip", "size").agg(F.unhex(text).alias("bytes"))
    return grouped.select("file", "at", "size", F.substring("bytes", F.col("skip").cast("int") + 1, F.col("size").cast("int")).alias("content"))


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, size, content) of every true record below ``path``."""
    records = cut(read_records(spark, path).select("file", "at", "to", "skip", "size"))
    sizes = _candidates(spark, path).groupBy("file", "block").agg(F.sum(F.col("n") + len(MAGIC)).alias("bytes"))
    base = cut(sizes.select("file", "block", (F.sum("bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("bytes")).alias("base")))
    return _contents(spark, path, base, records)


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Repeated rows are records of their own; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    records = read_records(spark, path)
    field = lambda name, value: F.nullif(F.regexp_extract("head", rf"(?im)^{name}: {value}\r?$", 1), F.lit(""))
    revisit = field("WARC-Type", "([a-z]+)") == "revisit"
    return records.select(
        field("WARC-Record-ID", r"<urn:x-page:(-?\d+):[0-9A-F]+>").cast("long").alias("page_id"),
        F.when(revisit, field("X-Payload-Length", r"(\d+)").cast("long")).otherwise(F.col("size")).alias("payload_bytes"),
        F.when(revisit, field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)")).otherwise(base32_of_hex(F.col("sha1"))).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, field("WARC-Refers-To", r"<urn:x-page:(-?\d+):[0-9A-F]+>").cast("long")).alias("refers_to"),
    )
