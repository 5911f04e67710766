"""Benchmark items inside documents: size-partitioned MinHash containment, then an exact check.

Items are partitioned by the size of their shingle set (powers of two), and each
keeps a bottom-k MinHash sketch: small items their whole set, larger ones the
``SKETCH`` smallest hashes. A document contains an item with containment C if
each sketch hash is in the document with chance C, so the share of the sketch
that a document holds estimates the containment whatever the document's length
(a Jaccard sketch of the document would drown a short item in a long text).

One pass over the documents tests every shingle against a bitmap of all sketch
hashes, whose size is bounded (``BITS``) whatever the number of items. Documents
with a hit give one row with their hits and their set. Hits meet the sketches in
a join; a size class whose items are too large for the document is not looked
at. Pairs that hold ``CANDIDATE`` of a sketch are verified on both full sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut, rekey, scratch, small, unused
from keyloom.llm.shingles import WordHashes, shingle_stream

SKETCH = 64
#: Least share of the sketch found; at containment 0.75 a sketch of 64 falls below 0.5 with a chance under 1e-5.
CANDIDATE = 0.5
CONTAINMENT = 75  # hundredths
#: Bits of the bitmap: so many for each sketch hash, and the exponents of its least and largest size (32 MiB).
BITS, LEAST, MOST = 1024, 16, 28
_CHUNK = 16

_NOT_WORD = re.compile(rb"[^0-9a-z\x80-\xff]+")


def item_words(text: bytes | None) -> list[bytes]:
    """Words of ASCII letters, digits and any other character beyond ASCII, in lower case; punctuation separates."""
    return _NOT_WORD.sub(b" ", (text or b"").lower()).split()


def _stream(text: bytes | None, memo: WordHashes) -> np.ndarray:
    return shingle_stream(item_words(text), memo)


def sketched(items: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """(item, item_id, size, class, sketch, shingles) of the items that have words; ``item`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                sets = [np.unique(_stream(t.as_py(), memo)).view(np.int64) for t in batch.column(1)]
                small_first = [np.sort(s.view(np.uint64))[:sketch].view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(small_first, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))], names=["item_id", "size", "sketch", "shingles"])

    known = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    found = known.mapInArrow(run, "item_id long, size long, sketch array<long>, shingles array<long>").where("size > 0")
    return cut(found.select(F.monotonically_increasing_id().alias("item"), "item_id", "size", F.floor(F.log2("size")).cast("int").alias("class"), "sketch", "shingles"))


def bitmap(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """(bytes, exponent): one bit for the lowest bits of each number in column ``hash``. Built in chunks on the executors; its size is bounded."""
    n = max(1, hashes.count())
    exponent = min(MOST, max(LEAST, int(np.ceil(np.log2(n * BITS)))))
    place = F.col("hash").bitwiseAND(F.lit((1 << exponent) - 1))
    chunks = hashes.select(F.shiftright(place, _CHUNK).alias("chunk"), place.bitwiseAND(F.lit((1 << _CHUNK) - 1)).alias("bit")).distinct()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << _CHUNK, dtype=bool)
        bits[pdf["bit"].to_numpy()] = True
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros(1 << (exponent - 3), dtype=np.uint8)
    width = 1 << (_CHUNK - 3)
    for r in chunks.groupBy("chunk").applyInPandas(fill, "chunk long, bits binary").toLocalIterator():
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out, exponent


def contained_items(docs: DataFrame, items: DataFrame, containment: int = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment): every item that a document contains.

    Needs doc_id and text in ``docs``, item_id and text in ``items``. Shingles are
    five words of letters and digits; a shorter text is one shingle as a whole,
    so an item below five words only matches a document with just its words. Null
    and wordless texts contain nothing and are contained nowhere. Items with a
    null id are left out; a repeated id counts as several items under one id.
    Rows with a null doc_id are searched like others. Empty tables give none.
    Texts of any length are searched whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "text")
    with scratch(docs.sparkSession):
        return cut(_searched(rows, "long", items, containment).withColumnRenamed("key", "doc_id"), keep=True)


def _searched(docs: DataFrame, kind: str, items: DataFrame, containment: int) -> DataFrame:
    """``contained_items`` of rows (key, text) with keys of the type ``kind``. Reads tables of the present scope."""
    known = sketched(items)
    postings = known.select("item", "class", F.size("sketch").alias("sketched"), F.explode("sketch").alias("hash"))
    bits, exponent = bitmap(postings.select("hash"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    least = int(known.agg(F.coalesce(F.min(F.size("sketch")), F.lit(1))).first()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, held, mask = WordHashes(), shared.value, np.uint64((1 << exponent) - 1)
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                rows = []
                for key, text in zip(batch.column(0), batch.column(1), strict=True):
                    number += 1
                    s = np.unique(_stream(text.as_py(), memo))
                    place = s & mask
                    hit = s[(held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                    if len(hit) and len(hit) >= CANDIDATE * least:
                        rows.append((number, key.as_py(), len(s), hit.view(np.int64), s.view(np.int64)))
                kinds = (pa.int64(), batch.schema.field(0).type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                cols = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["row", "key", "n", "hits", "all"])

    found = cut(docs.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"row long, key {kind}, n long, hits array<long>, all array<long>"))
    shared.destroy()
    hits = found.select("row", "n", F.explode("hits").alias("hit"))
    met = hits.join(small(postings), F.col("hit") == F.col("hash")).where(F.col("n") * 100 >= containment * F.pow(F.lit(2.0), "class"))
    pairs = met.groupBy("row", "item").agg(F.count("*").alias("held"), F.first("sketched").alias("sketched")).where(F.col("held") >= CANDIDATE * F.col("sketched"))
    pairs = cut(pairs.select("row", "item"))
    of = small(known.select(F.col("item").alias("it"), "item_id", "size", "shingles"), 2_000)  # rows with a set each
    texts = found.select(rekey(F.col("row")).alias("in"), "key", "all")
    verified = pairs.join(of, F.col("item") == F.col("it")).join(texts, F.col("row") == F.col("in")).select("key", "item_id", F.col("size").alias("item_shingles"), F.size(F.array_intersect("shingles", "all")).cast("long").alias("shared"))
    return verified.where(F.col("shared") * 100 >= F.col("item_shingles") * containment).withColumn("containment", F.col("shared") / F.col("item_shingles"))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text contains no item, with their columns. Each row is judged by its own text, whatever its id."""
    key = unused(docs, "_contaminated")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    with scratch(docs.sparkSession):
        bad = cut(_searched(docs.select(digest.alias("key"), "text"), "string", items, CONTAINMENT).select(F.col("key").alias(key)).distinct(), keep=True)
    names = [f"`{c}`" for c in docs.columns]
    return docs.join(small(bad), digest == F.col(key), "left_anti").select(*names)
