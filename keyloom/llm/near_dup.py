"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates.

Plan, in order:

1. One pass over the texts makes per document the size and a 128-bit digest of
   its shingle set and ``BANDS`` bucket keys. The keys come from one hash per
   shingle: the hash range is cut into ``BANDS * ROWS`` bins, each bin keeps its
   smallest hash, and an empty bin takes the value of a bin that universal
   hashing picks for it (optimal densification).
2. Documents with equal sets collapse to one representative, so exact copies of
   any number meet no bucket more than once.
3. Each bucket links its members with its smallest id only (a star), so
   candidates grow with the members and not with their square. Links are
   confirmed on the full sets.
4. Where a bucket still holds more than one component, its members of different
   components are compared too, block by block and without making rows of pairs,
   so no pair that shares a bucket is left out.
5. Components are found by alternating stars; the result joins on the digest.

A pair at the threshold 0.75 shares no bucket with a chance of
(1 - 0.75**4)**40 = 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import cut, rekey, scratch, small, unused
from keyloom.llm.graph import components
from keyloom.llm.shingles import WordHashes, mix, shingle_set

BANDS, ROWS = 40, 4
THRESHOLD = 75  # hundredths
#: Members of a family in one block; two blocks meet in one task.
BLOCK = 256


def _densifier(bins: int, tries: int) -> np.ndarray:
    """probe[bin, attempt]: the bin that an empty bin looks at, by a universal hash of both."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(0x100000001B3) + np.arange(tries, dtype=np.uint64)[None, :]
    return (mix(at + np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int64)


def one_permutation(hashes: np.ndarray, bins: int, probe: np.ndarray) -> np.ndarray:
    """Signature of ``bins`` minima of a non-empty sorted set of hashes, densified."""
    spread = np.sort(mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)))
    owner = ((spread >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.searchsorted(owner, np.arange(bins, dtype=np.uint64))
    full = first < len(owner)
    full[full] = owner[first[full]] == np.flatnonzero(full).astype(np.uint64)
    out = np.zeros(bins, dtype=np.uint64)
    out[full] = spread[first[full]]
    empty = np.flatnonzero(~full)
    for step in (8, probe.shape[1]):
        if not len(empty):
            return out
        hit = full[probe[empty, :step]]
        has = hit.any(axis=1)
        out[empty[has]] = out[probe[empty[has], hit[has].argmax(axis=1)]]
        empty = empty[~has]
    filled = np.flatnonzero(full)  # no attempt hit a full bin: any fixed rule does
    out[empty] = out[filled[empty % len(filled)]]
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    rows = signature.reshape(bands, -1)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows.shape[1]):
        h = mix(h + rows[:, k])
    return h.view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, keys): set size, digest of the set in two halves, bucket keys (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, probe = WordHashes(), _densifier(bands * rows, 1024)
        for batch in batches:
            n, d1, d2, keys = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), memo)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                d1.append(int.from_bytes(d[:8], "little", signed=True))
                d2.append(int.from_bytes(d[8:], "little", signed=True))
                keys.append(band_keys(one_permutation(s, bands * rows, probe), bands) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "d1", "d2", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"
    )


def full_sets(docs: DataFrame) -> DataFrame:
    """(id, shingles): the whole shingle set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingle_set(t.as_py(), memo).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "id long, shingles array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; texts are read again for their ids only."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct())
    texts = docs.select("doc_id", "text")
    sets = cut(full_sets(texts.join(small(ids), F.col("doc_id").cast("long") == F.col("wanted"), "left_semi")))
    left = sets.select(rekey(F.col("id")).alias("a"), F.col("shingles").alias("x"))
    right = sets.select(rekey(F.col("id")).alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("n"), (F.size("x") + F.size("y")).alias("m"))
        .where(F.col("n") * 100 >= (F.col("m") - F.col("n")) * threshold).select("a", "b")
    )


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """counts[i, j]: how many shingles x[i] and y[j] share, by merging the postings of both sides."""
    out = np.zeros(len(x) * len(y), dtype=np.int64)
    if not out.size:
        return out.reshape(len(x), len(y))
    hy, oy = np.concatenate(y), np.repeat(np.arange(len(y)), [len(s) for s in y])
    order = np.argsort(hy, kind="stable")
    hy, oy = hy[order], oy[order]
    for i, s in enumerate(x):
        lo, hi = np.searchsorted(hy, s, "left"), np.searchsorted(hy, s, "right")
        lo, n = lo[hi > lo], (hi - lo)[hi > lo]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else lo
        out[i * len(y) : (i + 1) * len(y)] = np.bincount(oy[at], minlength=len(y))
    return out.reshape(len(x), len(y))


def _dealt(one: DataFrame) -> DataFrame:
    """(id, c, family, mine, i, j) for members (id, c, family): the pairs of blocks in which each member is compared.

    A component of half a block or more has blocks of its own, which never meet
    each other; the members of smaller ones share blocks, a component in one of
    them. So a family that is one large component and some strays costs a row a
    member for each block of strays.
    """
    sizes = cut(one.groupBy("family", "c").agg(F.count("*").alias("n")))
    apart = F.col("n") * 2 >= BLOCK
    rest = sizes.groupBy("family").agg(F.ceil(F.sum(F.when(apart, 0).otherwise(F.col("n"))) / BLOCK).alias("shared"), F.sum(F.when(apart, F.ceil(F.col("n") / BLOCK)).otherwise(0)).alias("own"))
    rest = cut(rest.select(rekey(F.col("family")).alias("of"), "shared", (F.col("shared") + F.col("own")).alias("blocks")))
    before = F.sum("width").over(Window.partitionBy("family").orderBy("c")) - F.col("width")  # a row for each large component
    large = cut(sizes.where(apart).withColumn("width", F.ceil(F.col("n") / BLOCK)).select(rekey(F.col("family")).alias("in"), rekey(F.col("c")).alias("big"), "width", before.alias("before")))
    placed = (
        one.join(large, (F.col("c") == F.col("big")) & (F.col("family") == F.col("in")), "left").join(rest, F.col("family") == F.col("of"))
        .withColumn("start", F.col("shared") + F.col("before"))
        .withColumn("mine", F.when(F.col("big").isNull(), F.pmod(F.xxhash64("c"), F.col("shared"))).otherwise(F.col("start") + F.pmod(F.xxhash64("id"), F.col("width"))))
    )
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    others = F.when(F.col("big").isNull(), every).otherwise(F.filter(every, lambda k: (k < F.col("start")) | (k >= F.col("start") + F.col("width"))))
    met = placed.select("id", "c", "family", "mine", F.explode(others).alias("other"))
    return met.select("id", "c", "family", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))


def _links_between_components(rest: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """(a, b): components of ``rest`` (id, centre, c) that a link of two members joins.

    Documents that share buckets form families. A family's members are dealt
    into blocks and each pair of blocks is one group, so a family of any size is
    spread over tasks, no pair of documents is ever a row, and what comes out is
    one row for two components that a task found linked.
    """
    family = components(rest.select(F.col("id").alias("a"), F.col("centre").alias("b")))
    one = cut(
        rest.select("id", "c").distinct().join(family.withColumnRenamed("id", "of"), F.col("id") == F.col("of")).select("id", "c", F.col("component").alias("family"))
    )
    ids = one.select(F.col("id").alias("wanted"))  # an id has one component and one family
    sets = cut(full_sets(docs.select("doc_id", "text").join(small(ids), F.col("doc_id").cast("long") == F.col("wanted"), "left_semi")))
    rows = _dealt(one).join(sets.select(rekey(F.col("id")).alias("id"), "shingles"), "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        within = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        left, right = pdf[pdf["mine"] == pdf["i"]], pdf[pdf["mine"] == pdf["j"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        top = pdf["c"].mode().iloc[0]  # pairs inside the largest component need no look
        found = set()
        for x, y in ((left[left["c"] != top], right), (left[left["c"] == top], right[right["c"] != top])):
            if not len(x) or not len(y) or (within and x["c"].iloc[0] == top):
                continue
            n = _overlaps(x["shingles"].tolist(), y["shingles"].tolist())
            m = x["shingles"].map(len).to_numpy()[:, None] + y["shingles"].map(len).to_numpy()[None, :]
            i, j = np.nonzero(n * 100 >= (m - n) * threshold)
            found.update(zip(x["c"].to_numpy()[i].tolist(), y["c"].to_numpy()[j].tolist(), strict=True))
        found = sorted({(min(p), max(p)) for p in found if p[0] != p[1]})
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return cut(rows.groupBy("family", "i", "j").applyInPandas(run, "a long, b long").distinct())


def link_components(docs: DataFrame, sigs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(d1, d2, rep, component): one row for each distinct non-empty shingle set."""
    with scratch(docs.sparkSession):
        reps = cut(
            sigs.where("doc_id is not null and n_shingles > 0").groupBy("d1", "d2")
            .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")),
            keep=True,
        )
        spread = reps.select(F.col("rep").alias("id"), "n", F.explode("keys").alias("bucket"))
        shared = spread.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last")
        members = cut(spread.join(shared.select(rekey(F.col("bucket")).alias("bucket"), "centre"), "bucket"))
        stars = cut(members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())
        links = cut(_confirmed(stars, docs, threshold))
        found = components(links)

        labelled = members.join(found.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").select("bucket", "id", "centre", F.coalesce("component", "id").alias("c"))
        mixed = labelled.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(rekey(F.col("bucket")).alias("bucket"))
        rest = cut(labelled.join(mixed, "bucket", "left_semi").select("id", "centre", "c").distinct())
        if not rest.isEmpty():
            more = _links_between_components(rest, docs, threshold)
            found = components(links.unionByName(more))
        found = cut(found, keep=True)
    return reps.select("d1", "d2", "rep").join(found, F.col("rep") == F.col("id"), "left").select("d1", "d2", "rep", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Needs columns doc_id and text; others are ignored, whatever their names.
    A null or wordless text has an empty set and is a component of its own. Rows
    that share a doc_id are one vertex, with the links of any of their texts.
    Rows with a null doc_id take no part: component_id is null, kept is false.
    An empty table gives an empty result.
    """
    sigs = cut(signatures(docs))
    found = link_components(docs, sigs, threshold)
    to = found.select(rekey(F.col("d1")).alias("e1"), F.col("d2").alias("e2"), "component")
    out = sigs.join(to, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each component, with its columns: the one with the smallest doc_id.

    Rows with a null doc_id stay. Where an id is repeated every row is a vertex
    of its own, so rows that share an id stay unless their texts are linked;
    wordless rows of one id count as linked. Texts are not shuffled unless the
    rows that go are too many to send to every executor.
    """
    names, key = [f"`{c}`" for c in docs.columns], unused(docs, "_of")
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"))
    if ids.groupBy("id").count().where("count > 1").isEmpty():
        with scratch(docs.sparkSession):
            gone = cut(near_duplicates(docs, threshold).where("doc_id is not null and not kept").select(F.col("doc_id").alias(key)), keep=True)
        return docs.join(small(gone), F.col("doc_id").cast("long") == F.col(key), "left_anti").select(*names)
    row = unused(docs, "_row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))  # fixes the numbers
    rows = numbered.where("doc_id is not null").select(F.col(row).alias("doc_id"), "text", F.col("doc_id").cast("long").alias("id"))
    with scratch(docs.sparkSession):
        found = near_duplicates(rows, threshold).select(F.col("doc_id").alias("row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"))
        found = cut(found.join(rows.select(F.col("doc_id").alias("row"), "id"), "row"))
        first = found.groupBy("component", F.when(F.col("component").isNull(), F.col("id")).alias("of")).agg(F.min(F.struct("id", "row")).alias("first")).select("first.row")
        gone = cut(found.join(cut(first), "row", "left_anti").select(F.col("row").alias(key)), keep=True)
    return numbered.join(small(gone), F.col(row) == F.col(key), "left_anti").select(*names)
