"""Variable-capacity best-fit packing of documents into training sequences.

Documents are dealt by a hash into groups of bounded size, and each group is
packed in one task: longest piece first, into the open bin with the least room
that fits. Where none fits, a bin opens at the permitted length of least cost for
each token that it is expected to hold. The cost of a length is its tokens, their
share of attention, which grows with the length, and a fixed overhead. What a bin
is expected to hold follows from the pieces still to come: the longest that fits,
again and again; those pieces are then reckoned with for no other bin. When all
pieces are placed each bin shrinks to the smallest permitted length that holds
its contents.
"""

from __future__ import annotations

import base64
import bisect
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut

#: Permitted sequence lengths, in tokens, and the cost of opening a bin, in tokens.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32
#: Length at which attention costs as much as all else (six times the width of a model, here 4,096).
ATTENTION = 24_576
END = 2
#: Documents of one group; groups are packed apart from each other.
GROUP = 1024


def _expected(waiting: list[int], room: int) -> list[int]:
    """Indices, falling, of the pieces of an ascending list that fill ``room``, the longest that fits each time."""
    out, hi = [], len(waiting)
    while room > 0 and (hi := bisect.bisect_right(waiting, room, 0, hi)):
        hi -= 1
        out.append(hi)
        room -= waiting[hi]
    return out


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, final capacity of the bin, capacity at which it opened) of each piece; a piece must not exceed the largest capacity.

    Longest first; ties keep their order, so the result depends on the input only.
    """
    caps = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    waiting = sorted(lengths.tolist())  # pieces to come that no open bin reckons with
    reckoned: Counter[int] = Counter()
    used: list[int] = []
    opened: list[int] = []
    room: list[tuple[int, int]] = []  # open bins by room, then number
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for i in order:
        n = int(lengths[i])
        if reckoned[n]:
            reckoned[n] -= 1
        else:
            del waiting[bisect.bisect_left(waiting, n)]
        k = bisect.bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            best = None
            for c in caps[bisect.bisect_left(caps, n) :]:
                more = _expected(waiting, c - n)
                cost = (c + c * c / attention + overhead) / max(1, n + sum(waiting[j] for j in more))
                if best is None or cost < best[0]:
                    best = cost, c, more
            b, free = len(used), best[1]
            for j in best[2]:
                reckoned[waiting.pop(j)] += 1
            used.append(0)
            opened.append(free)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if free > n:
            bisect.insort(room, (free - n, b))
    final = np.array([caps[bisect.bisect_left(caps, u)] for u in used], dtype=np.int64)
    return (bins, offsets, final[bins], np.array(opened, dtype=np.int64)[bins]) if len(bins) else (bins, offsets, bins, bins)


def encoded(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(row, doc_id, n_tokens, ids): the byte-level BPE tokens of the whole text and the end of the document; ``row`` numbers the rows."""
    return _tokens(docs, ranks_path, True)


def with_token_counts(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(row, doc_id, n_tokens) of ``encoded``, without the ids."""
    return _tokens(docs, ranks_path, False)


def _tokens(docs: DataFrame, ranks_path: str, whole: bool) -> DataFrame:
    import public_tokenizers

    with open(ranks_path, "rb") as f:
        ranks, pattern = f.read(), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        tool = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        number = TaskContext.get().partitionId() << 33
        for every in batches:
            for lo in range(0, every.num_rows, 256):
                batch = every.slice(lo, 256)
                n, ids = [], []
                for t in batch.column(1):
                    found = tool.encode_ordinary(t.as_py() or "")
                    n.append(len(found) + 1)
                    if whole:
                        ids.append(np.array([*found, END], dtype=np.int32))
                rows = pa.array(np.arange(number, number + len(n)))
                number += len(n)
                cols, names = [rows, batch.column(0), pa.array(n, pa.int64())], ["row", "doc_id", "n_tokens"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * whole, names=names + ["ids"] * whole)

    kinds = "row long, doc_id long, n_tokens long" + ", ids array<int>" * whole
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)


def best_fit(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group: int = GROUP, overhead: int = OVERHEAD) -> DataFrame:
    """Pack (doc_id, n_tokens) rows: one row for each piece of a document.

    Returns doc_id, piece (from 0), first (token of the document at which the
    piece starts), n_tokens, bin (``group-number``), capacity (of the bin, after
    downsizing) and place (offset in the bin). Documents beyond the largest
    capacity are cut into pieces of that length and a rest; nothing is dropped.
    A null or negative length counts as 0 and takes no room. Repeated rows and
    null ids are packed as rows of their own, and dealt out by their place in the
    input too, so that no id makes a group large. Other columns are ignored.
    """
    top = max(capacities)
    lengths = cut(lengths.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"), F.monotonically_increasing_id().alias("place")))
    groups = max(1, math.ceil(lengths.count() / group))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "no_id", "n_tokens", "place"]).reset_index(drop=True)
        parts = np.maximum(1, -(-pdf["n_tokens"].to_numpy() // top))
        of = np.repeat(np.arange(len(pdf)), parts)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        n = np.minimum(top, pdf["n_tokens"].to_numpy()[of] - piece * top)
        bins, place, capacity, _ = pack(n, capacities, overhead)
        name = f"{pdf['part'].iloc[0]}-"
        return pd.DataFrame({"doc_id": pd.Series(pdf["doc_id"].to_numpy()[of], dtype="Int64").mask(pdf["no_id"].to_numpy()[of]), "piece": piece, "first": piece * top, "n_tokens": n, "bin": [name + str(b) for b in bins], "capacity": capacity, "place": place})

    part = F.pmod(F.xxhash64("doc_id", "n_tokens", "place"), F.lit(groups))
    return lengths.withColumn("part", part).groupBy("part").applyInPandas(run, "doc_id long, piece long, first long, n_tokens long, bin string, capacity long, place long")


def packed_documents(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` (columns doc_id and text) packed by their token counts; null and empty texts are their end alone."""
    import public_tokenizers

    return best_fit(with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))


def packed_sequences(docs: DataFrame, ranks_path: str | None = None, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """The training sequences: (bin, capacity, n_tokens, ids array<int>, pieces array<struct<place, doc_id, first, n_tokens>>).

    ``ids`` are the tokens of the bin's pieces one behind the other, each document
    with its end id; ``pieces`` says which document each place comes from. A row
    holds ``capacity`` tokens at most.
    """
    import public_tokenizers

    tokens = cut(encoded(docs, ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")))
    pieces = best_fit(tokens.select(F.col("row").alias("doc_id"), "n_tokens"), capacities)
    pieces = pieces.select(F.col("doc_id").alias("of"), "first", F.col("n_tokens").alias("n"), "bin", "capacity", "place")
    parts = pieces.join(tokens.select("row", "doc_id", "ids"), F.col("of") == F.col("row")).select("bin", "capacity", F.struct("place", "doc_id", "first", F.col("n").alias("n_tokens"), F.expr("slice(ids, CAST(first AS INT) + 1, CAST(n AS INT))").alias("ids")).alias("p"))
    bins = parts.groupBy("bin", "capacity").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return bins.select("bin", "capacity", F.expr("aggregate(p, 0L, (a, x) -> a + x.n_tokens)").alias("n_tokens"), F.expr("flatten(transform(p, x -> x.ids))").alias("ids"), F.expr("transform(p, x -> named_struct('place', x.place, 'doc_id', x.doc_id, 'first', x.first, 'n_tokens', x.n_tokens))").alias("pieces"))
