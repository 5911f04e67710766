"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every
token; a bitmap beside it says which tokens continue on the next level, which
holds the next chunk of those only, and so on. A rank directory counts the set
bits before every 512th position, so token i is read by one look-up a level,
without decoding what stands before it.

Files are Parquet, not compressed, with one row a segment: whole documents of
about ``SEGMENT`` tokens, in ascending doc_id order over the shards and segments.
``read_tokens`` finds tokens by their number in the whole store.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import shared_dir

SEGMENT = 1 << 16
END = 2
RANK = 512
#: Words whose tokens a worker remembers.
MEMO = 500_000
#: Bytes of text whose different parts are encoded together.
SLICE = 18 << 20
#: Words of one call of the tokenizer.
ROW = 10_000
_WHITE = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space beside other white space; texts with one, or with the string of a special token, are encoded whole.
_RUN = f" {_WHITE}|{_WHITE} "

SCHEMA = (
    "shard int, segment long, first long, n_tokens long, docs array<struct<doc_id:long,n_tokens:long>>, "
    "levels array<binary>, bitmaps array<binary>, ranks array<binary>"
)


def build_codes(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(levels, bitmaps, rank directories) of an array of ids."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & 255).astype(np.uint8).tobytes())
        more = rest > 255
        bitmaps.append(np.packbits(more, bitorder="little").tobytes())
        sums = np.concatenate(([0], np.cumsum(more)))
        ranks.append(sums[:-1:RANK].astype("<u4").tobytes())
        if not more.any():
            return levels, bitmaps, ranks
        rest = rest[more] >> 8


def token_at(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """Token i, by rank alone."""
    value, level = 0, 0
    while True:
        value |= levels[level][i] << (8 * level)
        bits = bitmaps[level]
        if not bits[i >> 3] >> (i & 7) & 1:
            return value
        start = i // RANK
        before = int.from_bytes(bits[start * RANK // 8 : (i >> 3) + 1], "little") & ((1 << (i - start * RANK)) - 1)
        i = int.from_bytes(ranks[level][4 * start : 4 * start + 4], "little") + before.bit_count()
        level += 1


def read_codes(levels: list[bytes], bitmaps: list[bytes], n: int) -> np.ndarray:
    """All ids of a segment."""
    out = np.frombuffer(levels[0], dtype=np.uint8).astype(np.uint32)
    at = np.arange(n)
    for k in range(1, len(levels)):
        at = at[np.unpackbits(np.frombuffer(bitmaps[k - 1], dtype=np.uint8), count=len(at), bitorder="little").astype(bool)]
        out[at] |= np.frombuffer(levels[k], dtype=np.uint8).astype(np.uint32) << (8 * k)
    return out


class Encoder:
    """Byte-level BPE by the tokenizers library.

    Tokens never cross the pieces that the tokenizer's own pattern cuts a text
    into. A space between two characters that are no white space always begins a
    piece, and so does a full stop or comma behind a letter, so texts are cut
    there and each different part of a batch is encoded once.
    """

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_str(model)
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        # a token of the byte-level alphabet has a character for each of its bytes
        self.width = np.zeros(self.tool.get_vocab_size(), dtype=np.int64)
        for token, i in self.tool.get_vocab().items():
            self.width[i] = len(token)
        # the first different words that this worker met, frequent ones among them: number, tokens, lengths
        self.known: dict[str, int] = {}
        self.flat, self.n = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _row(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each part) of parts that each begin with their only space: they keep their tokens when they follow one another, so they are one text."""
        if not parts:
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        found, counts = [], []
        for lo in range(0, len(parts), ROW):  # an encoding takes some hundred bytes a token
            some = parts[lo : lo + ROW]
            ids = self._plain(["".join(some)])[0]
            ends = np.cumsum(np.fromiter((len(p.encode()) for p in some), dtype=np.int64, count=len(some)))
            found.append(ids)
            counts.append(np.diff(np.searchsorted(np.cumsum(self.width[ids]), ends) + 1, prepend=0))
        return np.concatenate(found), np.concatenate(counts)

    def _codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, n): the tokens of each different word with a space before it, as ranges of one array. A mark behind a letter is left off."""
        core = [w[:-1] if len(w) > 1 and w[-1] in ".," and w[-2].isalpha() else w for w in words]
        new = dict.fromkeys(w for w in core if w not in self.known)
        row = [w for w in new if w and not w[-1].isspace()]
        alone = [w for w in new if not w or w[-1].isspace()]
        ids, counts = self._row([" " + w for w in row])
        more = self._plain([" " + w for w in alone])
        n = np.concatenate([self.n, counts, np.array([len(m) for m in more], dtype=np.int64)])
        flat = np.concatenate([self.flat, ids, *more])
        start = np.cumsum(n) - n
        at = dict(zip(row + alone, range(len(self.n), len(n)), strict=True))
        known = self.known
        which = np.fromiter((known[w] if w in known else at[w] for w in core), dtype=np.int64, count=len(core))
        if len(n) <= MEMO:
            known.update(at)
            self.flat, self.n = flat, n
        return flat, start[which], n[which]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text as unsigned 32-bit numbers in the machine's byte order."""
        texts = texts.cast(pa.large_string())
        runs = pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False)
        for special in self.special:  # such a string is one token wherever it stands
            runs = runs | pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        odd = iter(self._plain(texts.filter(pa.array(runs)).to_pylist()) if runs.any() else ())
        split = pc.split_pattern(pc.if_else(pa.array(runs), "", texts), " ")
        offsets = split.offsets.to_numpy()
        offsets, parts = offsets - offsets[0], split.flatten()
        first = np.zeros(len(parts), dtype=bool)
        first[offsets[:-1]] = True
        heads = parts.filter(pa.array(first)).to_pylist()
        rest = parts.filter(pa.array(~first)).dictionary_encode()
        flat, start, n = self._codes(rest.dictionary.to_pylist())
        words = rest.dictionary
        marked = pc.match_substring_regex(words, r"\p{L}[.,]$").to_numpy(zero_copy_only=False) if len(words) else np.empty(0, dtype=bool)
        comma = pc.ends_with(words, ",").to_numpy(zero_copy_only=False) if len(words) else marked
        marks = np.concatenate(self._plain([".", ","]))
        # words, then marks of words, then first parts, as ranges of one array of ids
        head_ids = self._plain(heads)
        flat = np.concatenate([flat, marks, *head_ids])
        head_n = np.array([len(h) for h in head_ids], dtype=np.int64)
        head_start = len(flat) - head_n.sum() + np.cumsum(head_n) - head_n
        mark_start = len(flat) - head_n.sum() - 2 + comma.astype(np.int64)
        word = rest.indices.to_numpy()
        seq = np.empty(len(parts), dtype=np.int64)
        seq[~first], seq[first] = word, np.arange(len(heads))
        for lo, hi in _spans(offsets, 50_000):
            a, b = offsets[lo], offsets[hi]
            f, q = first[a:b], seq[a:b]
            s, k, m = np.empty(2 * (b - a), dtype=np.int64), np.zeros(2 * (b - a), dtype=np.int64), ~f
            s[0::2][f], k[0::2][f] = head_start[q[f]], head_n[q[f]]
            s[0::2][m], k[0::2][m] = start[q[m]], n[q[m]]
            s[1::2] = 0
            s[1::2][m], k[1::2][m] = mark_start[q[m]], marked[q[m]]
            to = np.cumsum(k)
            ids = flat[np.repeat(s - (to - k), k) + np.arange(to[-1])] if len(to) else flat[:0]
            ends = np.concatenate(([0], to))[2 * (offsets[lo : hi + 1] - a)]
            for d in range(lo, hi):
                yield next(odd).tobytes() if runs[d] else ids[ends[d - lo] : ends[d - lo + 1]].tobytes()


def _spans(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose parts number about ``size``; a larger row is a range of its own."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, rows)
        lo = min(hi, rows)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive slices of about ``SLICE`` bytes; a larger text is a slice of its own."""
    size = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))))
    for lo, hi in _spans(size, SLICE):
        yield texts.slice(lo, hi - lo)


_encoders: dict[str, Encoder] = {}


def encoder_of(model: str) -> Encoder:
    """The encoder of this worker process, kept from task to task."""
    if model not in _encoders:
        _encoders.clear()
        _encoders[model] = Encoder(model)
    return _encoders[model]


def write_tokens(docs: DataFrame, path: str, model: str, end: int = END, segment: int = SEGMENT) -> None:
    """Encode ``docs`` (doc_id, text) and write the store.

    Documents are dealt by ranges of doc_id; ties by a hash of the text, null ids
    first. A null text is empty: its document is the end id alone.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = encoder_of(shared.value), TaskContext.get().partitionId()
        ids, docs_in, held, number, first = [], [], 0, 0, 0
        tail = np.array([end], dtype=np.uint32).tobytes()

        def flush() -> pa.RecordBatch:
            codes = build_codes(np.frombuffer(b"".join(ids), dtype=np.uint32))
            kinds = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))
            cols = [pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([docs_in], kinds)]
            return pa.RecordBatch.from_arrays(cols + [pa.array([c], pa.list_(pa.binary())) for c in codes], names=["shard", "segment", "first", "n_tokens", "docs", "levels", "bitmaps", "ranks"])

        for batch in batches:
            codes = (c for part in _slices(batch.column(1)) for c in encoder.encode(part))
            for doc_id, code in zip(batch.column(0), codes, strict=True):
                code += tail
                ids.append(code)
                docs_in.append({"doc_id": doc_id.as_py(), "n_tokens": len(code) // 4})
                held += len(code) // 4
                if held >= segment:
                    yield flush()
                    first, number = first + held, number + 1
                    ids, docs_in, held = [], [], 0
        if docs_in:
            yield flush()

    rows.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in a store; ids are little-endian 32-bit numbers."""
    store = spark.read.schema(SCHEMA).parquet(path)
    totals = store.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row a shard
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    rows = store.join(F.broadcast(before), "shard").select((F.col("before") + F.col("first")).alias("first"), "n_tokens", "docs", "levels", "bitmaps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                first, n, docs, levels, bitmaps = (batch.column(k)[r].as_py() for k in range(5))
                ids = read_codes(levels, bitmaps, n).astype("<u4")
                sizes = np.array([d["n_tokens"] for d in docs], dtype=np.int64)
                to = np.cumsum(sizes)
                parts = [ids[b - s : b].tobytes() for s, b in zip(sizes, to, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d["doc_id"] for d in docs], pa.int64()), pa.array(first + to - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_tokens(spark: SparkSession, path: str, positions: DataFrame, column: str = "position") -> DataFrame:
    """(position, token) for each different number in a column of ``positions``: the tokens at these places of the whole store.

    Only the segments that hold a position are joined with their codes, and each
    token is read by ranks. Places before the first or behind the last token, and
    nulls, give no row.
    """
    store = spark.read.schema(SCHEMA).parquet(path)
    totals = store.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row a shard
    before = F.broadcast(totals.select(F.col("shard").alias("in"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"), "n"))
    wanted = positions.select(F.col(column).cast("long").alias("position")).distinct()
    placed = wanted.join(before, (F.col("position") >= F.col("before")) & (F.col("position") < F.col("before") + F.col("n"))).select("position", F.col("in").alias("shard"), (F.col("position") - F.col("before")).alias("at"))
    # the segment of a place is the last one of its shard that begins there or before it
    order = Window.partitionBy("shard", "part").orderBy("at", F.col("position").isNotNull())
    part = F.floor(F.col("at") / (SEGMENT * 1024))  # a segment that reaches into a later part is told to it
    reach = store.select("shard", "first", F.explode(F.sequence(F.floor(F.col("first") / (SEGMENT * 1024)), F.floor((F.col("first") + F.col("n_tokens") - 1) / (SEGMENT * 1024)))).alias("part"))
    begins = reach.select("shard", "part", F.col("first").alias("at"), F.col("first").alias("segment"), F.lit(None).cast("long").alias("position"))
    both = begins.unionByName(placed.select("shard", part.alias("part"), "at", F.lit(None).cast("long").alias("segment"), "position"))
    found = both.withColumn("first", F.last("segment", ignorenulls=True).over(order)).where("position is not null")
    asked = found.groupBy("shard", "first").agg(F.collect_list(F.struct("position", (F.col("at") - F.col("first")).alias("i"))).alias("asked"))  # a segment has some ten thousand tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                codes = [batch.column(k)[r].as_py() for k in range(3)]
                rows = batch.column(3)[r].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([x["position"] for x in rows], pa.int64()), pa.array([token_at(*codes, x["i"]) for x in rows], pa.int64())], names=["position", "token"])

    return store.join(asked, ["shard", "first"]).select("levels", "bitmaps", "ranks", "asked").mapInArrow(run, "position long, token long")


def token_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder and read back (doc_id, start, n_tokens, ids_crc32).

    An empty table makes an empty store and an empty result; repeated rows and
    ids are documents of their own, and texts of any length are encoded whole.
    """
    import public_tokenizers

    spark = docs.sparkSession
    with open(model_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = f.read()
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, model)
    return read_documents(spark, path).drop("ids")
