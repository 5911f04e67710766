"""Toxicity scores from a linear classifier with a counterfactual penalty.

Features are the presence of words, of word beginnings and of repeated words, those
typical of toxic rows and those typical of clean ones. The model is a
logistic regression fitted on the driver over a bounded sample of labelled
rows. For every sampled text that names a group (``IDENTITY``), copies are made
in which the name is swapped for others of the list, and the squared change of
the score is added to the loss, so that naming a group moves no score by itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import cut, held_out, scratch, unused

#: Bound of the sample: labelled ids of each class, the first by a hash of the id, a text for each.
SAMPLE = {1: 4000, 0: 8000}
#: Features kept of those more frequent in a class, the most typical first. A parameter of the model like its sample.
FEATURES = {1: 4096, 0: 1024}
MIN_ROWS = 3
THRESHOLD = 0.7
#: Ridge of features typical of toxic rows and of those typical of clean ones: the latter need more evidence to hide an insult.
#: The second by two-fold validation inside the training rows of sf0.1: most toxic rows caught, then fewest false ones.
RIDGE, CLEAN_RIDGE, FAIRNESS = 1e-5, 1e-2, 2.0
#: Neutral names of groups that are swapped for one another.
IDENTITY = (
    "women men girls boys gay straight lesbian bisexual transgender black white asian latino "
    "muslim muslims christian christians jewish jews hindu buddhist atheist immigrant immigrants "
    "foreigners disabled deaf blind old young poor rich "
    "frauen männer muslime juden christen ausländer femmes hommes musulmans juifs chrétiens "
    "étrangers mujeres hombres musulmanes judíos cristianos extranjeros"
).split()

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct words of a text in lower case, their first four and five letters behind a hat, and repeated words behind a plus."""
    words = _WORD.findall((text or "").lower())
    found = set(words)
    again = {"+" + w for w, n in Counter(words).items() if n > 1} if len(found) < len(words) else set()
    return found | again | {"^" + w[:4] for w in found if len(w) > 4} | {"^" + w[:5] for w in found if len(w) > 5}


def swapped(text: str, identity: list[str]) -> list[str]:
    """Copies of a text with every name of a group replaced, by the next and by the seventh next of the list."""
    at = {w: i for i, w in enumerate(identity)}
    low = (text or "").lower()
    if not at or not any(w in at for w in _WORD.findall(low)):
        return []
    put = lambda k: lambda m: identity[(at[m[0]] + k) % len(identity)] if m[0] in at else m[0]
    return [_WORD.sub(put(k), low) for k in (1, 7)]


def sample_of(docs: DataFrame, labels: DataFrame, bound: dict[int, int]) -> DataFrame:
    """(doc_id, text, toxic): the labelled training rows, at most ``bound[c]`` of class c."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in bound.items()]
    ids = some[0].unionByName(some[1]).withColumnRenamed("doc_id", "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled"))
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # one text of a repeated id


def _chosen(sample: DataFrame, n: tuple[int, int], limits: dict[int, int]) -> tuple[list[str], list[str]]:
    """The features whose share among toxic rows exceeds that among clean ones most, by the chi-square statistic, and the other way round."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, toxic = [], []
            for text, t in zip(batch.column(0), batch.column(1), strict=True):
                f = features(text.as_py())
                words += f
                toxic += [t.as_py()] * len(f)
                if len(words) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(toxic, pa.int32())], names=["f", "toxic"])
                    words, toxic = [], []
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["f", "toxic"])

    clean, bad = n
    a, b = F.col("a"), F.col("b")
    counts = cut(sample.select("text", F.col("toxic").cast("int")).mapInArrow(count, "f string, toxic int").groupBy("f").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")))
    lean = a * clean - b * bad
    typical = (lean * lean / ((a + b) * (clean + bad - a - b + 1.0))).desc()
    sides = ((a >= MIN_ROWS) & (lean > 0), limits[1]), ((b >= MIN_ROWS) & (lean < 0), limits[0])
    toxic, clean_ones = ([r["f"] for r in counts.where(side).orderBy(typical, "f").limit(limit).collect()] for side, limit in sides)
    return toxic, clean_ones


def _rows(sample: DataFrame, vocabulary: list[str], identity: list[str]) -> pa.Table:
    """Per sampled row: its label, the numbers of its features, and those of its swapped copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f: i for i, f in enumerate(vocabulary)}
        number = lambda text: sorted(at[f] for f in features(text) if f in at)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([number(t) for t in texts], pa.list_(pa.int32())), pa.array([[number(s) for s in swapped(t, identity)] for t in texts], pa.list_(pa.list_(pa.int32())))],
                names=["doc_id", "toxic", "x", "swaps"],
            )

    return sample.select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("int")).mapInArrow(run, "doc_id long, toxic int, x array<int>, swaps array<array<int>>").orderBy("doc_id").toArrow()


def _csr(rows: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
    """(number of the row, value) of every element of lists."""
    rows = rows if isinstance(rows, pa.Array) else pa.array(rows, pa.list_(pa.int32()))
    return np.repeat(np.arange(len(rows), dtype=np.int32), pc.list_value_length(rows).to_numpy(zero_copy_only=False)), rows.flatten().to_numpy(zero_copy_only=False)


def fit_weights(x: pa.Array | list, y: np.ndarray, swaps: pa.Array | list, size: int, ridge: float | np.ndarray = RIDGE, fairness: float = FAIRNESS, steps: int = 600) -> np.ndarray:
    """Weights of ``size`` features and the bias, by Adam over the whole sample; ``x`` and ``swaps`` are lists in flat arrays."""
    w = np.zeros(size + 1)
    r, c = _csr(x)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    swaps = swaps if isinstance(swaps, pa.Array) else pa.array(swaps, pa.list_(pa.list_(pa.int32())))
    of = np.repeat(np.arange(len(swaps)), pc.list_value_length(swaps).to_numpy(zero_copy_only=False))
    r2, c2 = _csr(swaps.flatten())
    score = lambda rows, cols, n: 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=w[cols], minlength=n) + w[-1], -40, 40)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = score(r, c, len(x))
        g = share * (p - y)
        d2 = np.empty(0)
        if len(of):
            q = score(r2, c2, len(of))
            d = 2 * fairness / len(of) * (p[of] - q)
            g = g + np.bincount(of, weights=d * p[of] * (1 - p[of]), minlength=len(x))
            d2 = -d * q * (1 - q)
        grad = np.bincount(c, weights=g[r], minlength=size + 1) + ridge * w
        if len(of):
            grad += np.bincount(c2, weights=d2[r2], minlength=size + 1)
        grad[-1] = g.sum() + d2.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, bound: dict[int, int] | None = None, identity: list[str] = IDENTITY) -> tuple[dict[str, float], float]:
    """(weight of each feature, bias). With a class missing in the sample there are no weights and the bias gives the share of toxic rows."""
    with scratch(docs.sparkSession):
        sample = cut(sample_of(docs, labels, bound or SAMPLE))
        n = {int(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
        if not n.get(0) or not n.get(1):
            return {}, 40.0 if n.get(1) else -40.0
        toxic, clean = _chosen(sample, (n[0], n[1]), FEATURES)
        vocabulary, shy = sorted({*toxic, *clean, *identity}), set(clean) - set(identity)
        rows = _rows(sample, vocabulary, list(identity)).combine_chunks()
    x, swaps = (rows[c].combine_chunks() if rows[c].num_chunks != 1 else rows[c].chunk(0) for c in ("x", "swaps"))
    w = fit_weights(x, rows["toxic"].to_numpy().astype(float), swaps, len(vocabulary), np.array([CLEAN_RIDGE if f in shy else RIDGE for f in vocabulary] + [RIDGE]))
    return dict(zip(vocabulary, w[:-1].tolist(), strict=True)), float(w[-1])


def score_column(weights: dict[str, float], bias: float):
    """A function of a text column: the score between 0 and 1, from the whole text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        z = np.fromiter((sum(weights[f] for f in features(t) & weights.keys()) + bias for t in texts), dtype=float, count=len(texts))
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return score


def with_scores(docs: DataFrame, labels: DataFrame, name: str = "toxicity") -> DataFrame:
    """``docs`` and a score column fitted on its own labelled rows.

    Needs doc_id and text in ``docs``, doc_id and toxic in ``labels``. A null or
    empty text gets the score of a text without features. Rows with a null
    doc_id are scored and never learnt from. Labels other than 0 and 1 count as
    none; with several labels for one id the highest holds, and of several texts
    the least is learnt from. Equal rows get equal scores, and texts of any
    length are read whole. Every other column passes through unread.
    """
    weights, bias = fit(docs, labels)
    return docs.withColumn(name, score_column(weights, bias)(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    out = with_scores(docs.select("doc_id", "text"), labels, "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns."""
    name = unused(docs, "_toxicity")
    return with_scores(docs, labels, name).where(F.col(name) < THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))
