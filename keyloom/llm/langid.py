"""Language by compression: the language whose dictionary makes the text smallest.

For each language a raw-content zstandard dictionary is cut from sampled
training rows. A text is normalised to lower-case letters and spaces and
compressed in blocks with every dictionary; sizes add up over the whole text,
and blocks keep a long text from becoming its own dictionary. The smallest sum
names the language; a narrow margin is reported as a rejection.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut, held_out, scratch

#: Bytes of a dictionary, of a sampled passage and of a compressed block. Texts sampled a language: one from each of so many
#: classes of their hash. Languages learnt, the most frequent first.
DICTIONARY, PASSAGE, BLOCK, SAMPLES, LANGUAGES = 96 * 1024, 2048, 4096, 144, 256
#: Least share by which the second smallest size must exceed the smallest one.
MARGIN = 0.01
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalised(text: str | None) -> bytes:
    """Letters (and numerals of letter-like form) in lower case, anything else one space; empty if there is no letter."""
    found = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return found.encode("utf-8", "replace") if any(map(str.isalpha, found)) else b""


def learn(docs: DataFrame, samples: int = SAMPLES) -> dict[str, bytes]:
    """language -> dictionary content, the most frequent language first, from at most ``samples`` different training texts a language.

    Texts fall into ``samples`` classes by a hash, and of each class the one with
    the smallest hash is taken, whichever and however many rows hold it. Each
    gives one passage of letters from a hashed place, so every language that has
    a row with a letter is learnt, up to ``LANGUAGES`` of them.
    """
    train = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).select("lang", "text")
    hashed = train.select("lang", F.xxhash64("text").alias("h"))
    classes = hashed.groupBy("lang", F.pmod("h", F.lit(samples)).alias("class")).agg(F.min("h").alias("h"), F.count("*").alias("n"))
    with scratch(docs.sparkSession):
        classes = cut(classes)
        n = {r["lang"]: r["n"] for r in classes.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
        wanted = classes.where(F.col("lang").isin(list(n))).select(F.col("lang").alias("of"), F.col("h").alias("wanted"))
        rows = train.join(F.broadcast(wanted), (F.col("lang") == F.col("of")) & (F.xxhash64("text") == F.col("wanted")))  # at most LANGUAGES * samples
        letters = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "))
        at = F.pmod("wanted", F.greatest(F.lit(1), F.length("letters") - PASSAGE)).cast("int") + 1
        picked = rows.groupBy("lang", "wanted").agg(F.min("text").alias("text")).select("lang", "wanted", letters.alias("letters")).select("lang", "wanted", F.substring("letters", at, F.lit(PASSAGE)).alias("text")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["wanted"])):
        if len(have := out.get(r["lang"], b"")) < DICTIONARY:
            out[r["lang"]] = have + normalised(r["text"]) + b" "
    return {k: out[k][:DICTIONARY] for k in sorted(n, key=lambda k: (-n[k], k)) if out.get(k, b"").strip()}


def classifier(dictionaries: dict[str, bytes], margin: float = MARGIN):
    """A function of a text column: struct of lang, score and accepted. On equal sizes the earlier dictionary wins."""
    names = list(dictionaries)

    @F.pandas_udf("lang string, score double, accepted boolean")
    def classify(texts: pd.Series) -> pd.DataFrame:
        def tools(least: int, strategy: int) -> list[zstandard.ZstdCompressor]:
            out = []
            for k in names:
                d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters(strategy=strategy, min_match=least, window_log=18, hash_log=17, chain_log=17, search_log=4, write_content_size=False)
                d.precompute_compress(compression_params=how)
                out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
            return out

        usual, finer = tools(4, zstandard.STRATEGY_LAZY2), []
        lang, score, accepted = [], [], []
        for text in texts:
            t = normalised(text)
            if not t or not names:
                lang.append(UNKNOWN), score.append(0.0), accepted.append(False)
                continue
            blocks = [t[i : i + BLOCK] for i in range(0, len(t), BLOCK)]
            sizes = np.array([sum(len(z.compress(b)) for b in blocks) for z in usual], dtype=float)
            if (sizes == sizes.min()).sum() > 1:
                # A short block may be stored as it is, at one size for all; the optimal parser finds what the usual one leaves.
                finer = finer or tools(3, zstandard.STRATEGY_BTULTRA2)
                sizes = sizes + (sizes > sizes.min()) * len(t) + np.array([sum(len(z.compress(b)) for b in blocks) for z in finer], dtype=float)
            best, *rest = np.argsort(sizes, kind="stable")
            gap = (sizes[rest[0]] - sizes[best]) / sizes[rest[0]] if rest else 1.0
            lang.append(names[best])
            score.append(float(gap))
            accepted.append(bool(gap >= margin))
        return pd.DataFrame({"lang": lang, "score": score, "accepted": accepted})

    return classify


def language(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) for every row of ``docs``.

    Needs doc_id, text and lang. ``lang_pred`` is ``und`` for a null text, a text
    without a letter, and where no language could be learnt. ``score`` is the
    share by which the best size undercuts the second best; below the margin
    ``accepted`` is false, while ``lang_pred`` still names the best. Equal sizes are
    taken again by the optimal parser; if they stay
    equal, the language with more training rows wins, with score 0. Rows with a null id are never held
    out; rows with a null or unlearnt lang are classified like all others, equal
    texts alike, and texts of any length as a whole.
    """
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), classifier(learn(docs, samples))(F.col("text")).alias("c"))
    return out.select("doc_id", "held_out", F.col("c.lang").alias("lang_pred"), F.col("c.score").alias("score"), F.col("c.accepted").alias("accepted"))
