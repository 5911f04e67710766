"""Language, decontamination, PII, licences, toxicity and packing."""

import base64
import hashlib
import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from conftest_llm import DOCS, EDGE, clashing, sentence
from pyspark.sql import functions as F

from keyloom.llm import decontam, langid, license_scan, packing, pii, toxicity
from keyloom.llm.common import held_out
from keyloom.llm.decontam import item_words

# language

LANGS = {"aa": ("foo", "bar", "baz", "qux"), "bb": ("ñandú", "señor", "año", "caña"), "cc": ("schön", "grün", "über", "für")}


def lang_rows(rng, n):
    return [(i, " ".join(rng.choice(LANGS[lang]) + rng.choice(("a", "en", "", "ing")) for _ in range(rng.choice((3, 40, 900)))), lang) for i in range(n) for lang in [rng.choice(sorted(LANGS))]]


def test_language(spark, rng):
    df = spark.createDataFrame([(i, t, g) for i, t, g in lang_rows(rng, 200)], "doc_id long, text string, lang string")
    out = langid.language(df).join(df, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out if r["held_out"]]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    blind = langid.language(df.withColumn("lang", F.when(~held_out(F.col("doc_id")), F.col("lang")))).collect()  # labels of held-out rows play no part
    assert sorted(map(tuple, blind)) == sorted(tuple(r)[:5] for r in out)


def test_language_edges(spark):
    df = clashing(spark, [(i, t, "aa" if t and "one" in t else None) for i, t in EDGE], "doc_id long, text string, lang string")
    out = langid.language(df).collect()
    assert len(out) == len(EDGE)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3, 8)} == {"und"}
    assert langid.language(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.language(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_of_repeated_rows(spark):
    rows = [(i, "the same words of one text", "en") for i in range(1000)] + [(5000, "½ ²", "en"), (5001, " ".join(["la misma cosa"] * 9000), "es"), (5002, "... 1 ... " * 900 + "sí", "es")]
    for ids in (0, 1_000_003):
        out = {r["doc_id"]: r["lang_pred"] for r in langid.language(spark.createDataFrame([(i + ids, t, g) for i, t, g in rows], "doc_id long, text string, lang string")).collect()}
        assert {out[i + ids] for i in range(1000)} == {"en"} and out[5000 + ids] == "und" and out[5001 + ids] == "es"


# decontamination


def brute_contained(docs, items):
    def shingles(t):
        w = item_words((t or "").encode())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    out = set()
    for d, t in docs:
        s = shingles(t)
        for i, q in items:
            g = shingles(q)
            if i is not None and g and 100 * len(g & s) >= 75 * len(g):
                out.add((d, i, len(g), len(g & s)))
    return out


def test_contained_items_equal_brute_force(spark, rng):
    items = [(i, sentence(rng, rng.choice((3, 5, 8, 40, 300)))) for i in range(30)] + [(None, "a b c d e f"), (99, None), (98, "")]
    docs = []
    for d in range(60):
        parts = [sentence(rng, rng.randrange(0, 400))]
        for _ in range(rng.randrange(3)):
            w = items[rng.randrange(30)][1].split()
            for _ in range(rng.choice((0, 0, 1, 2))):
                w[rng.randrange(len(w))] = "edited"
            parts.insert(rng.randrange(len(parts) + 1), " ".join(w).title())
        docs.append((d, ", ".join(parts)))
    docs += [(100, items[0][1]), (101, None), (102, "")]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contained(docs, items)
    assert want and {tuple(r)[:4] for r in decontam.contained_items(d, i).collect()} == want
    with pytest.MonkeyPatch.context() as m:  # a bitmap in which every hash is hit
        m.setattr(decontam, "BITS", 1), m.setattr(decontam, "LEAST", 4), m.setattr(decontam, "MOST", 4), m.setattr(decontam, "_CHUNK", 3)
        assert {tuple(r)[:4] for r in decontam.contained_items(d, i).collect()} == want
    clean = decontam.without_contaminated(d, i)
    assert {r["doc_id"] for r in clean.collect()} == {x for x, _ in docs} - {x[0] for x in want} and clean.columns == d.columns


def test_decontamination_edges(spark):
    docs, items = clashing(spark, EDGE), spark.createDataFrame([(1, "one"), (1, "one")], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.contained_items(docs, items).collect()} == {4, 5}
    assert decontam.contained_items(docs, items.limit(0)).count() == 0
    assert decontam.contained_items(docs.limit(0), items).count() == 0


# personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 if x > 4 else x * 2 for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_valid(kind, value):
    digits = re.sub(r"\D", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in value.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def plain_spans(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, p in PLAIN.items() for m in re.finditer(p, text or "", re.ASCII) if plain_valid(kind, m[0])]


HARD = ["a@b.com_x@y.com.", "1.2.3.4.5.6.7.8", "é +1 (414) 555-7134 4539 5787 6362 1486", "1" * 20000, "a" * 20000 + "@", "999.1.1.1 01.002.3.4 0000.1.1.1", "😀 a.b+c@d-e.f.g 😀", "@@a@@b.c", " +1-..-2 +12345678-", "4-5-3-9578763621486", None, ""]


def test_base_spans_equal_plain_patterns(spark, rng):
    texts = HARD + ["".join(rng.choice("a1.@ +-(%_9é") for _ in range(60)) for _ in range(200)]
    out = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    for i, t in enumerate(texts):
        spans = plain_spans(t)
        assert out[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert [out[i][f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in spans) for k in PLAIN]


def test_disclosing_terms(spark, rng):
    lines = [f"{sentence(rng, 4)} zebrafish contact secret@corp.example about {sentence(rng, 3)}" for _ in range(6)]
    lines += [f"filler line {sentence(rng, 8)}" for _ in range(300)] + ["filler zebra nothing"] * 3
    df = spark.createDataFrame(list(enumerate(lines)), DOCS)
    terms = {r["term"] for r in pii.disclosing_terms(df).collect()}
    assert "zebrafish" in terms and "filler" not in terms
    row = pii.personal_data(df).where("doc_id = 0").first()
    at = lines[0].index("zebrafish")
    assert f"term:{at}:{at + 9}" in row["spans"] and row["spans"].startswith("email:")
    text = pii.sanitised(df).where("doc_id = 0").first()["text"]
    assert "zebrafish" not in text and "secret@corp" not in text and "[EMAIL]" in text and "[TERM]" in text
    assert pii.sanitised(df).where("doc_id = 100").first()["text"] == lines[100]
    alone = spark.createDataFrame([(i, "uniqueword me@x.example") for i in range(20)] + [(99, "other")], DOCS)
    assert pii.disclosing_terms(alone).count() == 0  # copies of one line are no evidence


def test_value_of_one_line_has_terms(spark, rng):
    lines = ["zebrafish contact secret@corp.example about filler"] + [f"filler contact about {sentence(rng, 8)} {i}" for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(lines)), DOCS)
    assert [(r["entity"], r["term"]) for r in pii.disclosing_terms(df).collect()] == [("email:secret@corp.example", "zebrafish")]
    assert pii.sanitised(df).where("doc_id = 0").first()["text"] == "[TERM] contact [EMAIL] about filler"


def test_words_of_a_value_beside_it_are_terms(spark):
    lines = ["Anna Li smith of k9 anna.smith@corp.example filler"] + [f"filler of w{i}" for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(lines)), DOCS)
    assert {r["term"] for r in pii.disclosing_terms(df).collect()} == {"anna", "li", "smith", "k9"}
    assert pii.sanitised(df).where("doc_id = 0").first()["text"] == "[NAME] [NAME] [TERM] of [NUMBER] [EMAIL] filler"


def brute_terms(texts):
    """entity, term -> risk, by the definition in the module's docstring."""
    term, contexts, plain = re.compile(r"[^\W_]+"), [], []
    for line in (x for t in texts for x in (t or "").split("\n")):
        held = {}
        for kind, p in PLAIN.items():

            def put(m, kind=kind):
                if not plain_valid(kind, m[0]):
                    return m[0]
                held[len(held)] = f"{kind}:{m[0].lower()}"
                return f"\ue000{len(held) - 1}\ue001"

            line = "".join(put(re.match(p, x, re.ASCII)) if k % 2 else x for k, x in enumerate(whole_split(p, line)))
        tokens = re.findall(r"\ue000\d+\ue001|[^\W_]+", line.lower())
        for k in range(0, len(tokens), pii.CONTEXT):
            some = tokens[k : k + pii.CONTEXT]
            values = sorted({held[int(t[1:-1])] for t in some if t[0] == "\ue000"})
            words = [t for t in some if t[0] != "\ue000"]
            plain += words
            contexts += [(tuple(values), tuple(words))] if values else []
    n_t, n_e, n_te, different = Counter(plain), Counter(), Counter(), Counter()
    for (values, words), n in Counter(contexts).items():
        for e in values:
            n_e[e] += n * len(words)
            n_te.update({(e, w): n * k for w, k in Counter(words).items()})
            different.update({(e, w): 1 for w in set(words)})
    out = {}
    for (e, w), n in n_te.items():
        prior = n_e[e] / len(plain)
        share = (different[e, w] * n / n_t[w] + prior) / (different[e, w] + 1)
        if n_e[e] < len(plain):
            out[e, w] = math.log(share / prior) / -math.log(prior)
    return out


def whole_split(pattern, text):
    """What stands between the matches of a pattern, and the matches, in turn."""
    out, at = [], 0
    for m in re.finditer(pattern, text, re.ASCII):
        out += [text[at : m.start()], m[0]]
        at = m.end()
    return [*out, text[at:]]


def test_disclosing_terms_equal_brute_force(spark, rng):
    values = ["a.b@c.example", "+1 414 555 7134", "10.0.0.1", "4539 5787 6362 1486"]
    texts = []
    for _ in range(150):
        w = sentence(rng, rng.choice((3, 20, 150)), 90).split()
        for _ in range(rng.choice((0, 0, 1, 3))):
            w.insert(rng.randrange(len(w)), rng.choice(values) + rng.choice((" Zeta", " 7th", "")))
        w.insert(rng.randrange(len(w)), rng.choice(("\n", "Été")))
        texts.append(" ".join(w))
    texts += texts[:20] + [None, ""]
    want = brute_terms(texts)
    got = {(r["entity"], r["term"]): r["risk"] for r in pii.disclosing_terms(spark.createDataFrame(list(enumerate(texts)), DOCS), 0.3).collect()}
    assert got.keys() == {k for k, v in want.items() if v >= 0.3} and len(got) > 20
    assert all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def test_strong_terms_are_removed(spark, rng):
    lines = [f"Zebra w{i} me@x.example" for i in range(80)] + [f"filler of w{i} v{i}" for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(lines)), DOCS)
    assert pii.sanitised(df).where("doc_id = 5").first()["text"] == " w5 [EMAIL]"


def test_spans_are_places_of_the_text(spark):
    lines = ["İİİ f0a g0b zebrafish contact secret@corp.example q0"] + [f"filler contact of w{i}" for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(lines)), DOCS)
    row = pii.personal_data(df).where("doc_id = 0").first()
    assert {lines[0][int(a) : int(b)] for k, a, b in (x.split(":") for x in row["spans"].split(",")) if k == "term"} == {"İİİ", "f0a", "g0b", "zebrafish", "q0"}
    assert pii.sanitised(df).where("doc_id = 0").first()["text"] == "[NAME] [NUMBER] [NUMBER] [TERM] contact [EMAIL] [NUMBER]"


def test_long_texts_take_time_in_proportion(spark):
    text = " ".join(f"word{i % 977} x{i}@mail.example" if i % 6 == 0 else f"word{i % 977}" for i in range(100_000))
    df = spark.createDataFrame([(1, text)], DOCS).cache()
    df.count()
    start = time.perf_counter()
    assert df.select(F.expr(f"size({pii.located('text', pii._TERM)})").alias("n")).first()["n"] == len(re.findall(r"[^\W_]+", text))
    assert df.select(F.size(pii.base_spans("text", "email")).alias("n")).first()["n"] == 16667
    assert time.perf_counter() - start < 8  # 30 s and more where every match copies those before
    assert "@" not in pii.sanitised(df).first()["text"]


def test_pii_edges(spark):
    docs = clashing(spark, [*EDGE, (20, "x a@b.co y"), (20, "x a@b.co y"), (21, "x y " * 50)])
    docs = docs.select("*", *(F.lit(7).alias(c) for c in "_row _key _at new found pieces old key terms".split() if c not in docs.columns))
    assert pii.personal_data(docs).count() == len(EDGE) + 3
    out = pii.sanitised(docs)
    assert out.columns == docs.columns and [r["text"] for r in out.where("doc_id = 20").collect()] == ["x [EMAIL] y"] * 2
    assert pii.personal_data(docs.limit(0)).count() == 0 and pii.sanitised(docs.limit(0)).count() == 0


# licences


def test_licence_base_and_labels(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = ["MIT-License, cc BY; mit license É İ", "cc cc by by", "x" * 100000, "mit license " * 3000, None, "", "GNU general public\nlicense and the Apache License",
             "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "license license mit", "Licensed under CC BY-NC 4.0."]
    out = {r["doc_id"]: r for r in license_scan.scan(clashing(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = out[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert out[7]["labels"] == "bsd" and out[9]["labels"] == "cc-by,cc-by-nc" and out[8]["labels"] == ""


def test_every_licence_of_a_document_is_found(spark):
    every = " . ".join(text for _, text, _ in license_scan.TEMPLATES)
    # the words that are rare over the corpus stand apart from the notice that is whole
    apart = "mozilla affero creative commons attribution redistribution binary " + "filler " * 50 + "under the terms of the gnu lesser general public license as published by the free software foundation"
    docs = [(0, every), (1, apart)] + [(i, "the gnu lesser general public license as published by the free software foundation") for i in range(2, 12)]
    out = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(docs, DOCS)).collect()}
    assert out[0]["labels"] == ",".join(sorted({label for label, _, _ in license_scan.TEMPLATES}))
    assert out[1]["labels"] == "lgpl"


def brute_licences(text):
    """(labels, best share, alignments) over every template at every place."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, best, n = {label for p, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}, 0.0, 0
    base = bool(labels)
    for label, wording, phrase in license_scan.TEMPLATES:
        words, need = wording.split(), phrase.split()
        places = [p for p, x in enumerate(words) if x not in license_scan.FUNCTION_WORDS]
        off = next(i for i in range(len(words)) if words[i : i + len(need)] == need)
        for s in range(-len(words), len(w)):
            share = sum(0 <= s + p < len(w) and w[s + p] == words[p] for p in places) / len(places)
            if share >= license_scan.COVERAGE:
                n += 1
                if s + off >= 0 and w[s + off : s + off + len(need)] == need:
                    labels.add(label)
                    best = max(best, share)
    return ",".join(sorted(labels)), 1.0 if base else best, n


def test_licence_labels_equal_brute_force(spark, rng):
    texts = []
    for _ in range(60):
        parts = [sentence(rng, rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            w = rng.choice(license_scan.TEMPLATES)[1].split()
            for _ in range(rng.choice((0, 0, 2, len(w) // 3, len(w) // 2))):
                w[rng.randrange(len(w))] = rng.choice(("edited", "license", "the"))
            lo = rng.choice((0, 0, 0, len(w) // 3))
            parts.append(rng.choice((" ", ", ", "\n")).join(w[lo:]).title())
        texts.append(". ".join(parts))
    out = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert len({r["labels"] for r in out}) > 8
    for r in out:
        labels, score, n = brute_licences(texts[r["doc_id"]])
        assert (r["labels"], r["candidates"]) == (labels, n) and abs(r["score"] - score) < 1e-12, texts[r["doc_id"]]


def test_licence_edges(spark):
    assert license_scan.scan(clashing(spark, EDGE)).count() == len(EDGE)
    assert license_scan.scan(spark.createDataFrame([], DOCS)).count() == 0


# toxicity


def toxic_rows(rng, n):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = sentence(rng, 40).split()
        if bad:
            w[rng.randrange(40)] = rng.choice(("vilething", "vileperson", "scumbag"))
            w[rng.randrange(40)] = "vilestuff"
        if i % 3 == 0:
            w[rng.randrange(40)] = "muslim" if bad else rng.choice(("christian", "gay"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_and_is_blind_to_held_out_labels(spark, rng):
    rows, labels = toxic_rows(rng, 400)
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxicity(docs, lab).join(lab, "doc_id").collect()
    assert all(r["predicted"] == r["toxic"] == int(r["score"] >= 0.7) for r in out if r["held_out"])
    flipped = lab.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, toxicity.toxicity(docs, flipped).collect())) == sorted(tuple(r)[:4] for r in out)
    keeps = toxicity.without_toxic(spark, docs, lab)
    assert keeps.columns == docs.columns and keeps.count() == 300


def test_counterfactual_penalty_closes_the_gap():
    rng = np.random.default_rng(0)
    x, y, swaps = [], [], []
    for _ in range(400):
        bad = rng.random() < 0.5
        group = 1 if rng.random() < (0.9 if bad else 0.1) else 2  # feature 1 names one group, 2 another
        x.append([0, group] if bad and rng.random() < 0.7 else [group])
        y.append(float(bad))
        swaps.append([[*x[-1][:-1], 3 - group]])
    gap = lambda w: abs(w[1] - w[2])
    free, fair = (toxicity.fit_weights(x, np.array(y), swaps, 3, fairness=f) for f in (0.0, 50.0))
    assert gap(fair) < 0.2 * gap(free)


def test_swapping_a_group_hardly_moves_a_score(spark, rng):
    rows, labels = toxic_rows(rng, 600)
    weights, bias = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = lambda t: 1 / (1 + math.exp(-sum(weights[f] for f in toxicity.features(t) & weights.keys()) - bias))
    named = [(score(t), [score(s) for s in toxicity.swapped(t, toxicity.IDENTITY)]) for _, t in rows]
    gaps = [abs(a - b) for a, swaps in named for b in swaps]
    assert len(gaps) > 200 and np.mean(gaps) < 0.02 and max(gaps) < 0.25
    assert any(w < 0 for w in weights.values()) and any(w > 0 for w in weights.values())


def test_repeated_id_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(2, f"text {i}") for i in range(500)] + [(4, "x")], DOCS)
    labels = spark.createDataFrame([(2, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.sample_of(docs, labels, toxicity.SAMPLE).groupBy("doc_id").count().where("count > 1").isEmpty()


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (None, 1), (7, 5)], "doc_id long, toxic int")
    docs = clashing(spark, EDGE)
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(EDGE) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


# packing


def test_pack_fits_and_downsizes(rng):
    lengths = np.array([rng.randrange(0, 8193) for _ in range(500)])
    bins, places, caps, opened = packing.pack(lengths)
    assert len(set(opened.tolist())) > 1 and (opened >= caps).all()
    for b in np.unique(bins):
        at = np.flatnonzero(bins == b)
        order = at[np.argsort(places[at], kind="stable")]
        ends = places[order] + lengths[order]
        assert (places[order][1:] == ends[:-1]).all() and ends[-1] <= caps[at[0]]
        assert caps[at[0]] == min(c for c in packing.CAPACITIES if c >= lengths[at].sum())
    assert lengths.sum() / sum(caps[np.flatnonzero(bins == b)[0]] for b in np.unique(bins)) > 0.95
    assert [list(x) for x in packing.pack(np.array([100, 300]))][:3] == [[0, 0], [300, 0], [512, 512]]


def least_room(lengths, caps):
    """The smallest sum of capacities of any packing, by trying all partitions."""
    best = [sum(min(c for c in caps if c >= n) for n in lengths)]

    def put(k, bins):
        if k == len(lengths):
            best[0] = min(best[0], sum(min(c for c in caps if c >= b) for b in bins))
            return
        for j in range(len(bins)):
            if bins[j] + lengths[k] <= max(caps):
                put(k + 1, [*bins[:j], bins[j] + lengths[k], *bins[j + 1 :]])
        put(k + 1, [*bins, lengths[k]])

    put(0, [])
    return best[0]


def test_pack_is_near_the_best_packing(rng):
    caps, ratios, opened = (8, 13, 20, 32), [], set()
    for _ in range(150):
        lengths = np.array([rng.randrange(1, 33) if rng.random() < 0.4 else rng.randrange(1, 9) for _ in range(rng.randrange(1, 8))])
        bins, _, final, at = packing.pack(lengths, caps, overhead=1, attention=96)
        room = sum(final[np.flatnonzero(bins == b)[0]] for b in np.unique(bins))
        ratios.append(room / least_room(lengths.tolist(), caps))
        opened |= set(at.tolist())
    assert opened == set(caps) and np.mean(ratios) < 1.08 and max(ratios) <= 1.7


def test_lengths_decide_the_capacity():
    at = lambda *lengths: set(packing.pack(np.array(lengths))[3].tolist())
    assert at(*[500] * 40) < set(packing.CAPACITIES) and max(at(*[500] * 40)) < 8192  # small ones need no long sequence
    assert at(*[1000] * 9) != at(*[1400] * 9) and at(5000, 4000) == {8192, 4096}


def test_sequences_hold_the_tokens_of_their_documents(spark):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    tool = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    rows = [*EDGE, *[(70, "a hot row ü")] * 40]
    out = packing.packed_sequences(clashing(spark, rows), capacities=(64, 512, 2048)).collect()
    got = {}
    for r in out:
        assert len(r["ids"]) == r["n_tokens"] <= r["capacity"] and sum(p["n_tokens"] for p in r["pieces"]) == r["n_tokens"]
        for p in r["pieces"]:
            got.setdefault(p["doc_id"], []).append((p["first"], r["ids"][p["place"] : p["place"] + p["n_tokens"]]))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*tool.encode_ordinary(t or ""), packing.END])
    for i, texts in want.items():
        assert sorted(sum((x for _, x in sorted(got[i])), [])) == sorted(sum(texts, []))
    assert sum((x for _, x in sorted(got[6])), []) == want[6][0]


def test_rows_of_one_id_are_dealt_out(spark):
    out = packing.best_fit(spark.createDataFrame([(1, 100)] * 3000, "doc_id long, n_tokens long"), group=500)
    sizes = [r["count"] for r in out.groupBy(F.split("bin", "-")[0].alias("g")).count().collect()]
    assert sum(sizes) == 3000 and len(sizes) == 6 and max(sizes) < 700

def test_best_fit_is_whole(spark):
    rows = [(None, 5), (2**60 + 1, 20000), (3, None), (3, 7), (3, 7), (4, -2), (5, 8192)]
    df = clashing(spark, rows, "doc_id long, n_tokens long")
    out = packing.best_fit(df).collect()
    assert len(out) == 7 + 2
    assert sum(r["n_tokens"] for r in out) == 5 + 20000 + 14 + 8192
    assert sorted(r["first"] for r in out if r["doc_id"] == 2**60 + 1) == [0, 8192, 16384]
    assert packing.best_fit(df.limit(0)).count() == 0
    assert packing.packed_documents(clashing(spark, EDGE)).where("n_tokens < 1").count() == 0
