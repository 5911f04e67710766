"""Near-duplicates against brute force over all pairs."""

from conftest_llm import DOCS, EDGE, clashing, sentence

from keyloom.llm import graph, near_dup
from keyloom.llm.shingles import words


def brute(rows):
    sets = {}
    for i, t in rows:
        w = words((t or "").encode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def family(rng, base, n, start, edits):
    out = []
    for k in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append((start + k, " ".join(w)))
    return out


def test_equals_brute_force(spark, rng):
    rows = [(1000 + i, sentence(rng, rng.choice([2, 4, 5, 6, 9, 30, 120]))) for i in range(60)]
    rows += family(rng, sentence(rng, 80), 40, 0, 3) + family(rng, sentence(rng, 12), 20, 200, 1) + family(rng, sentence(rng, 60), 30, 400, 5)
    rows += [(600 + i, rows[3][1].upper()) for i in range(25)]  # copies but for case
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute(rows)


def test_threshold_is_inclusive(spark):
    a = "a b c d e f g h".split()  # 4 shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:7]))]  # 3 of 4: exactly 0.75
    assert [r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).orderBy("doc_id").collect()] == [1, 1]


def test_edge_cases(spark):
    out = near_dup.near_duplicates(clashing(spark, EDGE)).collect()
    assert len(out) == len(EDGE)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out}
    assert {(None, 0, None, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True)} <= got
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert {c for c, _ in near_dup.near_duplicates(clashing(spark, EDGE)).dtypes} == {"doc_id", "n_shingles", "component_id", "kept"}


def test_deduplicated_keeps_columns_and_one_row_a_group(spark):
    docs = clashing(spark, EDGE)
    kept = near_dup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 6, 7, 8]
    twice = spark.createDataFrame([(9, "same text here"), (9, "same text here")], DOCS)
    assert near_dup.deduplicated(twice).count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
