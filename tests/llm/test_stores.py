"""Token files, WARC archives and vectors: exact round trips and brute force."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest_llm import DOCS, EDGE, clashing

from keyloom.llm import embed_dup, queries, sql, token_store, warc

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_codes_give_random_access():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 300, 3000), rng.integers(0, 2**20, 3000), np.array([255]), np.array([256]), np.zeros(1024, int)):
        levels, bitmaps, ranks = token_store.build_codes(ids)
        assert (token_store.read_codes(levels, bitmaps, len(ids)) == ids).all()
        assert [token_store.token_at(levels, bitmaps, ranks, i) for i in range(len(ids))] == ids.tolist()


def test_token_store_equals_whole_encoding(spark):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*EDGE, (-5, "a  b\n\n\tc <|endoftext|> it's  "), (-6, "a <|endoftext|> b"), (-7, "x<|endoftext|>y z"), (-4, "don't  'll 123abc   "), (-3, "x  y\r\n")]
    out = sorted(token_store.token_digests(clashing(spark, rows)).collect(), key=lambda r: r["start"])
    assert len(out) == len(rows)
    texts, at, last = {}, 0, None
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in out:
        ids = [np.array([*tool.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts[r["doc_id"]]]
        assert (r["n_tokens"], r["ids_crc32"]) in {(len(x), zlib.crc32(x.tobytes())) for x in ids} and r["start"] == at
        at += r["n_tokens"]
        assert last is None or r["doc_id"] >= last
        last = r["doc_id"]
    assert token_store.token_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_store_gives_random_access(spark, rng, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT", 2)  # many parts of many segments
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice((0, 3, 400, 6000))))) for i in range(30)] + EDGE
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        token_store.write_tokens(spark.createDataFrame(rows, DOCS), str(tmp_path / "s"), f.read(), segment=900)
    every = sorted((r["start"], np.frombuffer(bytes(r["ids"]), "<u4")) for r in token_store.read_documents(spark, str(tmp_path / "s")).collect() if r["n_tokens"])
    flat = np.concatenate([x for _, x in every])
    ask = [0, len(flat) - 1, len(flat), -1, None] + [rng.randrange(len(flat)) for _ in range(400)]
    got = {r["position"]: r["token"] for r in token_store.read_tokens(spark, str(tmp_path / "s"), spark.createDataFrame([(a,) for a in ask], "position long")).collect()}
    assert got == {a: int(flat[a]) for a in ask if a is not None and 0 <= a < len(flat)}


MAGIC = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n"


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "u", None), (2, "v\r\nX: y", ""), (3, None, MAGIC), (4, "x", MAGIC * 3 + "é"), (5, "x", MAGIC * 3 + "é"), (6, "x", "WARC/1.1\r\n" * 5), (7, "x", MAGIC + "x" * 90000 + MAGIC), (8, "x", "plain"), (None, "x", "plain")]
    df = clashing(spark, rows, "page_id long, url string, html string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")  # many blocks, chains that cross them
    try:
        out = warc.archived(df, str(tmp_path / "a")).collect()
        content = {hashlib.sha1(bytes(r["content"])).hexdigest() for r in warc.read_contents(spark, str(tmp_path / "a")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first.setdefault(h or "", i)
    want = set()
    for i, _, h in rows:
        b, f = (h or "").encode(), first[h or ""]
        want.add((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == f else "revisit", None if i == f else f))
    assert len(out) == len(rows) and set(map(tuple, out)) == want
    assert content >= {hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in rows}


def test_records_have_a_date_and_ids_of_their_own(spark, tmp_path):
    rows = [(1, "a", "p"), (1, "b", "p"), (1, "a", "q"), (None, "a", "r"), (None, "a", "s"), (2, "c", "p")]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "d"))
    heads = [r["head"] for r in warc.read_records(spark, str(tmp_path / "d")).collect()]
    field = lambda name: [re.search(rf"(?m)^{name}: (\S+)\r?$", h)[1] for h in heads if re.search(rf"(?m)^{name}:", h)]
    assert len(set(field("WARC-Record-ID"))) == len(rows) and set(field("WARC-Refers-To")) <= set(field("WARC-Record-ID"))
    assert len(field("WARC-Date")) == len(rows) and all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", d) for d in field("WARC-Date"))


def test_archive_edges(spark, tmp_path):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    (tmp_path / "cut.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nok\r\n\r\nWARC/1.1\r\nContent-Length: 50\r\n\r\nhalf")
    assert [(r["size"], r["sha1"] is None) for r in warc.read_records(spark, str(tmp_path)).orderBy("at").collect()] == [(2, False), (50, True)]


def brute_vectors(rows, cosine=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {k: [j for j, (_, b) in enumerate(ok) if j != k and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine] for k, (_, a) in enumerate(ok)}
    out, seen = [(i, 0, i, i is not None) for i, v in rows if not any(v is w for _, w in rows if v and None not in v and np.isfinite(v).all() and any(v) and i is not None)], {}
    for k in sorted(links, key=lambda k: ok[k][0]):
        if k not in seen:
            todo = [k]
            while todo:
                u = todo.pop()
                if u not in seen:
                    seen[u] = ok[k][0]
                    todo += links[u]
    return sorted(out + [(ok[k][0], len(links[k]), seen[k], seen[k] == ok[k][0]) for k in links], key=str)


@pytest.mark.parametrize("hashes", [None, 2, 3, 5])
def test_vectors_equal_brute_force(spark, monkeypatch, hashes):
    monkeypatch.setattr(embed_dup, "HOT", 20)
    monkeypatch.setattr(embed_dup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(120)]
    for start, n, noise in ((200, 60, 0.05), (300, 40, 0.16), (400, 15, 0.2)):
        base = rng.normal(size=24)
        rows += [(start + k, (base + noise * rng.normal(size=24)).tolist()) for k in range(n)]
    rows += [(500 + k, rows[0][1]) for k in range(5)] + [(600, (np.array(rows[1][1]) * 3).tolist()), (700, [1.0, 2.0]), (701, [2.0, 4.0])]
    rows += [(800, None), (801, []), (802, [0.0] * 24), (803, [1.0, None]), (804, [float("nan")] * 24), (None, [1.0] * 24)]
    df = clashing(spark, rows, "vec_id long, embedding array<double>")
    out = embed_dup.near_vectors(df, hashes=hashes).collect()
    assert sorted(map(tuple, out), key=str) == brute_vectors(rows)
    assert embed_dup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("hashes", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("width", [5, 64, 100])
def test_pairs_at_the_threshold_meet(hashes, width):
    """Fresh pairs at 0.95 exactly: all meet with the tables used, and with a third of them, whose chance of a miss is 1e-3, nearly all."""
    rng = np.random.default_rng(11)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 1000, width)))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    tables = embed_dup.tables_needed(hashes, width)
    a, b = (np.concatenate([embed_dup.bucket_keys(v[lo : lo + 500], hashes, tables, embed_dup.PROBES) for lo in range(0, 1000, 500)]) for v in (x, y))
    met = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
    assert met.any(axis=1).all()
    if width >= 16:
        assert (~met[:, : -(-tables // 3)].any(axis=1)).mean() < 0.004


def test_sql_gives_the_same(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "documents benchmark pages embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, text in sql.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, sf_dir)
        assert sorted(map(str, map(tuple, got.select(*sorted(got.columns)).collect()))) == sorted(str(tuple(r)) for r in con.sql(f"SELECT {', '.join(sorted(got.columns))} FROM ({text})").fetchall()), name
