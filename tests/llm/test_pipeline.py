"""The pipeline's stages against brute force over their own inputs."""

import corpus_pipeline
from conftest_llm import clashing
from test_near_dup import brute
from test_text_operators import brute_contained, plain_spans
from pyspark.sql import functions as F

from keyloom.llm import decontam, near_dup, toxicity


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
        assert docs.columns == columns or name == "packing"
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = seen["toxicity"]
    assert ids(after) == {r["doc_id"] for r in toxicity.toxicity(before, labels).where("predicted = 0").collect()}
    before, after = seen["near_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert ids(after) == {i for i, (_, _, kept) in brute(rows).items() if kept}
    before, after = seen["decontamination"]
    bad = {x[0] for x in brute_contained([(r["doc_id"], r["text"]) for r in before.collect()], [(r["item_id"], r["text"]) for r in items.collect()])}
    assert ids(after) == ids(before) - bad
    before, after = seen["pii"]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert not plain_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert plain_spans(old[r["doc_id"]]) or r["text"] == old[r["doc_id"]]
    before, after = seen["packing"]
    assert ids(after) == ids(before)
    assert after.groupBy("bin").agg((F.sum("n_tokens") <= F.first("capacity")).alias("fits")).where("not fits").count() == 0


def test_run_is_repeatable(spark, sf_dir):
    one, two = (corpus_pipeline.run(spark, sf_dir) for _ in range(2))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_dedup_of_clashing_columns(spark):
    docs = clashing(spark, [(1, "a b c d e f"), (2, "a b c d e f")])
    assert [r["doc_id"] for r in near_dup.deduplicated(docs).collect()] == [1]


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    item, clean, other = "a b c d e f g h", "one two three four five six", "p q r s t u v w"
    docs = clashing(spark, [(None, item), (None, clean), (1, item), (1, clean), (2, other)])
    kept = decontam.without_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, clean), (1, clean), (2, other)] and kept.columns == docs.columns
    docs = clashing(spark, [(3, item), (5, item), (5, clean), (5, clean), (7, clean), (8, None), (8, " "), (None, item)])
    kept = near_dup.deduplicated(docs)
    assert sorted((r["doc_id"] or 0, (r["text"] or "").strip()) for r in kept.collect()) == [(0, item), (3, item), (5, clean), (8, "")] and kept.columns == docs.columns
