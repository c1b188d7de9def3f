"""The pipeline's decisions, stage by stage, on documents with planted cases."""

import random

import pytest

pytest.importorskip("public_tokenizers")


def words(n, seed):
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    pool = ["".join(random.Random(k).choice(letters) for _ in range(6)) for k in range(2000)]
    return [r.choice(pool) for _ in range(n)]


def test_stages(spark, tmp_path):
    import corpus_pipeline

    r, rows, labels = random.Random(2), [], []
    for i in range(150):
        t = words(60, i)
        toxic = i % 3 == 0
        if toxic:
            for w in r.sample(["grubble", "snarfle", "bletch", "quonker"], 3):
                t.insert(r.randrange(60), w)
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    item = " ".join(words(40, 900))
    clean = [(1000, " ".join(words(100, 700))), (1001, " ".join(words(100, 701))), (1007, None)]
    near = words(100, 701)
    near[50] = "edited"
    planted = [(1002, clean[0][1]), (1003, " ".join(near)), (1004, " ".join(words(50, 800)) + " " + item + " " + " ".join(words(20, 801))), (1005, "you grubble, you snarfle and bletch"), (1006, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + clean + planted], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left[name] = {x["doc_id"] for x in docs.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
    a, b, c, d, e = left.values()
    good = {i for i, _ in rows if i % 3}
    assert good <= a and 1005 not in a and not {i for i, _ in rows if i % 3 == 0} & a
    assert a - b == {1000, 1006}  # of equal texts the largest id stays
    assert b - c == {1003}
    assert c - d == {1004}
    assert d == e


def test_workers_give_back_what_other_operators_keep(spark):
    """An encoder stays in a worker for tasks that encode; a task of another operator in that worker gives it up."""
    from ecovista.llm import bpe, common, queries

    path = queries.vocabulary()

    def kept_before_and_after(batches):
        import pyarrow as pa

        bpe.encoder(path)
        before = bpe.encoder.cache_info().currsize
        common.give_back()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x] * batch.num_rows, pa.int32()) for x in (before, bpe.encoder.cache_info().currsize)], ["before", "after"])

    docs = spark.createDataFrame([(i, f"some words of document {i}") for i in range(20)], "doc_id long, text string").coalesce(1)
    assert {tuple(r) for r in docs.mapInArrow(kept_before_and_after, "before int, after int").collect()} == {(1, 0)}
