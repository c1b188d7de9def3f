"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ecovista.llm import bpe, decontaminate, exact_dedup, hmm_lm, jaccard_join, license_scan, secret_scan, substring_dedup, token_store, toxicity

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} the{i % 13}" for i in range(20_000))
ROWS = [(1, "The same text, idiot!"), (2, "The same text, idiot!"), (3, None), (4, ""), (5, LONG), (6, "one"), (None, "no id at all"), (1, "The same text, idiot!")]


def docs(spark, rows=ROWS):
    """Extra columns have names that the operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"h": F.lit(1), "n": F.lit("x"), "token": F.lit(None).cast("string"), "keep_id": F.lit(0), "row": F.lit(2), "dropped_id": F.lit(1), "score": F.lit(0.5)})


LABELS = "doc_id long, quality long, toxic long"


def operators(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 5)] + [(None, None, None)], LABELS)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "x" * 100)], "item_id long, text string")
    return {
        "exact": lambda d: exact_dedup.exact_dedup(d, "max"), "bpe": lambda d: bpe.encode_documents(d, PATH), "tokens": lambda d: token_store.store_and_read(d, PATH, 2),
        "hmm": lambda d: hmm_lm.score_documents(d, 1), "toxic": lambda d: toxicity.score_documents(d, labels), "secret": secret_scan.scan_secrets, "jaccard": jaccard_join.jaccard_components,
        "contamination": lambda d: decontaminate.find_contamination(d, items), "passages": substring_dedup.repeated_passages, "licence": license_scan.scan_licences,
    }


PER_ROW = ["exact", "bpe", "tokens", "hmm", "toxic", "secret", "jaccard"]


@pytest.mark.parametrize("name", [*PER_ROW, "contamination", "passages", "licence"])
def test_odd_rows(spark, name):
    got = operators(spark)[name](docs(spark)).collect()
    if name in PER_ROW:
        assert len(got) == len(ROWS)
    if name == "contamination":
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(6, 3)}


@pytest.mark.parametrize("name", [*PER_ROW, "contamination", "passages", "licence"])
def test_empty_table(spark, name):
    assert operators(spark)[name](docs(spark, [])).collect() == []


def test_exact_values(spark):
    got = sorted({tuple(r) for r in exact_dedup.exact_dedup(docs(spark), "max").collect()}, key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    same = sha(ROWS[0][1])
    assert (1, 2, 3, False, same) in got and (2, 2, 3, True, same) in got
    assert (3, 4, 2, False, sha("")) in got and (None, None, 1, True, sha("no id at all")) in got
    kept = exact_dedup.drop_exact_duplicates(docs(spark), "min")
    assert kept.columns == docs(spark).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5, 6]


def test_exact_collisions(spark):
    """With a digest of one value everything collides; the bytes still decide."""
    d = docs(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "c")])
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(d, "min", digest=lambda c: F.lit(b"0")).collect()}
    assert got == {(1, 1, 2), (3, 1, 2), (2, 2, 1), (4, 4, 1)}


def test_jaccard_values(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs(spark)).collect()}
    assert got[2] == got[1] == (1, 1) and got[3] == (0, 3) and got[4] == (0, 4) and got[6] == (1, 6) and got[None][1] is None


def test_hmm_counts(spark):
    rows = [(i, "a b b" if i % 2 else "A c") for i in range(30)]
    got = {r["doc_id"]: r for r in hmm_lm.score_documents(docs(spark, rows), 2).collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["n_tokens"] == (4 if i % 2 else 3) == r["n_known"]
        assert r["score"] < 0 and r["base_score"] < 0
    assert len({r["train_tokens"] for r in got.values()}) == 1


def plain(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def left(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


X, Y = "one two three four five six", "another text of some words here"


def test_drops_are_by_row(spark):
    """A dropped id says nothing about another text under the same id, nor about rows without one."""
    d = plain(spark, [(1, X), (2, X), (1, Y), (None, X), (None, None), (2, X)])
    assert left(exact_dedup.drop_exact_duplicates(d, "max")) == sorted([(2, X), (1, Y), (None, None)], key=str)
    t = [f"w{i}" for i in range(60)]
    near = " ".join(t[:-1] + ["other"])
    d = plain(spark, [(None, " ".join(t)), (3, near), (4, " ".join(t)), (3, Y), (None, Y), (7, None), (7, None)])
    assert left(jaccard_join.drop_near_duplicates(d)) == sorted([(3, near), (3, Y), (7, None), (7, None)], key=str)
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(d).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (4, 3), (3, 3), (None, 3), (7, 7), (7, 7)], key=str)
    items = plain(spark, [(1, " ".join(t))]).withColumnRenamed("doc_id", "item_id")
    assert left(decontaminate.drop_contaminated(d, items)) == sorted([(3, Y), (None, Y), (7, None), (7, None)], key=str)
    assert left(decontaminate.drop_contaminated(plain(spark, [(1, " ".join(t)), (1, Y)]), items)) == [(1, Y)]


def test_drops_carry_other_columns_along(spark):
    """Columns of names that the operators use themselves come out as they went in, with their values."""
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(1, t), (2, t), (3, None), (4, Y), (5, t + " more")]
    names = ["h", "n", "token", "keep_id", "row", "component_id", "score", "rank", "text_sha256", "item_id", "features", "size"]
    d = plain(spark, rows).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    items = plain(spark, [(1, Y)]).withColumnRenamed("doc_id", "item_id")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 6)], LABELS)
    for drop, ids in [
        (lambda x: exact_dedup.drop_exact_duplicates(x, "max"), [2, 3, 4, 5]), (jaccard_join.drop_near_duplicates, [1, 3, 4]),
        (lambda x: decontaminate.drop_contaminated(x, items), [1, 2, 3, 5]), (lambda x: toxicity.drop_toxic(x, labels), [1, 2, 3, 4, 5]),
    ]:
        out = drop(d)
        assert out.columns == d.columns
        got = out.collect()
        assert sorted(r["doc_id"] for r in got) == ids and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names)


def test_contamination_in_blocks_of_items(spark, monkeypatch):
    """Several blocks find what one finds: of what a search through all pairs finds all that has up to 0.1 edits a letter, and nothing else.

    Between that and the limit of 0.15 recall is under 1: here one pair of two items' texts (21 edits of 144 letters) is not found.
    """
    texts = [" ".join(f"{w}{(i * 7 + k) % 89}" for k, w in enumerate(["alpha", "beta", "gamma", "delta"] * 5)) for i in range(12)]
    items = plain(spark, list(enumerate(texts))).withColumnRenamed("doc_id", "item_id")
    edited = lambda t, k: t[:k] + "#" + t[k + 1 :]
    d = plain(spark, [(i, f"before it {edited(edited(t, 20), 60)} behind it") for i, t in enumerate(texts) if i % 3] + [(100, Y), (101, None)])
    found = lambda: sorted(map(tuple, decontaminate.find_contamination(d, items).collect()))
    one = found()
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 3)
    assert found() == one

    def least(item, text):  # edits from item to the nearest part of text
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            last, row = row, [i]
            for j, b in enumerate(text, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a != b)))
        return min(row)

    near = {(r["doc_id"], k): e for r in d.filter("text IS NOT NULL").collect() for k, t in enumerate(texts) if (e := least(t, r["text"])) <= 0.15 * len(t)}
    got = {(x[0], x[1]): x[4] for x in one}
    assert got.items() <= near.items() and {k for k, e in near.items() if e <= 0.1 * len(texts[k[1]])} <= got.keys() and len(got) >= 8


def test_pipeline_keeps_a_row_of_each_text(spark, tmp_path):
    """Null and repeated ids through the stages that drop rows."""
    import corpus_pipeline

    rows = [(1, X), (2, X), (1, Y), (None, X), (None, "z " + Y), (5, None), (5, "")]
    plain(spark, rows).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0)}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0 for r in out)) == [1, 2, 5] or sorted((r["doc_id"] or 0 for r in out)) == [0, 1, 2, 5]


def test_most_frequent(spark):
    from ecovista.llm.common import most_frequent

    counts = spark.createDataFrame([(k, 1 + k * k) for k in range(200)], "k long, c long")
    got = {r["k"] for r in most_frequent(counts, "c", 50).collect()}
    assert got == set(range(200 - len(got), 200)) and 40 <= len(got) <= 50
    assert most_frequent(counts, "c", 1000).count() == 200 and most_frequent(counts.limit(0), "c", 5).isEmpty()


def tokens_of(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_bpe_and_token_files_are_the_librarys(spark):
    """Null, empty, long, repeated texts and a null id: ids, digests, and places in the files."""
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for i, t in rows:
        ids, text = tokens_of(t)
        want.append((i, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = bpe.encode_documents(docs(spark), PATH).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    got = token_store.store_and_read(docs(spark), PATH, 2).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    plain_ids = {(i, t): tokens_of(t)[0] + [2] for i, t in rows}
    got = sorted(map(tuple, got), key=lambda r: r[1])
    assert [r[0] for r in got] == [i for i, _ in rows]
    for (i, t), (doc, start, n, crc) in zip(rows, got):
        ids = plain_ids[i, t]
        assert (doc, start, n, crc) == (i, at, len(ids), zlib.crc32(packed(ids)))
        at += n


def test_hmm_base_score(spark):
    """n_known, train_tokens and base_score by counting, with null and empty texts, repeated rows and a null id."""
    import math
    import re
    from collections import Counter

    rows = [*ROWS, *[(k, " ".join(f"w{(k * j) % 17}" for j in range(k % 9))) for k in range(20, 60)]]
    split = lambda t: re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in [*split(t), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        w = [*split(t), None]
        want.append((i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in hmm_lm.score_documents(docs(spark, rows), 1).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_values_of_scans_on_odd_rows(spark):
    """Texts without anything to find score as the empty one; spans of empty texts are none."""
    got = secret_scan.scan_secrets(docs(spark)).collect()
    assert {(r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in got} == {(0, 0, 0, hashlib.sha256(b"").hexdigest(), "")}
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 5)], LABELS)
    got = toxicity.score_documents(docs(spark), labels).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[3] == score[4] == score[6] and all(0 <= x <= 1 for x in score.values())
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: i is None or zlib.crc32(str(i).encode()) % 3 == 1 for i in score}
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert license_scan.scan_licences(docs(spark)).collect() == []
    assert substring_dedup.repeated_passages(docs(spark, [*ROWS, (None, LONG)])).collect() == []
    pair = substring_dedup.repeated_passages(docs(spark, [*ROWS, (9, LONG)])).collect()
    assert {(r["doc_id"], r["other_id"], r["class_id"]) for r in pair} == {(9, 5, 5)}


def test_repeated_shingles_are_counted_in_little_memory():
    import tracemalloc

    import numpy as np

    from ecovista.llm.jaccard_join import _repeated

    numbers = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 500):
        x = numbers.integers(0, max(1, n // 4), n)
        values, counts = np.unique(x, return_counts=True)
        got = _repeated([x[: n // 2], x[n // 2 :]], 3)
        assert (got[0] == values[counts >= 3]).all() and (got[1] == counts[counts >= 3]).all()
    held = [numbers.integers(0, 1 << 62, 100_000) for _ in range(10)]
    tracemalloc.start()
    _repeated(held, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 8_000_000  # np.unique with counts took 2.4 times the values, beside those passed in
