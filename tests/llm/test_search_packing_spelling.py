"""The lexical search, packing and spelling operators against brute force, and on odd rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ecovista.llm import lexical_search, packing, spelling

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977} the{i % 13}" for i in range(20_000))
ODD = [(1, "The same text, idiot!"), (2, "The same text, idiot!"), (3, None), (4, ""), (5, LONG), (6, "one"), (None, "no id at all"), (1, "The same text, idiot!"), (7, "ÀÉ ß ÿ 中文 <|endoftext|> \x85\xa0 it's  two")]


def docs(spark, rows):
    """Extra columns have names that the operators use themselves."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("n", "word", "terms", "norm", "score", "length", "task", "form", "item", "run", "id")})


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("count", F.lit(1))


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(rows, queries, top=10):
    """item -> [(doc_id, score)], straight from the definition."""
    found = [(i, Counter(t)) for i, x in rows if (t := terms(x))]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = {}
    for q, x in queries:
        scores = []
        for i, c in found:
            n = sum(c.values())
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(x) if t in c)
            scores += [(-s, i)] if s > 0 else []
        out[q] = [(i, -s) for s, i in sorted(scores)[:top]]
    return out


def by_item(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["item_id"], r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


@pytest.mark.parametrize("first", [20_000, 16])
def test_search_is_exact(spark, monkeypatch, first):
    """Many documents, ties, common and rare terms; with and without first bounds from the longest vectors."""
    monkeypatch.setattr(lexical_search, "FIRST", first)
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünter", "x9", "naïve"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(i, " ".join(r.choices(vocabulary, weights, k=r.choice([0, 1, 5, 60])))) for i in range(1500)]
    rows += [(5000 + i, rows[i][1].upper()) for i in range(0, 300, 3)]
    queries = [(i, " ".join(r.choices(vocabulary, weights, k=k))) for i, k in enumerate([1, 3, 12, 40, 12, 80, 2, 25])]
    got = by_item(lexical_search.rank_documents(docs(spark, rows), items(spark, queries)))
    want = {q: x for q, x in ranked(rows, queries).items() if x}
    assert got == want


def test_search_in_parts_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "MOST_TERMS", 4)
    rows = [(i, f"a{i % 5} b{i % 3} c") for i in range(40)]
    queries = [(i, f"a{i} b1 nothing") for i in range(6)]
    assert by_item(lexical_search.rank_documents(docs(spark, rows), items(spark, queries), 3)) == ranked(rows, queries, 3)


def test_search_of_odd_rows(spark):
    queries = [(1, None), (2, ""), (3, "idiot one"), (3, "idiot one"), (4, "Word5 the5 THE5"), (5, "nowhere")]
    got = by_item(lexical_search.rank_documents(docs(spark, ODD), items(spark, queries)))
    want = ranked([(i, x) for i, x in ODD if i is not None] + [(-1, "no id at all")], [(3, "idiot one"), (4, "Word5 the5 THE5")])
    assert got == want
    for d, q in (([], queries), (ODD, [])):
        assert lexical_search.rank_documents(docs(spark, d), items(spark, q)).collect() == []


def test_buckets_are_pruned():
    """A vector whose length rules it out is not among those whose lists are read."""
    bucket = lexical_search.Bucket(np.array([9.0, 5.0, 1.0]), np.array([0, 1, 0]), np.array([9, 5, 1]), np.array([1, 1, 1]))
    assert [x.tolist() for x in bucket.search(np.array([0]), np.array([1]), 2)] == [[0], [9]]
    assert bucket.list(0, 1)[0].tolist() == [0]
    assert not len(bucket.search(np.array([0, 1]), np.array([1, 1]), 100)[0])


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def test_byte_encoder_is_the_librarys():
    e = packing.ByteEncoder(PATH)
    assert e.direct
    texts = [x or "" for _, x in ODD if x != LONG] + ["a\n\n b\t\tc  ", "don't they'LL we'd", "\x1c\x1d x\x1e", "½²³ 12ª", "  ", "é" * 300, "a" * 500]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == ids_of(t)[:-1], repr(t)


def packed(df, capacity):
    """Checks that pieces fill their sequences without gaps; returns them by document, and the number of sequences."""
    rows, bins = df.collect(), {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out, len(bins)


def test_packing_of_odd_rows(spark):
    capacity = 64
    found, n = packed(packing.pack_documents(docs(spark, ODD), PATH, 0, capacity), capacity)
    assert {k: sum(r["length"] for r in v) for k, v in found.items()} == {k: sum(len(ids_of(x)) for i, x in ODD if i == k) for k, _ in ODD}
    for i, text in ODD:
        if i == 1:
            continue  # two rows have this id
        ids, at = np.array(ids_of(text), "<u4"), 0
        for k, r in enumerate(sorted(found[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert not k or r["length"] == capacity
            at += r["length"]
    assert n == -(-sum(len(ids_of(x)) for _, x in ODD) // capacity)
    assert packing.pack_documents(docs(spark, []), PATH).collect() == []


def test_fullest_is_the_best_sum():
    r = random.Random(2)
    for _ in range(200):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(r.randrange(1, 6))}
        room = r.randrange(1, 60)
        lengths = list(counts)
        best = max(s for c in itertools.product(*[range(counts[k] + 1) for k in lengths]) if (s := sum(a * b for a, b in zip(c, lengths))) <= room)
        got = packing.fullest(counts, room)
        assert sum(got) == best and all(n <= counts[k] for k, n in Counter(got).items())


def test_plan_uses_every_piece_once():
    r = random.Random(3)
    for _ in range(20):
        histogram = {r.randrange(1, 101): r.randrange(1, 10_000) for _ in range(r.randrange(1, 40))}
        plans, used = packing.plan(histogram, 100), Counter()
        for chosen, bins in plans:
            assert sum(chosen) <= 100 and bins > 0
            for k in chosen:
                used[k] += bins
        assert used == histogram
        assert len(plans) <= 60 * len(histogram)  # plans don't grow with the number of pieces
    tenfold = {k: 10 * n for k, n in histogram.items()}
    assert len(packing.plan(tenfold, 100)) <= len(plans) + 2 * len(histogram)


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def variants(rows, least=5, times=5, every=199):
    """word -> (form, root, n, n_near, form_n) from the definition."""
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None)
    return out


def spelled(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("every", [199, 7])
def test_spelling_is_exact(spark, every):
    """Words over few letters, so that there are many near pairs, repeated letters and ties."""
    r = random.Random(every)
    vocabulary = list({"".join(r.choices("abÀ", k=r.randrange(6, 9))) for _ in range(150)}) + ["aaaaaaaa", "aaaaaaa", "bbbbbb", "bbbbbbb", "ÿëïöüâ", "ëïöüâ"]
    rows = [(i, " ".join(w.upper() if r.random() < 0.1 else w for w in r.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=80))) for i in range(150)]
    rows += [(None, "aaaaaaaa x1aaaaaaa2bbbbbb"), (3, None), (4, "")]
    want = variants(rows, every=every)
    assert sum(x[0] is not None for x in want.values()) > 10 and max(x[3] for x in want.values()) > 2
    assert spelled(spelling.spelling_variants(docs(spark, rows), every=every)) == want


def test_spelling_chains_and_long_words(spark):
    long = "x" * 3000 + "y"
    words = {"abcdefgh": 3000, "abcdefg": 500, "abcdef": 60, "abcdex": 7, long: 10, long + "z": 60, "zzzzzz": 1}
    rows = [(1, " ".join(w for w, n in words.items() for _ in range(n)))]
    want = variants(rows, every=10**10)
    assert want["abcdex"][1] == "abcdefgh" and want[long][0] == long + "z"
    assert spelled(spelling.spelling_variants(docs(spark, rows), every=10**10)) == want


def test_pivots_are_the_cheapest_disjoint_pair():
    r = random.Random(1)
    for _ in range(200):
        places = sorted((p, r.randrange(20)) for p in r.sample(range(9), r.randrange(3, 7)))
        best = min(a[1] + b[1] for a in places for b in places if b[0] - a[0] >= 2)
        a, b = spelling.pivots(places)
        assert b[0] - a[0] >= 2 and a[1] + b[1] == best


def test_spelling_of_odd_rows(spark):
    assert spelled(spelling.spelling_variants(docs(spark, ODD))) == variants(ODD)
    assert spelling.spelling_variants(docs(spark, [])).collect() == []
