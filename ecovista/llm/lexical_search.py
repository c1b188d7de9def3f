"""Ranked lexical search: documents of the highest BM25-like integer scores for each item, by inner products in norm buckets.

A document is the vector of its impacts: for each term that any item holds, the term's weight times its damped
frequency; an item is the vector of its terms' numbers, and a score is their inner product.  Vectors are made
in the scan, ordered by length (range shuffle, longest first) and handled in buckets.  With the least score an
item still needs, a whole bucket is left out for it where the item's length times that of the bucket's longest
vector is less (Cauchy-Schwarz), and likewise the shorter vectors of a bucket that is opened.  Inside, the
item's rarest terms are added up first; a document goes when that sum plus the bound on all other coordinates
(what is left of both lengths, again by Cauchy-Schwarz) is less than needed.  Survivors get their scores in
64-bit integers.  The needed score starts with the tenth best of what the longest vectors give, and rises as
a task finds better documents; equal scores are never pruned, so ties are decided by doc_id alone.

Defined results: null texts and items have no terms, documents without terms are not counted; rows with a null
or repeated doc_id are documents of their own, ties go to the lesser doc_id with null first and then to the
shorter document; rows of one item_id are one item with the terms of its different texts, and a null item_id
is an id like others; an empty table gives an empty result; texts may be of any length; other columns are
not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text_kernel
from .common import arrow_batches, by_size, id_text, most_frequent, shuffle_partitions, written

TOP = 10
#: Share of the length in the damping, in percent.
LENGTH_PERCENT = 75
#: Vectors that give the first bounds.
FIRST = 20_000
#: Terms of items that are sent to every task, 16 bytes each; items with more are handled in parts, with a scan for each.
MOST_TERMS = 2_000_000
#: An item's coordinates that are added up before the bound is taken.
FOCUS = 6
_ALNUM = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: Bytes as they count in terms: letters lower-case, all that is in no term a blank.
_FOLDED = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in set(_ALNUM) else 0x20 for b in range(256))


def hash_terms(texts: list[bytes]) -> text_kernel.Words:
    """Terms of UTF-8 texts as 64-bit hashes: maximal runs of letters, digits and anything beyond ASCII."""
    return text_kernel.hash_words([t.translate(_FOLDED) for t in texts])


def term_counts(docs: DataFrame, vocabulary: np.ndarray | None) -> DataFrame:
    """One row per document with terms: doc_id, n (its terms), terms (places in the sorted vocabulary of hashes, or the
    hashes of all terms if there is no vocabulary) and tfs (how often each is there)."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in by_size(batches, 1):
            words = hash_terms(text_kernel.utf8(batch.column(1)))
            owner, hashes = np.repeat(np.arange(batch.num_rows), words.counts), words.hashes
            if vocabulary is not None:
                place = np.searchsorted(vocabulary, hashes)
                known = np.append(vocabulary, vocabulary[-1:])[place] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                owner, hashes = owner[known], place[known]
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))) if len(owner) else np.zeros(0, np.int64)
            tfs = np.diff(np.append(first, len(owner)))
            ends = np.searchsorted(owner[first], np.arange(batch.num_rows + 1))
            some = words.counts > 0
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int64())).filter(pa.array(some)) for v in (hashes[first].astype(np.int64), tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some)), pa.array(words.counts[some], pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<long>, tfs array<long>")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, count: the terms of each item with how often they are there."""
    texts = items.select(F.col("item_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    each = term_counts(texts, None).select(F.col("doc_id").alias("item_id"), F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    return each.groupBy("item_id", F.col("x.terms").alias("term")).agg(F.sum("x.tfs").alias("count"))


def _vectors(counts: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, n, norm, terms, impacts: the documents' vectors that are not 0; weights: of each place in the vocabulary."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, lists = batch.column(1).to_numpy(), batch.column(2)
            offsets = np.asarray(lists.offsets)
            terms, tf = lists.values.to_numpy()[offsets[0] : offsets[-1]], batch.column(3).values.to_numpy()[offsets[0] : offsets[-1]]
            sizes = np.diff(offsets)
            m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * n * n_docs // n_terms
            impact = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes)))
            square = np.zeros(len(n))
            np.add.at(square, np.repeat(np.arange(len(n)), sizes), impact.astype(float) ** 2)
            some = pa.array(square > 0)
            ends = pa.array(offsets - offsets[0], pa.int32())
            made = [batch.column(0), batch.column(1), pa.array(np.sqrt(square)), pa.ListArray.from_arrays(ends, pa.array(terms)), pa.ListArray.from_arrays(ends, pa.array(impact))]
            yield pa.RecordBatch.from_arrays([x.filter(some) for x in made], ["doc_id", "n", "norm", "terms", "impacts"])

    return counts.mapInArrow(run, "doc_id long, n long, norm double, terms array<long>, impacts array<long>")


class Bucket:
    """Vectors, longest first, as an inverted list of each term."""

    def __init__(self, norm: np.ndarray, terms: np.ndarray, impacts: np.ndarray, sizes: np.ndarray):
        self.norm = norm
        row = np.repeat(np.arange(len(norm)), sizes)
        order = np.argsort(terms, kind="stable")
        self.rows, self.impacts = row[order], impacts[order]
        self.terms, first = np.unique(terms[order], return_index=True)
        self.ends = np.append(first, len(order))

    def list(self, term: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows before `least` that hold the term, and their impacts."""
        i = int(np.searchsorted(self.terms, term))
        if i == len(self.terms) or self.terms[i] != term:
            return self.rows[:0], self.impacts[:0]
        a, b = self.ends[i], self.ends[i + 1]
        b = a + int(np.searchsorted(self.rows[a:b], least))
        return self.rows[a:b], self.impacts[a:b]

    def search(self, terms: np.ndarray, counts: np.ndarray, needed: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of all vectors that reach `needed` (over 0); terms in order of falling weight."""
        length = float(np.sqrt((counts.astype(float) ** 2).sum()))
        bound = needed * (1 - 1e-9) / length
        least = int(np.searchsorted(-self.norm, -bound, "right"))
        if not least:
            return self.rows[:0], self.impacts[:0]
        score, left = np.zeros(least, np.int64), self.norm[:least] ** 2
        found = [self.list(int(t), least) for t in terms]
        for (rows, impacts), count in zip(found[:FOCUS], counts):
            score[rows] += count * impacts
            left[rows] -= impacts.astype(float) ** 2
        rest = float(np.sqrt((counts[FOCUS:].astype(float) ** 2).sum()))
        may = score + rest * np.sqrt(np.maximum(left, 0) + 1e-12 * self.norm[:least] ** 2) >= needed * (1 - 1e-9)
        if not may.any():
            return self.rows[:0], self.impacts[:0]
        for (rows, impacts), count in zip(found[FOCUS:], counts[FOCUS:]):
            score[rows] += count * impacts
        rows = np.flatnonzero(may & (score >= needed))
        return rows, score[rows]


def _search(vectors: DataFrame, items: list[tuple], needed: list[int], top: int) -> DataFrame:
    """item (its place in items), doc_id, n, score: of each task, the best `top` documents that reach what is needed (at least 1)."""

    def run(batches):
        import pyarrow as pa

        best: list[list] = [[] for _ in items]
        bounds = list(needed)
        for batch in batches:  # a bucket, in order of length again if it is of several files
            batch = batch.take(pa.array(np.argsort(-batch.column(2).to_numpy(), kind="stable")))
            offsets = np.asarray(batch.column(3).offsets)
            take = slice(offsets[0], offsets[-1])
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            bucket = Bucket(batch.column(2).to_numpy(), batch.column(3).values.to_numpy()[take], batch.column(4).values.to_numpy()[take], np.diff(offsets))
            for i, (terms, counts) in enumerate(items):
                rows, scores = bucket.search(terms, counts, bounds[i])
                if len(rows):
                    best[i] += [(-int(s), ids[r] is not None, ids[r] or 0, n[r]) for r, s in zip(rows, scores)]
                    best[i] = sorted(best[i])[:top]
                    if len(best[i]) == top:
                        bounds[i] = max(bounds[i], -best[i][-1][0])
        out = [(i, x[2] if x[1] else None, x[3], -x[0]) for i, found in enumerate(best) for x in found]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)], ["item", "doc_id", "n", "score"])

    return vectors.mapInArrow(run, "item int, doc_id long, n long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "n")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _rank_part(docs: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """item_id, rank, doc_id, score of the items whose terms are given (see item_terms; MOST_TERMS rows or so)."""
    spark = docs.sparkSession
    rows = terms.collect()
    vocabulary = np.unique(np.array([r["term"] for r in rows], np.int64).view(np.uint64))
    counts = written(term_counts(docs, vocabulary), "counts")
    all_docs = counts.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_terms")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # a row for each term of an item
        weights[r["term"]] = math.floor(1000 * math.log((2 * all_docs["n_docs"] + 2) / (2 * r["df"] + 1)))
    by_item: dict[int | None, list] = {}
    for r in rows:
        place = int(np.searchsorted(vocabulary, np.uint64(r["term"] & (1 << 64) - 1)))
        if weights[place]:
            by_item.setdefault(r["item_id"], []).append((-int(weights[place]), place, r["count"]))
    ids, items = list(by_item), []
    for found in by_item.values():
        found.sort()
        items.append((np.array([p for _, p, _ in found]), np.array([c for _, _, c in found])))
    vectors = _vectors(counts, weights, all_docs["n_docs"], all_docs["n_terms"])
    vectors = written(vectors.repartitionByRange(shuffle_partitions(spark), F.desc("norm"), "doc_id").sortWithinPartitions(F.desc("norm")), "vectors")
    needed = [1] * len(items)
    for r in _ranked(_search(most_frequent(vectors, "norm", FIRST), items, needed, top), top).filter(F.col("rank") == top).collect():  # a row for each item
        needed[r["item"]] = r["score"]
    least = min((k / float(np.sqrt((c.astype(float) ** 2).sum())) for k, (_, c) in zip(needed, items)), default=0.0)
    found = _ranked(_search(vectors.filter(F.col("norm") >= least * (1 - 1e-9)), items, needed, top), top)
    names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")  # as many as the part has items
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """docs: doc_id, text; items: item_id, text -> item_id, rank, doc_id, score: each item's `top` best documents."""
    terms = written(item_terms(items), "item-terms")
    parts = -(-terms.count() // MOST_TERMS) or 1
    of = lambda i: terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i)
    return reduce(DataFrame.unionByName, [_rank_part(id_text(docs), of(i), top) for i in range(parts)])
