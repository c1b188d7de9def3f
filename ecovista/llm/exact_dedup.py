"""Exact duplicates: group by a 128-bit content hash, keep one stable id, compare the bytes inside groups.

Only DataFrame functions run.  Hashing happens in the scan, so the texts themselves are not shuffled to be
grouped: a row of id and digests is.  For the byte comparison the least and the greatest text of each
group of two or more are taken with map-side aggregation (a hot group sends one row per task); the bytes
of a group are all equal exactly when these two are equal.  Groups in which they differ hold a hash
collision; those, and no others, are grouped by the text itself.

Defined results: a null text counts as empty; a null doc_id is an id below all others; repeated rows are
rows of their own in group_size, and all rows that carry the kept id count as kept; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, one_row_ids, without_ids, without_rows, written

#: Most groups whose keys are broadcast to find the texts to compare; beyond it, both sides are shuffled.
BROADCAST_GROUPS = 500_000


def exact_dedup(docs: DataFrame, keep: str = "min", normalise=None, digest=None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "min" or "max", the id of the row that stays. normalise: text column -> text column. digest: the
    128-bit content hash (text column -> column); a parameter so that collisions can be tested.
    """
    best = {"min": F.min, "max": F.max}[keep]
    normalise = normalise or (lambda c: c)
    digest = digest or (lambda c: F.unhex(F.md5(c)))
    texts = id_text(docs).select("doc_id", normalise(F.col("text")).alias("text")).withColumn("h", digest(F.col("text")))
    rows = texts.select("doc_id", "h", F.unhex(F.sha2("text", 256)).alias("sha"))
    groups = rows.groupBy("h").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    repeated = groups.filter("group_size > 1").select("h")
    collided = _collided(texts, repeated)
    if collided.isEmpty():
        return _result(rows.join(groups.hint("merge"), "h"))
    # Beyond 128 bits: rows of collided hashes are grouped by hash and text.
    exact = texts.join(collided.hint("merge"), "h", "left_semi").groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    plain = rows.join(collided.hint("merge"), "h", "left_anti").join(groups.hint("merge"), "h")
    odd = texts.join(exact.hint("merge"), ["h", "text"]).select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")
    return _result(plain.select("doc_id", "sha", "keep_id", "group_size").unionByName(odd))


def _collided(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """Hashes under which not all texts are the same bytes."""
    small = repeated.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    members = texts.select("h", "text").join(F.broadcast(repeated) if small else repeated.hint("shuffle_hash"), "h", "left_semi")
    return members.groupBy("h").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select("h")


def _result(rows: DataFrame) -> DataFrame:
    kept: Column = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, keep: str = "min") -> DataFrame:
    """docs without the rows that exact_dedup drops, columns as they are; of rows with one id and text, one stays.

    A row is dropped by its id and text together: another text under the same id, or no id, is judged on its own.
    """
    found = written(exact_dedup(docs, keep), "exact")
    repeated = found.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1")
    if not repeated.isEmpty():  # the row that stays is there more than once
        docs, row = one_row_ids(docs)
        rows = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("text_sha256"))
        first = rows.groupBy("doc_id", "text_sha256").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("count")).filter("count > 1")
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_sha256") == F.col("b.text_sha256"))
        again = rows.alias("a").join(first.alias("b").hint("merge"), same).filter(F.col(row) > F.col("first")).select(row)
        docs = without_ids(docs, again, row).drop(*([row] if row != "doc_id" else []))
    return without_rows(docs, found.filter("NOT kept"))
