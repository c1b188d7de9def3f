"""A pipeline over the documents table; each stage is written as Parquet and read again as the next one's input.

Toxic documents go, then exact copies, then near copies (one document of each group stays), then documents that
hold benchmark passages; what is left is encoded.
"""

from __future__ import annotations

from ecovista.llm import bpe, decontaminate, exact_dedup, jaccard_join, toxicity
from ecovista.llm.common import table, written
from ecovista.llm.queries import vocabulary


def drop_toxic(spark, docs, sf_dir):
    """Documents scored 0.7 or more go; the score is learned from the labels table, as in op6."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark, docs, sf_dir):
    """Of identical texts the row with the largest doc_id stays, as in op2."""
    return exact_dedup.drop_exact_duplicates(docs, keep="max")


def drop_near_copies(spark, docs, sf_dir):
    """Of each component of links at a Jaccard similarity of 0.75 or more, the smallest doc_id stays, as in op10."""
    return jaccard_join.drop_near_duplicates(docs)


def drop_benchmark(spark, docs, sf_dir):
    """Documents with a passage within 0.15 edits a letter of a benchmark item go, as in op3."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """Numbers of ids and digests of every document left, as in op4."""
    return bpe.encode_documents(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("BPE encoding and decoding", encode),
]

#: Trained scores and tokenizers can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
