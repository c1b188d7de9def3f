"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_dir

#: Rows of one Arrow batch given to a Python worker; with this, a batch of typical documents is a few MB.
ARROW_ROWS = 1000


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a lineage cut that survives lost executors.

    The size estimate of what is read back is that of its files, so later joins are planned on true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text only, whatever other columns docs has; a null text is the empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def arrow_batches(spark: SparkSession) -> None:
    """Keep batches that Spark hands to Python small, so that a worker's memory doesn't depend on the table.  Results are
    computed after the call, so the session keeps the setting; one that is smaller already stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


#: Bytes of text that a task lays out at once; a batch of long documents is cut into such parts.
TEXT_BYTES = 1 << 20


def by_size(batches, column: int):
    """Arrow batches cut so that a part holds TEXT_BYTES of the column's text, or one row.  What the batch before has left
    free is given back, so that a worker that is used again doesn't keep the most that it has ever held."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right")))
            yield batch.slice(at, stop - at)
            at = stop
        pa.default_memory_pool().release_unused()


_kept: list = []


def kept_in_worker(make):
    """make, with what it made last kept by a worker process that is used again, until give_back."""
    cached = lru_cache(maxsize=2)(make)
    _kept.append(cached)
    return cached


def give_back() -> None:
    """At the start of a task: what other operators' tasks have kept or left in this worker process is given up, as it isn't used here."""
    for cached in _kept:
        cached.cache_clear()
    gc.collect()  # models and their tables refer to each other


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Most ids that are broadcast to drop rows; beyond it, both sides are shuffled.
BROADCAST_IDS = 1_000_000


def few(keys: DataFrame) -> bool:
    """Whether there are at most BROADCAST_IDS rows (of narrow keys); reads no more than that many."""
    return keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def _unused(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id and text are none of dropped (doc_id, text_sha256 in hex): another text under a
    dropped id stays.  Nulls are values (a null text is the empty one); columns and their order stay."""
    keys = dropped.select(F.col("doc_id").cast("long").alias("dropped_id"), F.unhex("text_sha256").alias("dropped_sha")).distinct()
    names = [_unused(n, docs.columns) for n in keys.columns]
    keys = keys.toDF(*names)
    sha = F.unhex(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(names[0])) & (sha == F.col(names[1]))
    return docs.join(F.broadcast(keys) if few(keys) else keys.hint("merge"), same, "left_anti")


def without_ids(docs: DataFrame, ids: DataFrame, by: str = "doc_id") -> DataFrame:
    """Rows of docs whose id (column `by`) is not in ids (one column); columns and order of columns stay.

    For ids that name one row each: see one_row_ids.
    """
    name = _unused("dropped_id", docs.columns)
    ids = ids.toDF(name).filter(F.col(name).isNotNull())
    return docs.join(F.broadcast(ids) if few(ids) else ids.hint("merge"), docs[by] == F.col(name), "left_anti")


def one_row_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column that names each row: doc_id if no id is null or repeated, else a number given to every row.

    With the number, docs is written out first, so that a row keeps it whatever is computed again.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        return docs, "doc_id"
    name = _unused("row_number", docs.columns)
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of counts (a written table) with the greatest n: all above the least bound that at most `most` rows pass.

    The bound comes from a histogram of at most 1,024 cells, so no task and no driver ever sorts the rows; what is
    returned is bounded by `most` and may be collected or broadcast.
    """
    cell = F.floor(F.log2(F.col(n) + F.lit(1.0)) * 16).cast("int")
    bound, total = None, 0
    for row in sorted(counts.groupBy(cell.alias("cell")).count().collect(), key=lambda r: -r["cell"]):
        total += row["count"]
        if total > most:
            break
        bound = row["cell"]
    return counts.filter(F.lit(False)) if bound is None else counts.filter(cell >= bound)
