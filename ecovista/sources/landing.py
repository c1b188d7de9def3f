"""A ledger of what has been processed, and landed payload files as a stream into it.

A run writes its output under its own name first and its entry in the ledger afterwards; the entry counts once
Spark's commit marker is there.  Output is read for entered runs only.  So a run that breaks off at any point leaves
nothing that counts, what it had to do is still pending, and a run that is entered is never done again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import graph
from ..operators.rank import last_per_key


@dataclass
class Ledger:
    """Runs in a folder: done/run=... (the keys processed), output/run=... (what came of them). key: column that names an item."""

    spark: SparkSession
    folder: str
    key: str

    def runs(self) -> list[str]:
        """Names of the runs entered; a name for each run, however many items it had."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        entered = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, "run=*/_SUCCESS")) or []
        return sorted(f.getPath().getParent().getName().removeprefix("run=") for f in entered)

    def _read(self, part: str, schema) -> DataFrame:
        """Rows of the entered runs, with the run's name."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], schema).withColumn("run", F.lit(None).cast("string"))
        paths = [f"{self.folder}/{part}/run={r}" for r in runs]
        return self.spark.read.schema(f"{schema}, run string").option("basePath", f"{self.folder}/{part}").parquet(*paths)

    def pending(self, items: DataFrame) -> DataFrame:
        """Items whose key no entered run has."""
        kind = items.schema[self.key].dataType.simpleString()
        return graph.not_processed(items, self._read("done", f"`{self.key}` {kind}"), self.key)

    def attempt(self, run: str, items: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Write the output of a run over what is pending, and give its items; without `enter` it doesn't count."""
        todo = cut(self.pending(items))
        work(todo).write.mode("overwrite").parquet(f"{self.folder}/output/run={run}")
        return todo

    def enter(self, run: str, todo: DataFrame) -> None:
        todo.select(self.key).distinct().write.mode("overwrite").parquet(f"{self.folder}/done/run={run}")

    def process(self, run: str, items: DataFrame, work: Callable[[DataFrame], DataFrame]) -> bool:
        """A whole run; says whether it ran (a run of this name that is entered isn't done again)."""
        if run in self.runs():
            return False
        self.enter(run, self.attempt(run, items, work))
        return True

    def output(self, schema: str) -> DataFrame:
        """Output of the entered runs (schema: its columns), with the run's name."""
        return self._read("output", schema)


PAYLOADS = "id string, landed long, payload string"


def land(spark: SparkSession, source: str, folder: str, normalise: Callable[[DataFrame], DataFrame] | None = None, files_a_batch: int = 1000) -> int:
    """Take in the JSON files (PAYLOADS by line) that have come to source since the last call, in micro-batches, and stop.

    Each batch is a run of the ledger in folder under the batch's number: one that was interrupted, or is replayed
    after a crash, replaces its own rows or is left out.  normalise: rows of payloads -> rows to be kept; they stay
    payloads if it isn't given.  Gives the number of batches.
    """
    ledger = Ledger(spark, folder, "id_landed")
    keep = normalise or (lambda df: df)
    counted: list[int] = []

    def take(df: DataFrame, batch: int) -> None:
        keyed = df.withColumn("id_landed", F.concat_ws("@", "id", "landed"))
        # Of an id that is there twice in one batch the latest counts, as it does between batches.
        ledger.process(f"batch-{batch:09d}", last_per_key(keyed, ["id"], "landed"), lambda todo: keep(todo.drop("id_landed")))
        counted.append(batch)

    stream = spark.readStream.schema(PAYLOADS).option("maxFilesPerTrigger", files_a_batch).json(source)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return len(counted)


def landed(spark: SparkSession, folder: str, schema: str = PAYLOADS, keys: tuple[str, ...] = ("id",), version: str = "landed") -> DataFrame:
    """The latest row of each key over all batches taken in; rows whose payload is null are tombstones."""
    rows = Ledger(spark, folder, "id_landed").output(schema)
    return graph.apply_delta(rows.limit(0), rows.withColumn("deleted", F.col("payload").isNull() if "payload" in rows.columns else F.lit(False)), list(keys), version, "deleted").drop("run", "deleted")
