"""A full run as one of several rounds: its date and label go into the snapshot, the store and the comparison."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import snapshots
from ..sources import tables
from .ecosystem import Ecosystem

#: Columns of a stored snapshot that rounds are compared by.
STORED = "snapshot_date date, round_label string, gate_pass_rate double, borderline long, pony_rate double, mean_hhi double, median_hhi double, debt_size long, active_repos long, projects long, dependency_edges long, bridge_edges long, keystone_count long, max_core long, date string, round string"


@dataclass(frozen=True)
class Round:
    """as_of: the day that ages are counted to; label: the round's name."""

    as_of: date
    label: str | None = None

    def stamped(self, snapshot: DataFrame) -> DataFrame:
        """The snapshot with its date and label."""
        return snapshot.withColumns({"snapshot_date": F.lit(self.as_of), "round_label": F.lit(self.label).cast("string")})


def stored_rounds(spark, folder: str) -> DataFrame:
    """All stored rounds by date: snapshot_date, label and the metrics."""
    return tables.read_snapshots(spark, folder, STORED).withColumnRenamed("round_label", "label")


def close(e: Ecosystem, this: Round, folder: str) -> dict[str, Callable[[], DataFrame]]:
    """Store the run's snapshot below folder and give all results as functions, those of the comparison with the last round
    before it (no rows, if there is none) among them: snapshot, comparison, trend, comparison_table."""
    snapshot = cut(this.stamped(e.snapshot))
    tables.write_snapshot(snapshot, folder)
    rounds = stored_rounds(e.nodes.sparkSession, folder).filter(F.col("snapshot_date") <= F.lit(this.as_of))
    # Dates are compared by the store's own order; of one date the label decides, so that a rerun compares as before.
    last = rounds.filter((F.col("snapshot_date") < F.lit(this.as_of))).orderBy(F.desc("snapshot_date"), F.desc("label")).limit(1)
    own = rounds.filter((F.col("snapshot_date") == F.lit(this.as_of)) & F.col("label").eqNullSafe(F.lit(this.label)))
    pair = last.unionByName(own)
    return e.results() | {
        "snapshot": lambda: snapshot, "comparison": lambda: snapshots.deltas(pair), "trend": lambda: snapshots.trend(snapshots.deltas(pair)),
        "comparison_table": lambda: snapshots.comparison_table(pair), "rounds": lambda: rounds,
    }
