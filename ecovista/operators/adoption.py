"""Adoption: the mean of three average-rank percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import apart, cut
from .rank import average_percentiles


def adoption_scores(nodes: DataFrame) -> DataFrame:
    """nodes (dependency nodes): node_id, downloads, stars, forks -> percentiles and adoption_score; a missing signal is 0."""
    df = cut(nodes.select("node_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("downloads", "stars", "forks")]))  # for the ranks and for the rows
    df = average_percentiles(df, ["downloads", "stars", "forks"])
    return df.withColumn("adoption_score", (F.col("downloads_pct") + F.col("stars_pct") + F.col("forks_pct")) / 3)


def scatter(scores: DataFrame, gate: DataFrame) -> DataFrame:
    """Signals of each package, with whether it passes the gate."""
    return scores.join(apart(gate.select("node_id", "passed")), "node_id", "left").select("node_id", "stars", "forks", "downloads", F.coalesce("passed", F.lit(False)).alias("passed"))


def merge_signals(downloads: DataFrame, repo_stats: DataFrame) -> DataFrame:
    """downloads (node_id, downloads) and repo_stats (node_id, stars, forks), either of which may miss a node."""
    return downloads.join(repo_stats, "node_id", "full_outer").select("node_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("downloads", "stars", "forks")])
