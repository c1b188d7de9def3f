"""How concentrated maintenance is: shares, HHI, entropy, top contributor; and roll-ups of commits."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.lineage import apart
from ..functions.tiers import hhi_tier, top_share_band
from .rank import place


def sum_contributions(rows: DataFrame, on_duplicate: str = "sum") -> DataFrame:
    """One row per (contributor, repo): commits summed, or those of the last row in order of `ord`."""
    if on_duplicate == "last":
        return rows.groupBy("repo", "contributor").agg(F.max_by("commits", "ord").alias("commits"))
    return rows.groupBy("repo", "contributor").agg(F.sum("commits").cast("long").alias("commits"))


def shares(contributions: DataFrame) -> DataFrame:
    """contributions with total (per repo) and share; totals are aggregated and joined back, so no repo meets in one task."""
    totals = contributions.groupBy("repo").agg(F.sum("commits").cast("long").alias("total"))
    return contributions.join(apart(totals), "repo").withColumn("share", F.when(F.col("total") > 0, F.col("commits") / F.col("total")).otherwise(0.0))


def commit_share_percent(contributions: DataFrame) -> DataFrame:
    return shares(contributions).select("repo", "contributor", "commits", F.round(100 * F.col("share"), 2).alias("commit_share_pct"))


def concentration(contributions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per repo with commits: flag of a top share at the threshold, HHI (exact and rounded), entropy, tier, top contributor (ties: least)."""
    s = shares(contributions).filter("total > 0")
    p = F.col("share")
    top = F.max("share").alias("top_share"), F.min_by("contributor", F.struct(-p, "contributor")).alias("top_contributor")
    g = s.groupBy("repo").agg(
        F.sum(p * p).alias("_sq"), F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0)).alias("_h"), *top,
        F.count(F.lit(1)).alias("n_contributors"), F.max("total").alias("total_commits"),
    )
    hhi = F.col("_sq") * 10_000
    return g.select(
        "repo", (F.col("top_share") >= config.top_share_flag).cast("int").alias("pony_factor"), hhi.alias("hhi_exact"), F.round(hhi, 1).alias("hhi"),
        F.round(F.abs("_h"), 3).alias("entropy"), hhi_tier(F.round(hhi, 6), config).alias("hhi_tier"), "top_contributor", F.round("top_share", 3).alias("top_share"), "n_contributors", "total_commits",
    )


def roll_up_commits(commits: DataFrame) -> DataFrame:
    """commits: repo, email, name, committed_at -> per (repo, email): commits, first and last date, display (name of the first commit), aliases."""
    g = commits.groupBy("repo", "email").agg(
        F.count(F.lit(1)).alias("commits"), F.min("committed_at").alias("first_date"), F.max("committed_at").alias("last_date"),
        F.min_by("name", F.struct("committed_at", "name")).alias("display"), F.collect_set("name").alias("_names"),
    )
    return g.select("repo", "email", "commits", "first_date", "last_date", "display", F.array_sort(F.array_except("_names", F.array("display"))).alias("aliases"))


def recency(repos: DataFrame, commits: DataFrame, as_of) -> DataFrame:
    """Per repo: latest commit and age in whole days at as_of; 9999 for repos without commits."""
    latest = commits.groupBy("repo").agg(F.max("committed_at").alias("latest_commit"))
    return repos.join(apart(latest), "repo", "left").select("repo", "latest_commit", F.coalesce(F.datediff(as_of, "latest_commit"), F.lit(9999)).cast("long").alias("days_since_commit"))


def in_window(commits: DataFrame, as_of, days: int) -> DataFrame:
    return commits.filter(F.col("committed_at") >= F.date_sub(as_of, days))


def top_contributors(contributions: DataFrame) -> DataFrame:
    """Per repo: sum of commits, top contributor (ties: least), its share in percent and the band of it."""
    c = sum_contributions(contributions).groupBy("repo").agg(F.sum("commits").cast("long").alias("total"), F.min(F.struct((-F.col("commits")).alias("minus"), "contributor")).alias("best"))
    pct = F.round(100 * -F.col("best.minus") / F.col("total"), 2)
    return c.filter("total > 0").select("repo", "total", F.col("best.contributor").alias("top_contributor"), pct.alias("top_pct"), top_share_band(pct).alias("band"))


def share_histogram(top: DataFrame, bins: int = 20) -> DataFrame:
    """Equal bins over 0 to 100, the last one closed; empty bins have 0."""
    width = 100 / bins
    counts = top.groupBy(F.least(F.floor(F.col("top_pct") / width), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = top.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return spine.join(F.broadcast(counts), "bin", "left").na.fill(0, ["n"])  # bins rows each


def hhi_histogram(conc: DataFrame, bins: int = 40) -> DataFrame:
    return conc.groupBy("hhi_tier", F.least(F.floor(F.col("hhi") / (10_000 / bins)), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def tier_summary(conc: DataFrame) -> DataFrame:
    total = F.sum(F.count(F.lit(1))).over(Window.partitionBy())  # over one row for each tier
    return conc.groupBy("hhi_tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hhi"), 1).alias("mean_hhi"), F.round(F.avg("pony_factor"), 4).alias("pony_rate"), F.round(100 * F.count(F.lit(1)) / total, 2).alias("pct"))


def flagged_share(top: DataFrame, at: float = 50.0) -> DataFrame:
    """One row: repos, those whose top contributor has `at` percent or more, and their percentage."""
    hit = F.count_if(F.col("top_pct") >= at)
    return top.agg(F.count(F.lit(1)).alias("n"), hit.alias("n_flagged"), F.round(100 * hit / F.count(F.lit(1)), 2).alias("flagged_pct"))


def band_summary(top: DataFrame, conc: DataFrame) -> DataFrame:
    """Per band of the top contributor's share: repos and their percentage; mean HHI and flagged share over all repos."""
    total = F.sum(F.count(F.lit(1))).over(Window.partitionBy())  # over one row for each band
    bands = top.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.count(F.lit(1)) / total, 2).alias("pct"))
    whole = conc.agg(F.round(F.avg("hhi"), 1).alias("mean_hhi"), F.round(F.avg("pony_factor"), 4).alias("pony_rate"))
    return bands.crossJoin(whole)  # one row


def repo_order(edges: DataFrame, passing: DataFrame) -> DataFrame:
    """Repos of a bipartite graph with their number of contributors, passing ones first, then those with more."""
    r = edges.groupBy("repo").agg(F.count(F.lit(1)).alias("n_contributors")).join(apart(passing.select("repo", F.lit(True).alias("passed"))), "repo", "left").withColumn("passed", F.coalesce("passed", F.lit(False)))
    return _placed(r, F.col("passed").desc(), F.col("n_contributors").desc(), F.col("repo"))


def contributor_order(edges: DataFrame) -> DataFrame:
    """Contributors with their repos and commits, those of several repos first, then those with more commits."""
    c = edges.groupBy("contributor").agg(F.count_distinct("repo").alias("n_repos"), F.sum("commits").alias("commits"), F.bool_or("cross_repo").alias("cross_repo"))
    return _placed(c, F.col("cross_repo").desc(), F.col("commits").desc(), F.col("contributor"))


def _placed(df: DataFrame, *order) -> DataFrame:
    return place(df.withColumn("_all", F.lit(0)), "_all", list(order), "place").drop("_all")


def labelled(edges: DataFrame, passing: DataFrame, least_share: float = 20.0) -> DataFrame:
    """Contributors to name: those of several repos, and those with a share on a passing repo."""
    on_passing = edges.filter(F.col("share_pct") >= least_share).join(apart(passing), "repo", "left_semi")
    return edges.filter("cross_repo").select("contributor").union(on_passing.select("contributor")).distinct()


def bipartite(contributions: DataFrame, bots: Collection = (), least_share: float = 15.0) -> DataFrame:
    """Edges of people (not bots) with a share of at least least_share percent, or who work on more than one repo."""
    s = shares(contributions).filter(~F.col("contributor").isin(*bots)) if bots else shares(contributions)
    n = s.groupBy("contributor").agg(F.count_distinct("repo").alias("n_repos"))
    joined = s.join(apart(n), "contributor").withColumn("cross_repo", F.col("n_repos") > 1)
    return joined.filter((F.col("share") * 100 >= least_share) | F.col("cross_repo")).select("repo", "contributor", "commits", F.round(F.col("share") * 100, 4).alias("share_pct"), "cross_repo")


def run_summary(rows: DataFrame) -> DataFrame:
    """rows: repo, email, accessible -> processed, accessible, inaccessible, distinct emails."""
    per = rows.groupBy("repo").agg(F.max(F.col("accessible").cast("int")).alias("ok"))
    emails = rows.filter("accessible").agg(F.count_distinct("email").alias("contributors"))
    return per.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("ok") == 1).alias("accessible"), F.count_if(F.col("ok") == 0).alias("inaccessible")).crossJoin(emails)
