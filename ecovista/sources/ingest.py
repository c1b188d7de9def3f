"""Ingest normalisation: landed payloads as the canonical tables of contributions, activity, dependencies and adoption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.lineage import cut
from ..operators import adoption as signals
from ..operators import concentration
from . import payloads, tables


def live_else_cached(live: DataFrame, cached: DataFrame) -> DataFrame:
    """What was ingested, or the rows of an earlier run where nothing was; never both."""
    return cached if live.isEmpty() else live


def contributions(pages: DataFrame, repos: DataFrame, as_of: Column, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """pages: repo, payload (commit pages); repos: repo, accessible, archived -> contributions, activity.

    contributions: repo, contributor, email, commits, first_date, last_date, aliases, commit_share_pct of the window;
    activity: repo, latest_commit, days_since_commit (9999 without commits), accessible, archived.  Pages of
    repositories that can't be read make no contributions.
    """
    # Commits are exploded from payloads, so their size is not known: both joins are by sorted keys.
    # Payloads are parsed, and commits rolled up, once for all that is made from them.
    commits = cut(payloads.commits(pages))
    readable = repos.filter("accessible").select("repo").hint("merge")
    recent = concentration.in_window(commits, as_of, config.active_window_days).join(readable, "repo", "left_semi")
    rolled = cut(concentration.roll_up_commits(recent))
    shared = concentration.shares(rolled).select("repo", F.col("display").alias("contributor"), "email", "commits", "first_date", "last_date", "aliases", F.round(100 * F.col("share"), 2).alias("commit_share_pct"))
    seen = commits.join(readable, "repo", "left_semi")
    return shared, concentration.recency(repos.select("repo"), seen, as_of).join(repos.select("repo", "accessible", "archived").hint("merge"), "repo")


def accessible_edges(readings: DataFrame) -> DataFrame:
    """readings: repo, contributor, committed_at, accessible -> repo, contributor, commits of those that could be read."""
    return readings.filter("accessible").groupBy("repo", "contributor").agg(F.count(F.lit(1)).alias("commits"))


def accessible_activity(readings: DataFrame, as_of: Column) -> DataFrame:
    """All repos, with their age by the readings that succeeded (9999 for none)."""
    seen = F.max(F.when(F.col("accessible"), F.to_date("committed_at")))
    return readings.groupBy("repo").agg(F.bool_or("accessible").alias("accessible"), F.coalesce(F.datediff(as_of, seen), F.lit(9999)).cast("long").alias("days_since_commit"))


def dependencies(pages: DataFrame, urls: DataFrame | None = None, ecosystem: str = "CARGO") -> DataFrame:
    """pages: payload (dependency graphs) -> from_repo, to_package, ecosystem, is_direct, ord; names of `ecosystem` become URLs of urls (name, url)."""
    edges = payloads.dependency_edges(pages.select("payload")).select(F.col("from_name").alias("from_repo"), F.col("to_name").alias("to_package"), "ecosystem", "is_direct").filter("from_repo <> to_package").distinct()
    edges = edges if urls is None else translate_names(edges, urls, ecosystem)
    return edges.withColumn("ord", F.xxhash64("from_repo", "to_package"))


def package_names(edges: DataFrame) -> DataFrame:
    """Distinct names over both ends."""
    return edges.select(F.col("from_repo").alias("name")).union(edges.select(F.col("to_package").alias("name"))).distinct()


def translate_names(edges: DataFrame, urls: DataFrame, ecosystem: str = "CARGO") -> DataFrame:
    """Both ends of edges of one ecosystem as URLs; names without one, and edges of others, stay as they are."""
    known = urls.groupBy("name").agg(F.min("url").alias("url"))
    end = lambda c: known.select(F.col("name").alias(f"_{c}"), F.col("url").alias(f"_url_{c}")).hint("merge")
    own = F.col("ecosystem") == ecosystem
    j = edges.join(end("from_repo"), own & (F.col("from_repo") == F.col("_from_repo")), "left").join(end("to_package"), own & (F.col("to_package") == F.col("_to_package")), "left")
    return j.select(F.coalesce("_url_from_repo", "from_repo").alias("from_repo"), F.coalesce("_url_to_package", "to_package").alias("to_package"), *[c for c in edges.columns if c not in ("from_repo", "to_package")])


def adoption(downloads: DataFrame, projects: DataFrame) -> DataFrame:
    """downloads: node_id, payload; projects: payload of project data -> node_id, downloads, stars, forks."""
    d = downloads.select("node_id", payloads.downloads(F.col("payload")).alias("downloads"))
    p = payloads.project_enrichment(projects).select(F.concat(F.lit("https://"), "id").alias("node_id"), "stars", "forks")
    return signals.merge_signals(d, p)


def store(canonical: dict[str, DataFrame], folder: str) -> dict[str, bool]:
    """Write each table below folder, but never an empty one over what is there; says which were written."""
    return {name: tables.write_guarded(df, f"{folder}/{name}") for name, df in canonical.items()}
