"""The property graph from scanned tables, and its enrichment with what was ingested."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.lineage import apart, cut
from . import concentration, fuzzy, graph
from .rank import last_per_key


@dataclass
class Graph:
    """nodes: node_id, node_type, project, ecosystem, active, days_since_commit, archived, downloads, stars, forks, funding;
    edges: src, dst, edge_type; contributions: repo, contributor, commits (empty before enrichment)."""

    nodes: DataFrame
    edges: DataFrame
    contributions: DataFrame | None = None

    def dependencies(self) -> DataFrame:
        return self.edges.filter("edge_type = 'depends_on'").select("src", "dst")

    def projects(self) -> DataFrame:
        return self.nodes.filter("node_type = 'Project'").select(F.col("node_id").alias("title"), F.col("funding").alias("total_awarded_usd"))


def _node(df: DataFrame, kind: str, node_id: str, project: str | None, funding: str) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    return df.select(
        F.col(node_id).alias("node_id"), F.lit(kind).alias("node_type"), (F.col(project) if project else null("string")).alias("project"), null("string").alias("ecosystem"), null("boolean").alias("active"),
        null("long").alias("days_since_commit"), null("boolean").alias("archived"), *[null("long").alias(c) for c in ("downloads", "stars", "forks")], F.col(funding).alias("funding"),
    )


def build_graph(projects: DataFrame, repos: DataFrame, config: Config = DEFAULT) -> Graph:
    """projects: title, total_awarded_usd, ord; repos: github_url, submission_title, total_awarded_usd (scans of sources.tables).

    A repository belongs to the project whose title is most like its submission's, if it is like enough; a key that is
    both is a repository; of rows with one title the last counts.
    """
    projects = last_per_key(projects, ["title"], "ord")
    named = repos.filter("trim(coalesce(submission_title, '')) NOT IN ('', 'nan')").select("github_url", F.trim("submission_title").alias("title"))
    best = fuzzy.best_match(named.select("title").distinct(), projects.select(F.col("title").alias("project"), "ord"), config.fuzzy_cutoff)
    home = named.join(best.select("title", "project").hint("merge"), "title").select(F.col("github_url").alias("src"), F.col("project").alias("dst"))
    own = repos.join(home.withColumnsRenamed({"src": "github_url", "dst": "project"}).hint("merge"), "github_url", "left")
    repo_nodes = _node(own, "Repo", "github_url", "project", "total_awarded_usd")
    project_nodes = _node(projects, "Project", "title", None, "total_awarded_usd").join(apart(repo_nodes.select("node_id")), "node_id", "left_anti")
    return Graph(project_nodes.unionByName(repo_nodes), home.withColumn("edge_type", F.lit("belongs_to")))


def enrich_graph(g: Graph, dependencies: DataFrame, contributions: DataFrame, adoption: DataFrame, activity: DataFrame, config: Config = DEFAULT, on_duplicate: str = "sum") -> Graph:
    """dependencies: from_repo, to_package, ecosystem, ord; contributions: contributor, repo, commits, ord; adoption: node_id,
    downloads, stars, forks; activity: repo, days_since_commit, archived.

    Ends of dependencies that are no nodes become ExternalRepo nodes, contributors Contributor nodes, and repositories
    that only contributions name nodes without a type; signals and activity of unknown repositories are left out.
    """
    deps = dependencies.filter("coalesce(from_repo, '') <> '' AND coalesce(to_package, '') <> ''").select(F.col("from_repo").alias("src"), F.col("to_package").alias("dst"), "ecosystem", "ord")
    people = contributions.filter("coalesce(contributor, '') <> '' AND coalesce(repo, '') <> ''")
    # Each step reads the nodes before it twice; uncut, they would be built eight times over within one stage.
    nodes = cut(graph.complete_endpoints(cut(g.nodes), deps))
    nodes = cut(graph.complete_contributors(nodes, people))
    only_named = people.select(F.col("repo").alias("node_id")).distinct().join(apart(nodes), "node_id", "left_anti")
    nodes = nodes.unionByName(only_named.withColumn("node_type", F.lit("")), allowMissingColumns=True)
    nodes = graph.enrich_activity(graph.enrich_adoption(nodes, adoption), activity.withColumnRenamed("repo", "node_id"), config)
    summed = concentration.sum_contributions(people, on_duplicate)
    more = deps.select("src", "dst").distinct().withColumn("edge_type", F.lit("depends_on")).unionByName(summed.select(F.col("contributor").alias("src"), F.col("repo").alias("dst"), F.lit("contributed_to").alias("edge_type")))
    return Graph(nodes, g.edges.unionByName(more), summed)
