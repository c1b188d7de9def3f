"""A full run on a user's own tables: scan, build, enrich, measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, Config
from ..operators.build import Graph, build_graph, enrich_graph
from ..sources import tables
from .ecosystem import Ecosystem


def ecosystem_of(g: Graph, config: Config = DEFAULT) -> Ecosystem:
    return Ecosystem(g.nodes, g.dependencies(), g.contributions, g.projects(), config=config)


def run(projects: DataFrame, repos: DataFrame, dependencies: DataFrame, contributions: DataFrame, adoption: DataFrame, activity: DataFrame, config: Config = DEFAULT) -> Ecosystem:
    """Canonical tables (as sources.tables scans them, or sources.ingest makes them) -> all results."""
    return ecosystem_of(enrich_graph(build_graph(projects, repos, config), dependencies, contributions, adoption, activity, config), config)


def run_from_csv(spark: SparkSession, projects: str, repos: str, dependencies: str, contributions: str, adoption: str, activity: str, config: Config = DEFAULT) -> Ecosystem:
    """Paths of the tables as CSV, and of the activity cache as JSON (one object by URL a line)."""
    scan = lambda path, schema: tables.read_csv(spark, path, schema)
    return run(
        tables.projects(scan(projects, tables.PROJECTS)), tables.repos(scan(repos, tables.REPOS)), tables.dependencies(scan(dependencies, tables.DEPENDENCIES)),
        tables.contributions(scan(contributions, tables.CONTRIBUTIONS)), tables.adoption(scan(adoption, tables.ADOPTION)), tables.activity(spark.read.text(activity)), config,
    )
