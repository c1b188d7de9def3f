"""The metric run: every table that follows from nodes, dependency edges, contributions and projects."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.lineage import apart, cut
from ..operators import adoption, cohesion, concentration, graph, rank, reach, snapshots, surfaces


class Ecosystem:
    """Results over a caller's tables, computed when asked for and shared by the metrics that need them.

    nodes: node_id, node_type, project, days_since_commit, archived, active (downloads, stars, forks unless signals
    has them); edges: src (dependent), dst; contributions: repo, contributor, commits; projects: title,
    total_awarded_usd; signals: node_id, downloads, stars, forks.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, contributions: DataFrame, projects: DataFrame, signals: DataFrame | None = None, config: Config = DEFAULT):
        self.config, self.all_edges, self.contributions, self.projects, self.signals = config, edges, contributions, projects, signals
        self.nodes = cut(graph.project_active(nodes, config))

    @cached_property
    def active_nodes(self) -> DataFrame:
        return self.nodes.filter("retained")

    @cached_property
    def packages(self) -> DataFrame:
        """Retained nodes that dependencies run between."""
        return graph.dependency_nodes(self.active_nodes)

    @cached_property
    def edges(self) -> DataFrame:
        return cut(graph.induced(self.all_edges, self.packages).select("src", "dst"))

    @cached_property
    def closure(self) -> DataFrame:
        return reach.transitive_dependents(self.edges)

    @cached_property
    def criticality(self) -> DataFrame:
        return cut(surfaces.scored(cut(reach.criticality(self.packages, self.closure))))  # the score is read for the ranks and for the rows

    @cached_property
    def decay(self) -> DataFrame:
        return reach.decay_criticality(self.packages, self.closure, self.config)

    @cached_property
    def active_contributions(self) -> DataFrame:
        """Of retained repositories of the own kind."""
        repos = self.active_nodes.filter("node_type = 'Repo'").select(F.col("node_id").alias("repo"))
        return cut(self.contributions.join(apart(repos), "repo", "left_semi"))

    @cached_property
    def concentration(self) -> DataFrame:
        return cut(concentration.concentration(self.active_contributions, self.config))

    @cached_property
    def adoption(self) -> DataFrame:
        nodes = self.packages if self.signals is None else graph.enrich_adoption(self.packages.select("node_id"), self.signals)
        return cut(adoption.adoption_scores(nodes))

    @cached_property
    def gate_rows(self) -> DataFrame:
        return surfaces.gate_input(self.criticality, self.concentration, self.adoption)

    @cached_property
    def gate(self) -> DataFrame:
        return surfaces.gate(self.gate_rows, self.config)

    @cached_property
    def debt(self) -> DataFrame:
        return surfaces.maintenance_debt(self.active_nodes, self.criticality, self.concentration, self.config)

    @cached_property
    def keystones(self) -> DataFrame:
        return cut(surfaces.keystones(self.concentration, self.criticality, self.active_nodes, self.closure))

    @cached_property
    def project_totals(self) -> DataFrame:
        return cut(surfaces.project_totals(self.active_nodes, self.criticality, self.concentration))

    @cached_property
    def fer(self) -> DataFrame:
        return surfaces.funding_efficiency(self.project_totals, self.projects, self.config)

    @cached_property
    def cores(self) -> DataFrame:
        return cut(cohesion.core_numbers(self.packages, self.edges))

    @cached_property
    def bridges(self) -> DataFrame:
        return cut(cohesion.bridges(self.edges))

    @cached_property
    def snapshot(self) -> DataFrame:
        return snapshots.snapshot(self.nodes, self.criticality, self.concentration, self.gate, self.debt, self.keystones, self.fer, self.edges, self.cores, self.bridges)

    def results(self) -> dict[str, Callable[[], DataFrame]]:
        """All tables of a full run by name, as functions: a table, and what it rests on, is computed when it is called for."""
        return {
            "projection_audit": lambda: graph.projection_audit(self.nodes, self.all_edges, self.config), "dormant": lambda: self.nodes.filter("NOT retained"), "criticality": lambda: self.criticality, "decay": lambda: self.decay,
            "concentration": lambda: self.concentration, "adoption": lambda: self.adoption, "cores": lambda: self.cores, "bridges": lambda: self.bridges, "gate": lambda: self.gate, "gate_summary": lambda: surfaces.gate_summary(self.gate, self.config),
            "debt": lambda: self.debt, "debt_summary": lambda: surfaces.debt_summary(self.debt), "keystones": lambda: self.keystones, "keystone_summary": lambda: surfaces.keystone_summary(self.keystones),
            "fer": lambda: self.fer, "fer_summary": lambda: surfaces.fer_summary(self.fer), "snapshot": lambda: self.snapshot, "north_star": lambda: snapshots.north_star(self.fer, self.debt, self.gate),
        }
