"""The property graph as tables: projection to what is active, completion, enrichment, degrees.

nodes: node_id, node_type, days_since_commit, archived, active, ... ; dependency edges: src (dependent), dst.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.lineage import apart
from .rank import last_per_key, quantile


def retained(config: Config = DEFAULT) -> Column:
    """Repositories stay if they are recent and not archived; of unknown age external ones stay, own ones don't; other nodes stay."""
    days, recent = F.col("days_since_commit"), (F.col("days_since_commit") <= config.active_window_days) & ~F.coalesce("archived", F.lit(False))
    return F.when(F.col("node_type").isin("Repo", "ExternalRepo"), F.when(days.isNull(), F.col("node_type") == "ExternalRepo").otherwise(recent)).otherwise(F.lit(True))


def project_active(nodes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return nodes.withColumn("retained", retained(config))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes."""
    ids = apart(nodes.select("node_id"))
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def projection_audit(nodes: DataFrame, edges: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row: window, nodes kept and removed, edges before and after, shares kept in percent."""
    marked = project_active(nodes, config)
    kept_edges = induced(edges, marked.filter("retained")).agg(F.count(F.lit(1)).alias("edges_retained"))
    n = marked.agg(F.count_if("retained").alias("nodes_retained"), F.count_if(~F.col("retained")).alias("nodes_removed"))
    all_edges = edges.agg(F.count(F.lit(1)).alias("edges_total"))
    return n.crossJoin(kept_edges).crossJoin(all_edges).select(  # one row each
        F.lit(config.active_window_days).cast("long").alias("active_window_days"), "nodes_retained", "nodes_removed", "edges_retained", "edges_total",
        F.round(100 * F.col("nodes_retained") / (F.col("nodes_retained") + F.col("nodes_removed")), 2).alias("nodes_retained_pct"),
        F.round(100 * F.col("edges_retained") / F.col("edges_total"), 2).alias("edges_retained_pct"),
    )


def dormant_with_funding(nodes: DataFrame, projects: DataFrame) -> DataFrame:
    """node_id, project, funding of nodes that the projection removes; funding (of projects: title, total_awarded_usd) is null where the project is unknown."""
    p = projects.select(F.col("title").alias("_title"), F.col("total_awarded_usd").alias("funding"))
    return nodes.filter("NOT retained").join(apart(p), F.col("project") == F.col("_title"), "left").select("node_id", "project", "funding")


def dependency_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("node_type").isin("Repo", "ExternalRepo"))


def complete_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, and an ExternalRepo for each end of an edge that is none yet; its ecosystem is that of its least edge."""
    ends = edges.select(F.col("src").alias("node_id"), "ecosystem", "ord").unionByName(edges.select(F.col("dst").alias("node_id"), "ecosystem", "ord"))
    new = ends.groupBy("node_id").agg(F.min_by("ecosystem", "ord").alias("ecosystem")).join(apart(nodes), "node_id", "left_anti")
    return nodes.unionByName(new.withColumn("node_type", F.lit("ExternalRepo")), allowMissingColumns=True)


def complete_contributors(nodes: DataFrame, contributions: DataFrame) -> DataFrame:
    new = contributions.select(F.col("contributor").alias("node_id")).distinct().join(apart(nodes), "node_id", "left_anti")
    return nodes.unionByName(new.withColumns({"node_type": F.lit("Contributor"), "active": F.lit(True)}), allowMissingColumns=True)


def enrich_adoption(nodes: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals of nodes that exist; a missing signal of a node with signals is 0."""
    names = ["downloads", "stars", "forks"]
    s = signals.select("node_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(f"_{c}") for c in names])
    joined = nodes.join(apart(s), "node_id", "left")
    for c in names:
        joined = joined.withColumn(c, F.coalesce(f"_{c}", c) if c in nodes.columns else F.col(f"_{c}")).drop(f"_{c}")
    return joined


def enrich_activity(nodes: DataFrame, activity: DataFrame, config: Config = DEFAULT) -> DataFrame:
    a = activity.select("node_id", F.col("days_since_commit").alias("_days"), F.coalesce("archived", F.lit(False)).alias("_archived"))
    j = nodes.join(a.hint("merge"), "node_id", "left")  # scanned activity comes from exploded maps, whose size is not known
    now = (F.col("_days") <= config.active_window_days) & ~F.col("_archived")
    return j.withColumns({"active": F.coalesce(now, "active"), "days_since_commit": F.coalesce("_days", "days_since_commit"), "archived": F.coalesce("_archived", "archived")}).drop("_days", "_archived")


def apply_delta(current: DataFrame, delta: DataFrame, keys: list[str], version: str, deleted: str) -> DataFrame:
    """The latest row of each key from both tables; keys whose latest row is a tombstone go."""
    both = current.unionByName(delta, allowMissingColumns=True)
    return last_per_key(both, keys, version).filter(~F.coalesce(deleted, F.lit(False)))


def not_processed(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(apart(done.select(key).distinct()), key, "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, in_degree, out_degree of every node."""
    i = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    o = edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    return nodes.select("node_id").join(apart(i), "node_id", "left").join(apart(o), "node_id", "left").na.fill(0)


def degree_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """side (in, out), degree, n_nodes."""
    d = degrees(nodes, edges).select(F.inline(F.array(F.struct(F.lit("in").alias("side"), F.col("in_degree").alias("degree")), F.struct(F.lit("out").alias("side"), F.col("out_degree").alias("degree")))))
    return d.groupBy("side", "degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def degree_summary(edges: DataFrame, crit: DataFrame) -> DataFrame:
    """One row: mean number of dependents of packages with any, and the upper quartile of criticality over 0."""
    mean = edges.groupBy("dst").count().agg(F.avg("count").alias("mean_in_degree"))
    return mean.crossJoin(quantile(crit.filter("criticality > 0"), "criticality", 0.75, "criticality_p75"))  # one row each


def hubs(edges: DataFrame, k: int) -> DataFrame:
    """The k targets with the most edges, with how many sources they have."""
    return edges.groupBy(F.col("dst").alias("target")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("n_sources")).orderBy(F.desc("n"), "target").limit(k)


def source_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_distinct("src").alias("n_sources"), F.count(F.lit(1)).alias("n_edges"))


def core_hub_edges(edges: DataFrame, core: DataFrame, src: Column, dst: Column, several: int = 3) -> DataFrame:
    """Edges to packages of core (dst), under display names and without loops; multi: the source has `several` of them or more."""
    e = edges.join(apart(core), "dst", "left_semi").select(src.alias("src"), dst.alias("dst")).filter("src <> dst")
    n = e.groupBy("src").agg((F.count(F.lit(1)) >= several).alias("multi"))
    return e.join(apart(n), "src")


def coverage(parts: dict[str, DataFrame]) -> DataFrame:
    """part, n: rows of each table."""
    return reduce(DataFrame.unionAll, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()])


def undirected(edges: DataFrame) -> DataFrame:
    """a < b, each pair once, without loops."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def touched(edges: DataFrame, *others: DataFrame) -> DataFrame:
    """Nodes of any edge, and those of other tables (hubs, critical ones)."""
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id")))
    return reduce(lambda a, b: a.union(b.select("node_id")), others, ends).distinct()


def type_counts(nodes: DataFrame, typed_edges: DataFrame) -> DataFrame:
    a = nodes.groupBy(F.col("node_type").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("node"))
    b = typed_edges.groupBy(F.col("edge_type").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("edge"))
    return a.unionByName(b)
