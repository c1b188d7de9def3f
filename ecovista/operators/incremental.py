"""Incremental maintenance of the projection, the closure and criticality: the work follows the change, not the graph.

The closure's pairs are kept by both of their ends, in buckets of that end, and a change is appended as a further
table of rows that came or went; what a refresh looks up is read from the buckets of the nodes it asks for.

An edge that goes takes with it, at first, every pair with a walk over it (dependents of its source, packages its target
depends on); those that still have a walk are derived again from the pairs left (delete and rederive).  Edges that come are
linked into walks over several of them by the closure of a small graph of their ends, and only then extended by old pairs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.lineage import apart, cut, cut_counted, shared_dir
from . import graph, reach

#: Parts that a closure is kept in, by either end.
BUCKETS = 64
#: Tables of changes after which a closure is written anew as one.
COMPACT = 8


def _bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


@dataclass
class Closure:
    """Pairs (pkg, dependent) in a folder, as tables of changes (live: came, not live: went); the last table wins."""

    spark: SparkSession
    folder: str
    tables: tuple[str, ...]

    @classmethod
    def of(cls, pairs: DataFrame, folder: str | None = None) -> Closure:
        return cls(pairs.sparkSession, folder or f"{shared_dir(pairs.sparkSession)}/closure-{uuid.uuid4().hex}", ()).changed(pairs, None)

    def changed(self, came: DataFrame | None, went: DataFrame | None) -> Closure:
        """The closure after a change; this one stays what it is."""
        rows = [df.select("pkg", "dependent", F.lit(live).alias("live")) for df, live in ((came, True), (went, False)) if df is not None]
        name = uuid.uuid4().hex
        rows = reduce(DataFrame.unionAll, rows)
        for end in ("pkg", "dependent"):
            rows.withColumn("bucket", _bucket(end)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{end}/{name}")
        after = replace(self, tables=(*self.tables, name))
        return after if len(after.tables) <= COMPACT else Closure.of(after.pairs())

    def _rows(self, end: str, buckets: list[int] | None) -> list[DataFrame]:
        some = [self.spark.read.parquet(f"{self.folder}/{end}/{t}") for t in self.tables]
        return [df if buckets is None else df.filter(F.col("bucket").isin(buckets)) for df in some]

    @staticmethod
    def _latest(tables: list[DataFrame]) -> DataFrame:
        if len(tables) == 1:
            return tables[0].filter("live").select("pkg", "dependent")
        rows = reduce(DataFrame.unionAll, [df.select("pkg", "dependent", "live", F.lit(i).alias("at")) for i, df in enumerate(tables)])
        return rows.groupBy("pkg", "dependent").agg(F.max_by("live", "at").alias("live")).filter("live").select("pkg", "dependent")

    def pairs(self) -> DataFrame:
        return self._latest(self._rows("pkg", None))

    def pairs_of(self, ids: DataFrame, end: str) -> DataFrame:
        """The pairs that have one of ids (one column, distinct) at this end, read from those ids' buckets only."""
        ids = ids.toDF(end)
        buckets = [r[0] for r in ids.select(_bucket(end)).distinct().collect()]  # BUCKETS numbers at most
        return self._latest([df.join(ids.hint("shuffle_hash"), end, "left_semi") for df in self._rows(end, buckets)])


@dataclass
class Views:
    """nodes: node_id, node_type, days_since_commit, archived, active, retained, ...; all_edges, edges (the projected ones):
    src, dst; criticality: node_id, criticality."""

    nodes: DataFrame
    all_edges: DataFrame
    edges: DataFrame
    closure: Closure
    criticality: DataFrame


def views_of(nodes: DataFrame, all_edges: DataFrame, config: Config = DEFAULT) -> Views:
    """All views computed from scratch."""
    nodes = cut(graph.project_active(nodes, config))
    packages = _packages(nodes)
    edges = cut(graph.induced(all_edges.filter("src <> dst").distinct(), packages).select("src", "dst"))
    pairs = reach.transitive_dependents(edges)
    return Views(nodes, all_edges, edges, Closure.of(pairs), cut(reach.criticality(packages, pairs)))


def _packages(nodes: DataFrame) -> DataFrame:
    return graph.dependency_nodes(nodes.filter("retained"))


def _pairs_gone(v: Views, removed: DataFrame) -> DataFrame:
    """Pairs that no walk joins any more once the removed edges (src, dst) are gone."""
    sources, targets = removed.select("src").distinct(), removed.select("dst").distinct()
    below = _with_self(v.closure.pairs_of(sources, "pkg"), sources)
    above = _with_self(v.closure.pairs_of(targets, "dependent"), targets)
    over = cut(_between(removed, below, above))
    kept = cut(v.closure.pairs_of(over.select("pkg").distinct(), "pkg").join(over, ["pkg", "dependent"], "left_anti"))
    left = cut(v.edges.join(removed, ["src", "dst"], "left_anti").join(apart(over.select(F.col("dependent").alias("src")).distinct()), "src", "left_semi"))
    step = over.join(apart(left), over["dependent"] == left["src"]).select("pkg", "dependent", F.col("dst").alias("by"))
    held = kept.withColumnRenamed("dependent", "by")
    direct = step.filter("pkg = by").select("pkg", "dependent").union(step.join(apart(held), ["pkg", "by"], "left_semi").select("pkg", "dependent"))
    fresh, grown = cut_counted(direct.distinct())
    found = fresh
    while grown:  # from pairs that are derived again to those one edge further
        further = fresh.join(left, fresh["dependent"] == left["dst"]).select("pkg", F.col("src").alias("dependent")).distinct()
        fresh, grown = cut_counted(further.join(apart(over), ["pkg", "dependent"], "left_semi").join(apart(found), ["pkg", "dependent"], "left_anti"))
        found = found.unionAll(fresh)
    return cut(over.join(apart(found), ["pkg", "dependent"], "left_anti"))


def _pairs_new(closure: Closure, added: DataFrame) -> DataFrame:
    """Pairs that the added edges (src, dst) make and that closure doesn't have."""
    sources, targets = added.select("src").distinct(), added.select("dst").distinct()
    below = cut(_with_self(closure.pairs_of(sources, "pkg"), sources))
    above = _with_self(closure.pairs_of(targets, "dependent"), targets)
    # Added edges follow one another where the target of one is, or reaches, the source of the next.
    follows = below.join(targets.toDF("dependent"), "dependent", "left_semi").filter("pkg <> dependent").select(F.col("dependent").alias("src"), F.col("pkg").alias("dst"))
    walks = reach.transitive_dependents(added.select("src", "dst").union(follows))
    walks = walks.select(F.col("dependent").alias("src"), F.col("pkg").alias("dst")).join(sources, "src", "left_semi").join(targets, "dst", "left_semi").select("src", "dst")
    made = cut(_between(walks, below, above))
    return cut(made.join(closure.pairs_of(made.select("pkg").distinct(), "pkg"), ["pkg", "dependent"], "left_anti"))


def _with_self(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = ids.toDF("pkg")
    return pairs.select("pkg", "dependent").union(ids.select("pkg", F.col("pkg").alias("dependent")))


def _between(hops: DataFrame, below: DataFrame, above: DataFrame) -> DataFrame:
    """(pkg, dependent): what is below a hop's src with what is above its dst; met at the dst first, so that hops which
    share it make a dependent once."""
    reached = hops.join(below.withColumnRenamed("pkg", "src"), "src").select("dst", "dependent").distinct()
    top = above.select("pkg", F.col("dependent").alias("dst"))
    return reached.join(top, "dst").filter("pkg <> dependent").select("pkg", "dependent").distinct()


def refresh(v: Views, node_changes: DataFrame, edge_changes: DataFrame, config: Config = DEFAULT) -> Views:
    """The views after a change.  node_changes: a row with all columns of nodes but retained, and deleted, for each node that is
    new, changed or gone; edge_changes: src, dst, deleted.  One row for each node and edge."""
    changed = cut(graph.project_active(node_changes, config))
    ids = changed.select("node_id")
    before = v.nodes.join(ids, "node_id", "left_semi")
    columns = v.nodes.columns
    nodes = cut(v.nodes.join(ids, "node_id", "left_anti").unionByName(changed.filter("NOT deleted").select(*columns)))
    flag = lambda df, name: df.select("node_id", F.lit(True).alias(name), F.coalesce("active", F.lit(False)).alias(f"{name}_active"))
    was, now = flag(_packages(before), "was"), flag(_packages(changed.filter("NOT deleted")), "is")
    moved = cut(ids.join(apart(was), "node_id", "left").join(apart(now), "node_id", "left").na.fill(False))
    left, came = moved.filter("was AND NOT is").select("node_id"), moved.filter("is AND NOT was").select("node_id")

    gone, new = edge_changes.filter("deleted").select("src", "dst"), edge_changes.filter("NOT deleted AND src <> dst").select("src", "dst")
    all_edges = cut(v.all_edges.join(gone, ["src", "dst"], "left_anti").unionByName(new).distinct())
    at = lambda df, ends: df.join(ends.toDF("src"), "src", "left_semi").select("src", "dst").union(df.join(ends.toDF("dst"), "dst", "left_semi").select("src", "dst"))
    removed = cut(at(v.edges, left).union(v.edges.join(gone, ["src", "dst"], "left_semi").select("src", "dst")).distinct())
    asked = at(all_edges, came).union(new).distinct()
    added = cut(graph.induced(asked, _packages(nodes)).select("src", "dst").filter("src <> dst").join(v.edges, ["src", "dst"], "left_anti"))
    edges = cut(v.edges.join(removed, ["src", "dst"], "left_anti").unionByName(added))

    went = _pairs_gone(v, removed)
    closure = v.closure.changed(None, went)
    flipped = moved.filter("was AND is AND was_active <> is_active").select(F.col("node_id").alias("dependent"), F.when(F.col("is_active"), 1).otherwise(-1).alias("n"))
    stay = closure.pairs_of(flipped.select("dependent"), "dependent").join(flipped, "dependent").select("pkg", "n")
    more = _pairs_new(closure, added)
    closure = closure.changed(more, None)

    active = lambda nodes: nodes.filter(F.coalesce("active", F.lit(False))).select(F.col("node_id").alias("dependent"))
    lost = went.join(active(v.nodes), "dependent", "left_semi").select("pkg", F.lit(-1).alias("n"))
    gained = more.join(active(nodes), "dependent", "left_semi").select("pkg", F.lit(1).alias("n"))
    change = lost.union(gained).union(stay).groupBy(F.col("pkg").alias("node_id")).agg(F.sum("n").alias("n"))
    kept = v.criticality.join(left, "node_id", "left_anti").unionByName(came.withColumn("criticality", F.lit(0).cast("long")))
    criticality = kept.join(apart(change), "node_id", "left").select("node_id", (F.col("criticality") + F.coalesce("n", F.lit(0))).alias("criticality"))
    return Views(nodes, all_edges, edges, closure, cut(criticality))
