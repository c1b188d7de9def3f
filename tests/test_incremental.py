"""Refreshed views against views computed anew."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ecovista.operators import incremental

NODES = "node_id long, node_type string, days_since_commit int, archived boolean, active boolean"


def nodes(spark, table):
    return spark.createDataFrame([(i, "Repo", d, a, d is not None and d <= 90 and not a) for i, (d, a) in table.items()], NODES)


def edges(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src long, dst long")


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed", [1])
def test_refresh_is_a_full_recompute(spark, seed):
    r = random.Random(seed)
    fresh = lambda: (r.choice([5, 40, 200]), r.random() < 0.1)
    table = {i: fresh() for i in range(40)}
    pairs = {(r.randrange(40), r.randrange(40)) for _ in range(55)}
    pairs = {(a, b) for a, b in pairs if a != b}
    v = incremental.views_of(nodes(spark, table), edges(spark, pairs))
    for _ in range(1):  # more of them take a minute each
        touched = {i: fresh() for i in r.sample(range(44), 8)}
        dead = set(r.sample(sorted(table), 2)) - touched.keys()
        gone = set(r.sample(sorted(pairs), 6))
        new = {(a, b) for a, b in ((r.randrange(44), r.randrange(44)) for _ in range(8)) if a != b} - pairs
        changes = nodes(spark, touched).withColumn("deleted", F.lit(False)).unionByName(nodes(spark, {i: (1, False) for i in dead}).withColumn("deleted", F.lit(True)))
        edge_changes = edges(spark, gone).withColumn("deleted", F.lit(True)).unionByName(edges(spark, new).withColumn("deleted", F.lit(False)))
        v = incremental.refresh(v, changes, edge_changes)
        table = {i: x for i, x in (table | touched).items() if i not in dead}
        pairs = (pairs - gone) | new
    whole = incremental.views_of(nodes(spark, table), edges(spark, pairs))
    assert rows(v.nodes.select("node_id", "active", "retained")) == rows(whole.nodes.select("node_id", "active", "retained"))
    assert rows(v.edges.select("src", "dst")) == rows(whole.edges.select("src", "dst"))
    assert rows(v.closure.pairs()) == rows(whole.closure.pairs())
    assert rows(v.criticality.select("node_id", "criticality")) == rows(whole.criticality.select("node_id", "criticality"))


def test_refresh_reads_buckets_of_the_change_only(spark):
    """A closure of many pairs, and a change at the end of one chain: few files of it are read."""
    chains = {(100 * c + i, 100 * c + i + 1) for c in range(30) for i in range(6)}
    v = incremental.views_of(nodes(spark, {i: (1, False) for e in chains for i in e}), edges(spark, chains))
    ids = spark.createDataFrame([(2905,), (2906,)], "node_id long")
    for end in ("pkg", "dependent"):
        some = v.closure.pairs_of(ids, end)
        assert {r[end] for r in some.collect()} <= {2905, 2906}
    changes = spark.createDataFrame([(2905, 2906, True), (2906, 106, False)], "src long, dst long, deleted boolean")
    after = incremental.refresh(v, nodes(spark, {}).withColumn("deleted", F.lit(False)), changes)
    criticality = dict(after.criticality.collect())
    assert criticality[2906] == 0 and criticality[106] == 7
    assert rows(v.closure.pairs()) - rows(after.closure.pairs()) == {(2906, i) for i in range(2900, 2906)}  # the views before stay as they are


def test_compacted_closure_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT", 1)
    v = incremental.views_of(nodes(spark, {i: (1, False) for i in range(5)}), edges(spark, {(0, 1), (1, 2)}))
    none = nodes(spark, {}).withColumn("deleted", F.lit(False))
    after = incremental.refresh(v, none, spark.createDataFrame([(2, 0, False), (1, 2, True)], "src long, dst long, deleted boolean"))
    assert rows(after.closure.pairs()) == {(1, 0), (0, 2), (1, 2)} and len(after.closure.tables) == 1
