"""Hand-made graphs with exact results, and random graphs against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from ecovista.operators import cohesion, graph, reach


def edges(spark, pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def nodes(spark, ids, active=(), days=None):
    return spark.createDataFrame([(i, "Repo", i in active, (days or {}).get(i), False) for i in ids], "node_id long, node_type string, active boolean, days_since_commit int, archived boolean")


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_hub_and_leaves(spark):
    e = edges(spark, [(1, 10), (2, 10), (3, 10), (10, 20)])
    n = nodes(spark, [1, 2, 3, 10, 20, 30], active=(1, 2, 3, 10, 20, 30), days={1: 10, 2: 20, 3: 30, 10: 1, 20: 5, 30: 5})
    c = reach.transitive_dependents(e)
    assert rows(reach.criticality(n, c), "node_id", "criticality") == {(1, 0), (2, 0), (3, 0), (10, 3), (20, 4), (30, 0)}
    decay = dict(reach.decay_criticality(n, c).collect())
    assert decay[30] == 0 and 0 < decay[10] < 3 and decay[10] < decay[20] < 4


def test_dormant_dependents_do_not_count(spark):
    c = reach.transitive_dependents(edges(spark, [(1, 3), (2, 3)]))
    assert (3, 0) in rows(reach.criticality(nodes(spark, [1, 2, 3], active=(3,)), c), "node_id", "criticality")


def test_cycles_leave_out_oneself(spark):
    assert rows(reach.transitive_dependents(edges(spark, [(1, 2), (2, 1), (5, 5)])), "pkg", "dependent") == {(1, 2), (2, 1)}


@pytest.mark.parametrize(
    ("pairs", "core"),
    [
        ([(1, 2), (2, 3), (3, 1), (4, 1), (5, 2)], {1: 2, 2: 2, 3: 2, 4: 1, 5: 1, 9: 0}),
        ([(1, 9), (2, 9), (3, 9)], {1: 1, 2: 1, 3: 1, 9: 1}),
        ([(a, b) for a in range(1, 5) for b in range(1, a)], {1: 3, 2: 3, 3: 3, 4: 3}),
    ],
)
def test_cores(spark, pairs, core):
    assert dict(cohesion.core_numbers(nodes(spark, core), edges(spark, pairs)).collect()) == core


@pytest.mark.parametrize(
    ("pairs", "expected"),
    [
        ([(1, 2), (2, 3), (3, 4)], {(1, 2), (2, 3), (3, 4)}),
        ([(1, 2), (2, 3), (3, 1)], set()),
        ([(1, 2), (2, 3), (3, 1), (1, 4)], {(1, 4)}),
        ([(a, b) for a in range(1, 5) for b in range(1, a)] + [(a + 10, b + 10) for a in range(1, 5) for b in range(1, a)] + [(4, 11)], {(4, 11)}),
    ],
)
def test_bridges(spark, pairs, expected):
    assert rows(cohesion.bridges(edges(spark, pairs)), "a", "b") == expected


def test_random_graph_against_brute_force(spark):
    random.seed(5)
    pairs = {(random.randrange(14), random.randrange(14)) for _ in range(17)}
    ids = range(14)
    step = {i: {d for s, d in pairs if s == i and d != i} for i in ids}

    def reached(i, skip=None):
        seen, todo = set(), [i]
        while todo:
            for j in step[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return seen - {i}

    want = {(d, s) for s in ids for d in reached(s)}
    assert rows(reach.transitive_dependents(edges(spark, pairs)), "pkg", "dependent") == want
    und = {(min(p), max(p)) for p in pairs if p[0] != p[1]}

    def connected(a, b, without):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for p in und - {without}:
                if x in p:
                    y = p[0] + p[1] - x
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
        return b in seen

    assert rows(cohesion.bridges(edges(spark, pairs)), "a", "b") == {p for p in und if not connected(*p, p)}


@pytest.mark.parametrize("hub", [100_000, 50])
def test_closure_makes_rows_near_its_result(spark, monkeypatch, hub):
    """A ring of 300 nodes, a hub between 100 and 100 others (salted in one case), and a dense cyclic part."""
    monkeypatch.setattr(reach, "HUB", hub)
    random.seed(3)
    ring = [(i, (i + 1) % 300) for i in range(300)]
    star = [(1000 + i, 2000) for i in range(100)] + [(2000, 3000 + i) for i in range(100)]
    dense = [(5000 + random.randrange(80), 5000 + random.randrange(80)) for _ in range(500)]
    made = []
    got = rows(reach.transitive_dependents(edges(spark, ring + star + dense), made), "pkg", "dependent")
    want = {(a, b) for a in range(300) for b in range(300) if a != b} | {(2000, 1000 + i) for i in range(100)} | {(3000 + i, d) for i in range(100) for d in (2000, *range(1000, 1100))}
    assert {p for p in got if p[0] < 5000} == want
    inner = {p for p in got if p[0] >= 5000}
    assert len(inner) > 70 * 70 and sum(made) < 8 * len(got)
    assert len(made) < 20


def test_bridges_of_a_long_path_and_rings(spark):
    """A path of 4,096 nodes, a ring of 300 with a tail, and two rings joined by a long chain."""
    path = [(i, i + 1) for i in range(4095)]
    ring = [(5000 + i, 5000 + (i + 1) % 300) for i in range(300)]
    tail = [(5000, 6000), (6000, 6001), (6001, 6002)]
    other = [(7000 + i, 7000 + (i + 1) % 50) for i in range(50)]
    chain = [(5010, 8000), *[(8000 + i, 8001 + i) for i in range(200)], (8200, 7000)]
    rounds = []
    got = rows(cohesion.bridges(edges(spark, path + ring + tail + other + chain), rounds), "a", "b")
    assert got == {(min(p), max(p)) for p in path + tail + chain}
    assert len(rounds) < 20


def test_dense_core_with_bridges(spark):
    """Cliques (nothing to prune or to fold) joined by single edges, and by two."""
    clique = lambda k: [(100 * k + a, 100 * k + b) for a in range(5) for b in range(a)]
    pairs = [p for k in range(6) for p in clique(k)] + [(0, 100), (101, 202), (203, 304), (300, 401), (303, 402), (404, 502)]
    assert rows(cohesion.bridges(edges(spark, pairs)), "a", "b") == {(0, 100), (101, 202), (203, 304), (404, 502)}


def test_core_numbers_tell_fewer_each_round(spark):
    """A clique with long arms: estimates fall along the arms only, and only those that fell are heard of."""
    pairs = [(a, b) for a in range(6) for b in range(a)] + [(a, 100 * (a + 1)) for a in range(6)] + [(100 * (a + 1) + i, 100 * (a + 1) + i + 1) for a in range(6) for i in range(8)]
    ids = sorted({x for p in pairs for x in p})
    sent = []
    got = dict(cohesion.core_numbers(nodes(spark, ids), edges(spark, pairs), sent).collect())
    assert got == {i: 5 if i < 6 else 1 for i in ids}
    assert sent == sorted(sent, reverse=True) and sent[-1] < sent[0] < 2 * len(pairs)


def test_projection(spark):
    data = [(1, "Repo", 10, False), (2, "Repo", 120, False), (3, "Repo", 5, True), (4, "Project", 200, False), (5, "Contributor", None, None), (6, "ExternalRepo", 30, False), (7, "ExternalRepo", 180, False), (8, "Repo", None, False), (9, "ExternalRepo", None, False)]
    n = spark.createDataFrame(data, "node_id long, node_type string, days_since_commit int, archived boolean")
    assert {r[0] for r in graph.project_active(n).filter("retained").select("node_id").collect()} == {1, 4, 5, 6, 9}


def test_empty(spark):
    e, n = edges(spark, []), nodes(spark, [])
    assert reach.transitive_dependents(e).count() == cohesion.bridges(e).count() == cohesion.core_numbers(n, e).count() == 0


def test_approximate_criticality_of_a_deep_chain(spark):
    """A chain whose growth is far under a thousandth of the sum of all estimates is still followed to its end."""
    wide, deep = range(1000, 11_000), range(12)
    e = edges(spark, [(i, 999) for i in wide] + list(zip(deep, deep[1:])))
    n = nodes(spark, [999, *deep, *wide], active={*deep, *wide})
    got = reach.approximate_criticality(n, e).filter("node_id < 999")
    assert rows(got, "node_id", "criticality") == {(i, i) for i in deep}


def test_joins_of_growing_tables_send_nothing_to_the_driver(spark):
    from ecovista.functions.lineage import cut
    from ecovista.operators import cohesion, graph, reach

    nodes = cut(spark.range(50).withColumnRenamed("id", "node_id").withColumn("active", F.lit(True)))
    edges = cut(spark.range(1, 50).selectExpr("id AS src", "id div 2 AS dst"))
    closure = reach.transitive_dependents(edges)
    star = cohesion._star(edges.selectExpr("src AS u", "dst AS v"), True)
    for df in (graph.induced(edges, nodes), graph.degrees(nodes, edges), reach.criticality(nodes, closure), reach.union_reach(nodes.selectExpr("node_id % 3 AS owner", "node_id"), closure), star):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert closure.count() == reach.criticality(nodes, closure).agg(F.sum("criticality")).first()[0]
