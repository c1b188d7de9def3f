"""Concentration, ranks, gate, surfaces, snapshots and text functions on small exact inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ecovista.functions import names, tiers
from ecovista.operators import adoption, concentration, fuzzy, graph, rank, snapshots, surfaces


def contributions(spark, rows):
    return spark.createDataFrame(rows, "repo string, contributor string, commits long")


def test_concentration(spark):
    rows = [("a", "alice", 80), ("a", "bob", 20), ("b", "x", 50), ("b", "y", 50), ("c", "solo", 1), ("z", "none", 0)] + [("d", f"p{i}", 20) for i in range(5)]
    got = {r["repo"]: r for r in concentration.concentration(contributions(spark, rows)).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert (got["a"]["pony_factor"], got["a"]["hhi"], got["a"]["hhi_tier"], got["a"]["top_contributor"], got["a"]["top_share"]) == (1, 6800, "critical", "alice", 0.8)
    assert (got["b"]["pony_factor"], got["b"]["hhi"]) == (1, 5000)
    assert (got["c"]["hhi"], got["c"]["entropy"]) == (10000, 0)
    assert (got["d"]["pony_factor"], got["d"]["hhi"], got["d"]["hhi_tier"], got["d"]["entropy"]) == (0, 2000, "moderate", round(math.log(5), 3))


def test_duplicate_contributions(spark):
    df = spark.createDataFrame([("a", "x", 3, 1), ("a", "x", 4, 2)], "repo string, contributor string, commits long, ord long")
    assert concentration.sum_contributions(df).first()["commits"] == 7
    assert concentration.sum_contributions(df, "last").first()["commits"] == 4


def test_percentiles(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 1, 9, 7])], "k long, v double")
    assert dict(rank.exclusive_percentile(df, "v", "p").select("k", "p").collect()) == pytest.approx({0: 40, 1: 0, 2: 0, 3: 80, 4: 60})
    assert dict(rank.average_percentile(df, "v", "p").select("k", "p").collect()) == pytest.approx({0: 60, 1: 30, 2: 30, 3: 100, 4: 80})
    assert rank.average_percentile(df.limit(1), "v", "p").first()["p"] == 100
    assert {r["p"] for r in rank.exclusive_percentile(df.withColumn("v", F.lit(1.0)), "v", "p").collect()} == {0.0}
    assert rank.gini(spark.createDataFrame([(0.0,), (0.0,), (9.0,)], "v double"), "v").first()[0] == pytest.approx(2 / 3)


def test_adoption(spark):
    n = spark.createDataFrame([(1, 500000, 1000, 200), (2, 50000, 100, 20), (3, 0, 0, 0), (4, None, None, None)], "node_id long, downloads long, stars long, forks long")
    got = {r["node_id"]: r["adoption_score"] for r in adoption.adoption_scores(n).collect()}
    assert got[1] == 100 and got[1] > got[2] > got[3] == got[4]


def test_gate(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 9999.0, "x", 0.99, 0.0), (2, 50, 60.0, 9999.0, "x", 0.99, 50.0), (3, 100, 90.0, 500.0, "y", 0.3, 80.0)], "node_id long, criticality long, criticality_pct double, hhi double, top_contributor string, top_share double, adoption_score double")
    g = surfaces.gate(rows)
    got = [(r["node_id"], r["votes"], r["passed"], r["borderline"]) for r in g.orderBy(*surfaces.gate_order()).collect()]
    assert got == [(1, 0, False, False), (2, 2, True, True), (3, 3, True, False)]
    s = surfaces.gate_summary(g).first()
    assert (s["total"], s["n_passed"], s["all_three_failed"], s["pass_rate"]) == (3, 2, 1, 0.6667)
    assert "x made 99 % of the commits" in g.filter("node_id = 2").first()["maintenance_text"]
    assert surfaces.gate_summary(g.limit(0)).first()["pass_rate"] == 0


def test_trends_and_tiers(spark):
    df = spark.createDataFrame([(d,) for d in (0, 13, 14, 44, 45, 88, 89, 200)], "d int").select(tiers.commit_trend(F.col("d")).alias("t"))
    assert [r[0] for r in df.collect()] == ["active"] * 2 + ["stable"] * 2 + ["stagnant"] * 2 + ["declining"] * 2
    fer = spark.createDataFrame([(None,), (2.5,), (2.0,), (1.0,), (0.5,), (0.1,)], "f double").select(tiers.fer_tier(F.col("f")))
    assert [r[0] for r in fer.collect()] == ["unfunded", "critically_underfunded", "underfunded", "balanced", "overfunded", "significantly_overfunded"]


def test_funding(spark):
    totals = spark.createDataFrame([("a", 3, 0), ("b", 0, 1), ("c", 5, 0), ("d", 2, 0)], "project string, criticality long, pony_risk_repos long")
    projects = spark.createDataFrame([("a", 0.0), ("b", 100.0), ("c", 200.0), ("d", 400.0), ("e", None)], "title string, total_awarded_usd double")
    got = {r["project"]: (r["fer"], r["tier"]) for r in surfaces.funding_efficiency(totals, projects).collect()}
    assert got["a"] == (None, "unfunded") and got["b"] == (None, "unfunded")  # the least funded one has percentile 0
    assert got["c"] == (round(80 / (100 / 3), 4), "critically_underfunded") and got["e"] == (None, "unfunded")


def test_snapshot_trend(spark):
    base = dict(pony_rate_delta=0.0, mean_hhi_delta=0.0, gate_pass_rate_delta=0.0, debt_size_delta=0, keystone_count_delta=0)
    cases = [base, base | {"pony_rate_delta": 0.01, "mean_hhi_delta": -50.0}, base | {"pony_rate_delta": 0.0101}, base | {"mean_hhi_delta": -50.1}, base | {"gate_pass_rate_delta": 0.02, "debt_size_delta": 1}]
    df = spark.createDataFrame([tuple(c.values()) for c in cases], "pony_rate_delta double, mean_hhi_delta double, gate_pass_rate_delta double, debt_size_delta long, keystone_count_delta long")
    assert [r["trend"] for r in snapshots.trend(df).collect()] == ["stable", "stable", "degrading", "improving", "stable"]


def test_names(spark):
    urls = ["https://github.com/a/b", "http://github.com/a/b/", "https://github.com/a/b.git", "https://other.com/a/b", "https://github.com/a", "https://github.com/a/b/c", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(names.github_path(F.col("u")))
    assert [r[0] for r in df.collect()] == ["a/b"] * 3 + [None] * 5


def test_fuzzy(spark):
    t = spark.createDataFrame([("Silver Harbor",), ("zzz",)], "title string")
    p = spark.createDataFrame([("silver harbors", 0), ("SILVER HARBOR", 1), ("other", 2)], "project string, ord long")
    got = [(r["title"], r["project"], r["ratio"]) for r in fuzzy.best_match(t, p).collect()]
    assert got == [("Silver Harbor", "SILVER HARBOR", 1.0)]


def _brute_match(titles, projects, cutoff):
    """Every title against every project in order; a later one must be better."""
    from difflib import SequenceMatcher

    out = {}
    for t in set(titles):
        best, found = 0.0, None
        for p in projects:
            r = SequenceMatcher(None, t.lower(), p.lower()).ratio()
            if r > best:
                best, found = r, p
        # An empty title has no better ratio than 0 with anything but an empty project.
        if found is not None and best >= cutoff:
            out[t] = (found, best)
    return out


@pytest.mark.parametrize("cutoff", [0.6, 0.7, 0.85, 0.95])
def test_fuzzy_against_all_pairs(spark, cutoff):
    r = random.Random(5)
    words = ["silver", "harbor", "node", "stellar", "wallet", "kit", "bridge", "sdk", "aaab", "abab", "x", "Ünit", "go"]
    projects = [" ".join(r.choice(words) for _ in range(r.randrange(1, 5))) for _ in range(60)] + ["", "a", "ab", "x" * 250, "long " * 60]
    projects = list(dict.fromkeys(projects))

    def typo(s, n):
        for _ in range(n):
            i = r.randrange(len(s) + 1)
            s = s[:i] + r.choice(["", "z", "q ", "E"]) + s[i + r.randrange(2) :]
        return s

    titles = [typo(r.choice(projects), r.randrange(6)) for _ in range(150)] + ["", "A", "zzz", "X" * 250, "long " * 60, "axbxcxdx", "abcd"]
    got = fuzzy.best_match(spark.createDataFrame([(t,) for t in [*titles, None, titles[0]]], "title string"), spark.createDataFrame([(p, i) for i, p in enumerate(projects)] + [(None, 99)], "project string, ord long"), cutoff)
    assert {x["title"]: (x["project"], x["ratio"]) for x in got.collect()} == _brute_match(titles, projects, cutoff)


def test_fuzzy_compares_linearly(spark):
    """Ten times the titles, each a letter off its project: about ten times the pairs that reach Python, not a hundred."""
    r = random.Random(7)
    pairs = []
    for n in (150, 1500):
        names = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(24)) for _ in range(n)]
        a = spark.createDataFrame([(t[:9] + "#" + t[10:], 24) for t in names], "a string, la int")
        b = spark.createDataFrame([(t, 24) for t in names], "b string, lb int")
        pairs.append(fuzzy.candidates(fuzzy.by_grams(a, b, 0.9, 3), 0.9).count())
    assert pairs[0] >= 150 and pairs[1] >= 1500 and pairs[1] <= 11 * pairs[0]


def test_fuzzy_of_empty_tables(spark):
    t, p = spark.createDataFrame([], "title string"), spark.createDataFrame([], "project string, ord long")
    some_t, some_p = spark.createDataFrame([("ab",)], "title string"), spark.createDataFrame([("ab", 1)], "project string, ord long")
    assert [fuzzy.best_match(x, y).count() for x, y in ((t, p), (some_t, p), (t, some_p), (some_t, some_p))] == [0, 0, 0, 1]


def test_quantiles_and_places(spark):
    values = [5, 1, 1, 9, 3, 3, 3, 7]
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(values)], "i long, v long, g long")
    for q in (0.0, 0.25, 0.5, 0.75, 1.0):
        want = df.agg(F.percentile("v", q)).first()[0]
        assert rank.quantile(df, "v", q, "x").first()["x"] == want
    assert rank.quantile(df.limit(0), "v", 0.5, "x").first()["x"] is None
    got = {r["i"]: r["place"] for r in rank.place(df, "g", [F.col("v").desc(), F.col("i")], "place").collect()}
    for g in (0, 1):
        order = sorted((i for i in range(len(values)) if i % 2 == g), key=lambda i: (-values[i], i))
        assert [got[i] for i in order] == list(range(1, len(order) + 1))
    top = rank.top(df, "v", "i", 3).first()["top"]
    assert [(r["i"], r["v"]) for r in top] == [(3, 9), (7, 7), (0, 5)]


def test_place_of_rows_without_a_group(spark):
    rows = [("a", 3), ("a", 1), (None, 5), (None, 2), (None, 2), ("b", 9)]
    df = spark.createDataFrame([(g, v, n) for n, (g, v) in enumerate(rows)], "g string, v int, n int")
    got = {(r["g"], r["v"], r["n"]): r["place"] for r in rank.place(df, "g", [F.col("v"), F.col("n")], "place").collect()}
    assert got == {("a", 1, 1): 1, ("a", 3, 0): 2, (None, 2, 3): 1, (None, 2, 4): 2, (None, 5, 2): 3, ("b", 9, 5): 1}


def test_leading_rows(spark):
    df = spark.createDataFrame([("c", 0.1 + 0.2), ("b", 0.3), ("a", None), ("d", 0.1)], "k string, v double")
    keys = lambda **how: [r["k"] for r in rank.leading(df, "v", "k", 3, **how).collect()]
    assert keys() == ["c", "b", "d"] and keys(digits=9) == ["b", "c", "d"] and keys(nulls_first=True) == ["a", "c", "b"]
    assert rank.leading(df.limit(0), "v", "k", 3).collect() == []


def test_series_over_rounds(spark):
    snaps = spark.createDataFrame([("2024-04-01", 0.5, None), ("2024-01-01", 0.4, 1800.0)], "snapshot_date string, gate_pass_rate double, mean_hhi double")
    assert [tuple(r) for r in snapshots.trend_series(snaps).collect()] == [("2024-01-01", 0.4, 1800.0), ("2024-04-01", 0.5, None)]


def test_dormant_with_funding(spark):
    nodes = spark.createDataFrame([("a", "P", False), ("b", "P", True), ("c", None, False), ("d", "none", False)], "node_id string, project string, retained boolean")
    projects = spark.createDataFrame([("P", 5.0)], "title string, total_awarded_usd double")
    got = {tuple(r) for r in graph.dormant_with_funding(nodes, projects).collect()}
    assert got == {("a", "P", 5.0), ("c", None, None), ("d", "none", None)}


def test_halves_in_the_sql_of_funding_narratives(spark):
    duckdb = pytest.importorskip("duckdb")
    from ecovista.functions import narratives
    from ecovista.plans import oracle, queries

    rows = [("a", "significantly_overfunded", 10.0, 69.0, 0.145), ("b", "balanced", 60.0, 59.7, 1.005), ("c", "overfunded", 40.0, 80.0, 0.575), ("d", "unfunded", 0.5, 0.0, None)]
    df = spark.createDataFrame(rows, "project string, tier string, crit_pct double, fund_pct double, fer double")
    got = dict(df.select("project", narratives.funding(*[F.col(c) for c in ("tier", "crit_pct", "fund_pct", "fer")])).collect())
    fer = ", ".join(f"('{p}', '{t}', {c}::DOUBLE, {f}::DOUBLE, {'NULL' if x is None else x}::DOUBLE)" for p, t, c, f, x in rows)
    sql = queries.ORACLE_SQL["n2_funding_narratives"].removeprefix(oracle.ECO)
    assert dict(duckdb.sql(f"WITH fer(project, tier, crit_pct, fund_pct, fer) AS (VALUES {fer}) {sql}").fetchall()) == got
    assert "ratio 0.15." in got["a"] and "ratio 1.01." in got["b"]


def test_halves_in_comparison_narratives(spark):
    duckdb = pytest.importorskip("duckdb")
    from ecovista.plans import queries

    # Differences of 20.55, 28.35 and 0.05 points and of 1711.5, 698.5 and 0.5, none of them exact in binary.
    rows = [("2024-01-01", 0.2166, 470.7), ("2024-04-01", 0.4221, 2182.2), ("2024-07-01", 0.7056, 1483.7), ("2024-10-01", 0.7061, 1484.2)]
    df = spark.createDataFrame([(d, None, g, h, g, 0) for d, g, h in rows], "snapshot_date string, label string, gate_pass_rate double, mean_hhi double, pony_rate double, debt_size long")
    got = dict(snapshots.deltas(df).select("later", "narrative").collect())
    assert got["2024-04-01"] == "2024-01-01 to 2024-04-01: gate passes up by 20.6 points, concentration up by 1712, flagged repositories up by 20.6 points."
    assert got["2024-07-01"] == "2024-04-01 to 2024-07-01: gate passes up by 28.4 points, concentration down by 699, flagged repositories up by 28.4 points."
    assert got["2024-10-01"] == "2024-07-01 to 2024-10-01: gate passes up by 0.1 points, concentration up by 1, flagged repositories up by 0.1 points."
    absent = [m for m in snapshots.METRICS if m not in ("gate_pass_rate", "mean_hhi", "pony_rate", "debt_size")]
    values = ", ".join(f"('{d}', NULL::VARCHAR, {g}::DOUBLE, {h}::DOUBLE, {g}::DOUBLE, 0::BIGINT{', 0' * len(absent)})" for d, g, h in rows)
    rounds = f"WITH rounds(snapshot_date, label, gate_pass_rate, mean_hhi, pony_rate, debt_size, {', '.join(absent)}) AS (VALUES {values})"
    assert dict(duckdb.sql(f"{rounds}, {queries._DELTA} {queries._N4}").fetchall()) == got


def test_titles_a_letter_apart_need_no_index_of_grams(spark, monkeypatch):
    from difflib import SequenceMatcher

    rng = random.Random(5)
    projects = list(dict.fromkeys("".join(rng.choices("abc ", k=rng.randrange(1, 9))) for _ in range(120))) + ["x" * 199, "x" * 60 + "y" + "x" * 60]
    titles = [p[:i] + p[i + 1 :] for p in projects for i in (0, len(p) // 2)] + [p + "b" for p in projects] + ["", "zzzz"]
    p = spark.createDataFrame(list(zip(projects, range(len(projects)))), "project string, ord long")
    found = {r["title"]: (r["project"], r["ratio"]) for r in fuzzy.best_match(spark.createDataFrame([(t,) for t in titles], "title string"), p).collect()}
    for t in set(titles):
        ratio, place = max((SequenceMatcher(None, t.lower(), x.lower()).ratio(), -k) for k, x in enumerate(projects))
        assert found.get(t) == ((projects[-place], ratio) if ratio >= 0.6 else None), t
    long = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota kappa"]
    q = spark.createDataFrame(list(zip(long, range(3))), "project string, ord long")
    monkeypatch.setattr(fuzzy, "by_grams", lambda *_: pytest.fail("asked the index"))
    got = fuzzy.best_match(spark.createDataFrame([("alpha bta gamma",), ("delta epsilon zetaa",), ("eta theta iota kappa",)], "title string"), q)
    assert {r["title"]: r["project"] for r in got.collect()} == {"alpha bta gamma": long[0], "delta epsilon zetaa": long[1], "eta theta iota kappa": long[2]}


def test_enriched_nodes_are_built_once(spark):
    from ecovista.operators import build

    make = lambda kind, *rows: spark.createDataFrame(list(rows), kind)
    g = build.Graph(build._node(make("id string, funding double", ("r", 1.0), ("q", 1.0)), "Repo", "id", None, "funding"), make("src string, dst string, edge_type string"))
    deps = make("from_repo string, to_package string, ecosystem string, ord long", ("r", "p", "B", 2), ("q", "p", "A", 1))
    people = make("contributor string, repo string, commits long, ord long", ("c", "r", 1, 1), ("c", "lost", 2, 2))
    more = make("node_id string, downloads long, stars long, forks long", ("r", 1, 2, 3)), make("repo string, days_since_commit long, archived boolean", ("r", 3, False))
    nodes = build.enrich_graph(g, deps, people, *more).nodes
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert {(r["node_id"], r["node_type"], r["ecosystem"]) for r in nodes.collect()} == {("r", "Repo", None), ("q", "Repo", None), ("p", "ExternalRepo", "A"), ("c", "Contributor", None), ("lost", "", None)}
    assert plan.count("Join") <= 3 and "Broadcast" not in plan  # before, all steps were in one stage, with the nodes eight times


def test_labels_are_joined_apart(spark):
    from ecovista.functions.lineage import cut

    c = cut(contributions(spark, [("a", "x", 80), ("a", "y", 20), ("b", "x", 5), ("c", "z", 1)]))
    passing = spark.createDataFrame([("a",)], "repo string")
    got = concentration.labelled(concentration.bipartite(c.hint("merge")), passing)
    assert {r[0] for r in got.collect()} == {"x", "y"}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_scores_are_computed_once_for_ranks_and_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    nodes = spark.createDataFrame([(i, i % 3) for i in range(9)], "node_id long, stars long").withColumns({"stars": counted("stars"), "forks": F.lit(1), "downloads": F.lit(1)})
    assert adoption.adoption_scores(nodes).count() == 9 and seen.value == 9  # 18 before
    totals, projects = spark.createDataFrame([("a", 3, 1), ("b", 1, 0)], "project string, criticality long, pony_risk_repos long"), spark.createDataFrame([("a", 2.0), ("b", 1.0)], "title string, total_awarded_usd double")
    seen.value = 0
    surfaces.funding_efficiency(totals.withColumn("criticality", counted("criticality")), projects).collect()
    assert seen.value == 2


def test_ages_need_no_pairs_of_contributors(spark):
    from ecovista.plans.mapping import Model

    m = Model(spark, "/root/testdata/sf0.001")
    read = m.ages._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
    assert read.startswith("struct<l_partkey:bigint,l_shipdate:timestamp")  # before, commits were grouped by contributor, for ages too
    assert m.contributions.count() == m.commits.filter(F.col("committed_at") >= F.date_sub(m.as_of, 365)).select("repo", "contributor").distinct().count()
