"""CSV scans, sinks and the driver's contract."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ecovista.operators import build
from ecovista.operators.rank import last_per_key
from ecovista.plans import rounds, run
from ecovista.plans.ecosystem import Ecosystem
from ecovista.sources import landing, tables


def test_project_csv(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('title,category,integration_status,github_url,website,total_awarded_usd,open_source,description\n A ,x,,,,12.5,yes,"one, ""two"""\n,x,,,,1,,\nB,x,,,,n/a,,\n')
    got = [(r["title"], r["total_awarded_usd"], r["description"]) for r in tables.projects(tables.read_csv(spark, str(path), tables.PROJECTS)).collect()]
    assert got == [("A", 12.5, 'one, "two"'), ("B", 0.0, None)]


def test_guarded_sink(spark, tmp_path):
    df = spark.range(3)
    assert tables.write_guarded(df, str(tmp_path / "t"))
    assert not tables.write_guarded(df.limit(0), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_snapshots_are_kept_by_date_and_round(spark, tmp_path):
    """A rerun replaces its own round; other rounds and dates stay."""
    rows = lambda *x: spark.createDataFrame(list(x), "snapshot_date string, round_label string, n long").withColumn("snapshot_date", F.to_date("snapshot_date"))
    path = str(tmp_path / "s")
    tables.write_snapshot(rows(("2026-01-01", "Round 1", 5)), path)
    tables.write_snapshot(rows(("2026-01-01", "Round 1", 6)), path)
    tables.write_snapshot(rows(("2026-04-01", "Round 1", 7), ("2026-04-01", None, 8)), path)
    got = tables.read_snapshots(spark, path, "round_label string, n long, date string, round string").select("date", "n").collect()
    assert sorted(map(tuple, got)) == [("2026-01-01", 6), ("2026-04-01", 7), ("2026-04-01", 8)]


def test_contributor_pages(spark):
    rolled = spark.createDataFrame([("r", f"e{i}", "d", 1, ["a"]) for i in range(50)] + [("s", "x", "d", 2, [])], "repo string, email string, display string, commits long, aliases array<string>")
    got = tables.contributor_pages(rolled, 10).collect()
    assert len([r for r in got if r["repo"] == "r"]) > 1
    assert sorted(c["email"] for r in got if r["repo"] == "r" for c in r["contributors"]) == sorted(f"e{i}" for i in range(50))


def test_url_list_keeps_the_order(spark):
    df = spark.createDataFrame([(0, " b "), (1, "nan"), (2, "a"), (3, "b"), (4, None)], "ord long, repo_url string")
    assert [r["url"] for r in tables.url_list(df).collect()] == ["b", "a"]


def test_run_from_csv(spark, tmp_path):
    """The shipped shapes of tables, through graph, enrichment and all metrics."""

    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    projects = put("p.csv", "title,category,integration_status,github_url,website,total_awarded_usd,open_source,description\nLumen Wallet,App,Live,,,1000,yes,\nBridge Kit,Tool,Live,,,5,yes,\n")
    repos = put("r.csv", "github_url,round,submission_title,total_awarded_usd,tranche_completion\nhttps://github.com/a/w,1,lumen walet,10,\nhttps://github.com/a/w,2,Bridge Kit,11,\nhttps://github.com/b/k,1,Bridge Kit,x,\nnan,1,none,,\nhttps://github.com/c/z,1,zzzz qqqq,1,\n")
    deps = put("d.csv", "from_repo,to_package,ecosystem,is_direct\nhttps://github.com/a/w,https://github.com/b/k,NPM,True\nhttps://github.com/b/k,core-lib,NPM,True\nhttps://github.com/c/z,https://github.com/b/k,NPM,True\n,x,NPM,True\n")
    people = put("c.csv", "repo_full_name,contributor_login,commits_90d,commit_share_pct\nb/k,ann,60,60\nb/k,bob,20,20\nb/k,ann,20,20\na/w,bob,4,100\nunknown/x,eve,1,100\n")
    adoption = put("a.csv", "repo_full_name,ecosystem,monthly_downloads,github_stars,github_forks\nb/k,NPM,100,7,1\n")
    activity = put("t.json", '{"https://github.com/a/w": {"days_since_commit": 10, "archived": false}, "https://github.com/b/k": {"days_since_commit": 50, "archived": false}, "https://github.com/c/z": {"days_since_commit": 400, "archived": false}}\n')
    e = run.run_from_csv(spark, projects, repos, deps, people, adoption, activity)
    nodes = {r["node_id"]: r for r in e.nodes.collect()}
    w, k = "https://github.com/a/w", "https://github.com/b/k"
    assert (nodes[w]["project"], nodes[k]["project"], nodes["https://github.com/c/z"]["project"]) == ("Lumen Wallet", "Bridge Kit", None)
    assert nodes["core-lib"]["node_type"] == "ExternalRepo" and nodes["ann"]["node_type"] == "Contributor" and nodes["https://github.com/unknown/x"]["node_type"] == ""
    assert not nodes["https://github.com/c/z"]["retained"] and nodes[k]["stars"] == 7
    got = e.results()
    assert {r["node_id"]: r["criticality"] for r in got["criticality"]().collect()} == {w: 0, k: 1, "core-lib": 2}
    assert {r["repo"]: (r["top_contributor"], r["hhi"]) for r in got["concentration"]().collect()} == {k: ("ann", 6800.0), w: ("bob", 10000.0)}
    assert {(r["a"], r["b"]) for r in got["bridges"]().collect()} == {(w, k), ("core-lib", k)} or len(got["bridges"]().collect()) == 2
    s = got["snapshot"]().first()
    assert (s["active_repos"], s["dependency_edges"], s["max_core"], s["bridge_edges"], s["project_nodes"]) == (2, 2, 1, 2, 2)
    assert [x["node_id"] for x in s["top_critical"]] == ["core-lib", k]
    for name, table in got.items():
        assert table().count() >= 0, name


def test_enrichment_of_nothing(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    g = build.build_graph(empty("title string, total_awarded_usd double, ord long"), empty("github_url string, submission_title string, total_awarded_usd double"))
    g = build.enrich_graph(g, empty("from_repo string, to_package string, ecosystem string, ord long"), empty("contributor string, repo string, commits long, ord long"), empty("node_id string, downloads long, stars long, forks long"), empty("repo string, days_since_commit long, archived boolean"))
    assert g.nodes.isEmpty() and g.edges.isEmpty()
    assert run.ecosystem_of(g).snapshot.first()["bridge_edges"] == 0


def test_every_twin_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("breaks", [False, True])
def test_csv_order_over_files(spark, tmp_path, breaks):
    """First and last rows of keys over three files read in small splits, or whole where a value has line breaks."""
    rows = [(f"https://github.com/o/r{i % 40}", f"round {i}", f"title {i}" + ("\nmore" if breaks and i == 150 else "")) for i in range(300)]
    for f in range(3):
        lines = ["github_url,round,submission_title,total_awarded_usd,tranche_completion", *[f'{u},{r},"{t}",{i},' for i, (u, r, t) in list(enumerate(rows))[100 * f : 100 * f + 100]]]
        (tmp_path / f"part-{f}.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        raw = tables.read_csv(spark, str(tmp_path), tables.REPOS)
        assert raw.rdd.getNumPartitions() == 3 if breaks else raw.rdd.getNumPartitions() > 6
        assert [r["submission_title"] for r in raw.orderBy("ord").collect()] == [t for _, _, t in rows]
        first = {r["github_url"]: r["total_awarded_usd"] for r in tables.repos(raw).collect()}
        assert first == {f"https://github.com/o/r{i}": float(i) for i in range(40)}
        last = last_per_key(raw, ["github_url"], "ord").collect()
        assert {(r["github_url"], r["round"]) for r in last} == {(rows[i][0], rows[i][1]) for i in range(260, 300)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_run_that_breaks_off_counts_for_nothing(spark, tmp_path):
    ledger = landing.Ledger(spark, f"file://{tmp_path}/ledger", "k")
    items = spark.range(10).select(F.col("id").alias("k"))
    fail = lambda df: df.withColumn("k", F.when(F.col("k") > 7, F.raise_error(F.lit("lost"))).otherwise(F.col("k")))
    assert ledger.runs() == [] and ledger.output("k long").count() == 0
    assert ledger.process("a", items.filter("k < 3"), lambda df: df)
    with pytest.raises(Exception, match="lost"):
        ledger.process("b", items, fail)
    assert ledger.runs() == ["a"] and ledger.pending(items).count() == 7
    ledger.attempt("c", items, lambda df: df)  # the output is written, and then the driver is lost
    assert ledger.output("k long").count() == 3
    assert ledger.process("d", items, lambda df: df) and not ledger.process("d", items, fail)
    assert sorted((r["k"], r["run"]) for r in ledger.output("k long").collect()) == [(i, "a" if i < 3 else "d") for i in range(10)]


def test_micro_batches_are_one_batch(spark, tmp_path):
    """Three files in batches of one, the last replacing a row and deleting another; a replayed batch changes nothing."""
    batches = [[("a", 1, "x"), ("b", 1, "y")], [("c", 1, "z"), ("a", 1, "x")], [("b", 2, "new"), ("c", 2, None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, landing.PAYLOADS).coalesce(1).write.json(f"{tmp_path}/files/{i}")
    source, many, one = f"file://{tmp_path}/files/*", f"file://{tmp_path}/many", f"file://{tmp_path}/one"
    assert landing.land(spark, source, many, files_a_batch=1) >= 3 and landing.land(spark, source, one) == 1
    assert landing.land(spark, source, many) == 0
    want = {("a", 1, "x"), ("b", 2, "new")}
    assert {tuple(r) for r in landing.landed(spark, many).collect()} == {tuple(r) for r in landing.landed(spark, one).collect()} == want


def test_rounds_are_compared_with_the_last_stored_one(spark, tmp_path):
    folder, null = f"file://{tmp_path}/rounds", None
    n = spark.createDataFrame([(i, "Repo", 1, False, True, "p") for i in range(6)], "node_id long, node_type string, days_since_commit int, archived boolean, active boolean, project string")
    c = spark.createDataFrame([(0, 9, 5), (1, 9, 5), (1, 8, 5)], "repo long, contributor long, commits long")
    p = spark.createDataFrame([("p", 10.0)], "title string, total_awarded_usd double")
    e = lambda pairs: Ecosystem(n.withColumns({x: F.lit(1).cast("long") for x in ("downloads", "stars", "forks")}), spark.createDataFrame(pairs, "src long, dst long"), c, p)
    first = rounds.close(e([(0, 1)]), rounds.Round(date(2026, 1, 1), "One"), folder)
    assert first["comparison"]().count() == 0
    second = rounds.close(e([(0, 1), (1, 2), (2, 3)]), rounds.Round(date(2026, 2, 1), null), folder)
    row = second["comparison"]().first()
    assert (row["earlier_label"], row["later_label"], row["dependency_edges_delta"], row["bridge_edges_delta"]) == ("One", "2026-02-01", 2, 2)
    assert second["rounds"]().count() == 2 and second["snapshot"]().first()["snapshot_date"] == date(2026, 2, 1)


def test_landed_payloads_are_parsed_once(spark):
    from ecovista.sources import ingest

    page = '[{"commit":{"author":{"name":"n","email":"N@x.org","date":"2024-05-01T00:00:00Z"}},"author":null}]'
    pages = spark.createDataFrame([("a", page), ("a", page), ("b", page)], "repo string, payload string")
    repos = spark.createDataFrame([("a", True, False), ("b", False, False)], "repo string, accessible boolean, archived boolean")
    day = spark.sql("SELECT DATE'2024-05-03' AS d").first()[0]
    from pyspark.sql import functions as F

    shared, activity = ingest.contributions(pages, repos, F.lit(day))
    for df in (shared, activity):
        assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [(r["repo"], r["email"], r["commits"]) for r in shared.collect()] == [("a", "n@x.org", 2)]
    assert {(r["repo"], r["days_since_commit"]) for r in activity.collect()} == {("a", 2), ("b", 9999)}
