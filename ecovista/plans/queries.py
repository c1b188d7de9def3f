"""All queries of the ecosystem operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, tiers
from ..functions.lineage import apart, cut, shared_dir
from ..operators import adoption, build, cohesion, concentration, fuzzy, graph, rank, reach, snapshots, surfaces
from ..sources import ingest, landing, payloads, tables
from . import rounds, run
from .mapping import Model
from .oracle import ECO, eco

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a Model under its name; sql is its twin."""

    def add(f: Callable[[Model], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Model.of(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


R = F.round

# --- projection and graph -------------------------------------------------------------------------------------------


@query(eco("SELECT node_id, node_type, active, retained FROM nodes"))
def p1_activity(m):
    return m.nodes.select("node_id", "node_type", "active", "retained")


@query(eco("SELECT src, dst FROM edges"))
def p2_induced_edges(m):
    return m.edges


@query(eco("""SELECT 90::BIGINT AS active_window_days, (SELECT count(*) FROM act) AS nodes_retained, (SELECT count(*) FROM nodes WHERE NOT retained) AS nodes_removed,
  (SELECT count(*) FROM edges) AS edges_retained, (SELECT count(*) FROM alledges) AS edges_total,
  round(100.0::DOUBLE * (SELECT count(*) FROM act) / (SELECT count(*) FROM nodes), 2) AS nodes_retained_pct, round(100.0::DOUBLE * (SELECT count(*) FROM edges) / (SELECT count(*) FROM alledges), 2) AS edges_retained_pct"""))
def p3_projection_audit(m):
    return graph.projection_audit(m.nodes, m.all_edges, m.config)


@query(eco("SELECT node_id, project, funding FROM nodes LEFT JOIN projects USING (project) WHERE NOT retained"))
def p22_dormant_with_funding(m):
    return graph.dormant_with_funding(m.nodes, m.projects)


@query(eco("SELECT e.src, e.dst FROM alledges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst WHERE a.node_type IN ('Repo', 'ExternalRepo') AND b.node_type IN ('Repo', 'ExternalRepo')"))
def p4_dependency_subgraph(m):
    return graph.induced(m.all_edges, graph.dependency_nodes(m.nodes)).select("src", "dst")


@query(eco("SELECT pkg, dependent FROM closure"))
def g1_closure(m):
    return m.closure


@query(eco("SELECT node_id, criticality FROM crit"))
def g2_criticality(m):
    return m.criticality.select("node_id", "criticality")


@query()
def g2b_approximate_criticality(m):
    return reach.approximate_criticality(m.active_nodes, m.edges)


@query(eco("SELECT true AS within_bound, count(*) AS n_nodes, sum(criticality)::BIGINT AS exact_total FROM crit"))
def g2b_error_bound(m):
    """Sketches against exact counts: nearly all nodes are within three standard errors of a sketch (and one, for small counts)."""
    both = m.criticality.select("node_id", F.col("criticality").alias("exact")).join(reach.approximate_criticality(m.active_nodes, m.edges), "node_id")
    near = F.abs(F.col("criticality") - F.col("exact")) <= 3 * reach.SKETCH_ERROR * F.col("exact") + 1
    return both.agg((F.avg(near.cast("int")) >= 0.99).alias("within_bound"), F.count(F.lit(1)).alias("n_nodes"), F.sum("exact").alias("exact_total"))


@query(eco("SELECT a.node_id, coalesce(round(s, 3), 0) AS decay_criticality FROM act a LEFT JOIN (SELECT pkg, sum(exp(-coalesce(days, 0) / 30.0)) AS s FROM closure JOIN act d ON d.node_id = dependent AND d.active GROUP BY 1) ON pkg = a.node_id"))
def g3_decay_criticality(m):
    return reach.decay_criticality(m.active_nodes, m.closure, m.config)


@query(eco("SELECT contributor AS owner, at_risk AS reach FROM reach"))
def g4_union_reach(m):
    return reach.union_reach(m.concentration.filter("pony_factor = 1").select(F.col("top_contributor").alias("owner"), F.col("repo").alias("node_id")), m.closure)


@query(eco("SELECT node_id, core FROM cores"))
def g5_core_numbers(m):
    return m.cores


@query(eco("SELECT a, b FROM bridges"))
def g6_bridges(m):
    return m.bridges


@query(eco("""SELECT node_id, coalesce(sum(n) FILTER (w = 'a'), 0)::BIGINT AS direct_dependents, coalesce(sum(n) FILTER (w = 'b'), 0)::BIGINT AS direct_dependencies,
  coalesce(sum(n) FILTER (w = 'c'), 0)::BIGINT AS transitive_dependents, coalesce(sum(n) FILTER (w = 'd'), 0)::BIGINT AS transitive_dependencies
  FROM (SELECT dst AS node_id, count(*) AS n, 'a' AS w FROM edges GROUP BY 1 UNION ALL SELECT src, count(*), 'b' FROM edges GROUP BY 1
        UNION ALL SELECT pkg, count(*), 'c' FROM closure GROUP BY 1 UNION ALL SELECT dependent, count(*), 'd' FROM closure GROUP BY 1) GROUP BY 1"""))
def g7_neighbourhood(m):
    return reach.neighbourhood(m.edges, m.closure)


@query(eco("""SELECT 'in' AS side, coalesce(n, 0) AS degree, count(*) AS n_nodes FROM nodes LEFT JOIN (SELECT dst, count(*) AS n FROM alledges GROUP BY 1) ON dst = node_id GROUP BY 2
  UNION ALL SELECT 'out', coalesce(n, 0), count(*) FROM nodes LEFT JOIN (SELECT src, count(*) AS n FROM alledges GROUP BY 1) ON src = node_id GROUP BY 2"""))
def g8_degree_histogram(m):
    return graph.degree_histogram(m.nodes, m.all_edges)


@query(eco("SELECT (SELECT round(avg(n), 4) FROM (SELECT count(*) AS n FROM edges GROUP BY dst)) AS mean_in_degree, (SELECT round(quantile_cont(criticality, 0.75), 4) FROM crit WHERE criticality > 0) AS criticality_p75"))
def g8_degree_summary(m):
    return graph.degree_summary(m.edges, m.criticality).select(R("mean_in_degree", 4).alias("mean_in_degree"), R("criticality_p75", 4).alias("criticality_p75"))


@query(eco("SELECT core, count(*) AS n_nodes FROM cores GROUP BY 1"))
def g9_core_shells(m):
    return cohesion.core_shells(m.cores)


@query(eco("SELECT node_id, core, criticality FROM cores JOIN crit USING (node_id) WHERE core = (SELECT max(core) FROM cores)"))
def g9_inner_core(m):
    return cohesion.inner_core(m.cores).join(m.criticality, "node_id").select("node_id", "core", "criticality")


@query(eco("SELECT src AS node_id FROM edges UNION SELECT dst FROM edges UNION SELECT node_id FROM crit WHERE criticality_pct >= 95 UNION SELECT dst FROM edges GROUP BY dst HAVING count(*) >= 3"))
def g10_touched_nodes(m):
    hubs = m.edges.groupBy(F.col("dst").alias("node_id")).count().filter("count >= 3")
    return graph.touched(m.edges, hubs, m.criticality.filter("criticality_pct >= 95"))


@query(eco("SELECT (SELECT count(*) FROM bridges) AS bridges, (SELECT count(*) FROM und) AS edges, round((SELECT count(*) FROM bridges) / (SELECT count(*) FROM und)::DOUBLE, 4) AS share"))
def a31_bridge_share(m):
    return cohesion.bridge_share(m.bridges, m.edges)


# --- completion, enrichment, keys -----------------------------------------------------------------------------------


@query("SELECT coalesce(n.node_id, x.node_id) AS node_id, coalesce(node_type, 'ExternalRepo') AS node_type FROM (SELECT p_partkey AS node_id, 'Repo' AS node_type FROM part) n FULL JOIN (SELECT DISTINCT unnest([l_partkey, -l_suppkey]) AS node_id FROM lineitem) x ON x.node_id = n.node_id")
def j1_complete_endpoints(m):
    """Parts are the nodes; suppliers of line items are ends that no node has."""
    known = m.table("part").select(F.col("p_partkey").alias("node_id"), F.lit("Repo").alias("node_type"), F.lit(None).cast("string").alias("ecosystem"))
    deps = m.table("lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst"), F.lit("PYPI").alias("ecosystem"), F.col("l_orderkey").alias("ord"))
    return graph.complete_endpoints(known, deps).select("node_id", "node_type")


@query(eco("SELECT 'c' || contributor AS node_id, 'Contributor' AS node_type, true AS active FROM (SELECT DISTINCT contributor FROM contrib) UNION ALL SELECT 'r' || node_id, node_type, active FROM nodes"))
def j2_complete_contributors(m):
    n = m.nodes.select(F.concat(F.lit("r"), "node_id").alias("node_id"), "node_type", "active")
    return graph.complete_contributors(n, m.contributions.select(F.concat(F.lit("c"), "contributor").alias("contributor"))).select("node_id", "node_type", "active")


@query("SELECT p_partkey AS node_id, downloads, stars, forks FROM part LEFT JOIN (SELECT l_partkey AS k, sum(l_quantity)::BIGINT AS downloads, count(*) AS stars, 0::BIGINT AS forks FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 5 GROUP BY 1) ON k = p_partkey")
def j3_enrich_adoption(m):
    """Signals come from late returned lines only, so some parts have none."""
    s = m.table("lineitem").filter("l_returnflag = 'R' AND l_linenumber > 5").groupBy(F.col("l_partkey").alias("node_id")).agg(F.sum("l_quantity").cast("long").alias("downloads"), F.count(F.lit(1)).alias("stars"), F.lit(None).cast("long").alias("forks"))
    return graph.enrich_adoption(m.table("part").select(F.col("p_partkey").alias("node_id")), s).select("node_id", "downloads", "stars", "forks")


@query(eco("SELECT node_id, coalesce(age, days) AS days, coalesce(age <= 90, active) AS active FROM nodes LEFT JOIN ages ON repo = node_id"))
def j4_enrich_activity(m):
    act = m.ages.select(F.col("repo").alias("node_id"), F.col("age").alias("days_since_commit"), F.lit(False).alias("archived"))
    return graph.enrich_activity(m.nodes, act, m.config).select("node_id", F.col("days_since_commit").alias("days"), "active")


def _titles(m):
    names_ = m.table("part").select(F.col("p_name").alias("title")).distinct()
    return names_, names_.select(F.concat("title", F.lit(" sdk")).alias("project"), F.crc32("title").alias("ord"))


#: The ratio in SQL: of each pair of texts the longest block in common, the first of equals, then what is left and right of it.
_RATIO = """WITH RECURSIVE t AS (SELECT DISTINCT p_name AS title FROM part),
seg AS (
  SELECT a.title, b.title || ' sdk' AS project, lower(a.title) AS x, lower(b.title || ' sdk') AS y, 0 AS m FROM t a, t b
  UNION ALL
  SELECT title, project, CASE side WHEN 0 THEN substr(x, 1, i - 1) ELSE substr(x, i + n) END, CASE side WHEN 0 THEN substr(y, 1, strpos(y, block) - 1) ELSE substr(y, strpos(y, block) + n) END, n * (1 - side)
  FROM (SELECT *, best // 1000 AS n, 1000 - best % 1000 AS i, substr(x, 1000 - best % 1000, best // 1000) AS block
        FROM (SELECT *, list_max(flatten([[CASE WHEN contains(y, substr(x, i::INT, n::INT)) THEN n * 1000 + 1000 - i ELSE 0 END FOR n IN range(1, length(x) - i + 2)] FOR i IN range(1, length(x) + 1)])) AS best FROM seg WHERE x <> '' AND y <> '')
        WHERE best > 0), (VALUES (0), (1)) sides(side)),
ratios AS (SELECT title, project, 2 * sum(m) / (length(title) + length(project))::DOUBLE AS ratio FROM seg GROUP BY 1, 2)
SELECT title, arg_max(project, ratio) AS project, round(max(ratio), 6) AS ratio FROM ratios WHERE ratio >= 0.6 GROUP BY 1"""


@query(_RATIO)
def j5_fuzzy_match(m):
    return fuzzy.best_match(*_titles(m)).withColumn("ratio", R("ratio", 6))


@query("""WITH t AS (SELECT p_partkey, p_name || ' ' || substr(md5(p_partkey::VARCHAR), 1, 16) AS project FROM part)
SELECT p_partkey AS ord, project, round((2 * length(project) - 2) / (2 * length(project) - 1)::DOUBLE, 6) AS ratio FROM t""")
def j5_fuzzy_misspelt(m):
    """A title for each part with a letter left out, against the titles of all parts."""
    t = m.table("part").select(F.concat_ws(" ", "p_name", F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 16)).alias("project"), F.col("p_partkey").alias("ord"))
    off = t.select(F.concat(F.substring("project", 1, 4), F.expr("substring(project, 6)")).alias("title"))
    best = fuzzy.best_match(off, t)
    return best.join(t.hint("merge"), "project").select("ord", "project", R("ratio", 6).alias("ratio"))


@query("""WITH t AS (SELECT DISTINCT p_name AS title FROM part), p AS (SELECT title || ' sdk' AS project FROM t),
x AS (SELECT title, project, 1 - levenshtein(lower(title), lower(project)) / greatest(length(title), length(project))::DOUBLE AS ratio FROM t, p)
SELECT title, round(max(ratio), 6) AS ratio FROM x WHERE ratio >= 0.6 GROUP BY 1""")
def j5_fuzzy_match_levenshtein(m):
    return fuzzy.best_match_levenshtein(*_titles(m)).select("title", "ratio")


@query(eco("SELECT node_id, criticality, hhi, top_contributor::VARCHAR AS top_contributor, round(adoption_score, 4) AS adoption_score FROM gate0"))
def j6_gate_input(m):
    return m.gate_rows.select("node_id", "criticality", "hhi", "top_contributor", R("adoption_score", 4).alias("adoption_score"))


@query(eco("SELECT c.node_id, criticality, coalesce(hhi, 0) AS hhi, coalesce(top_contributor::VARCHAR, 'unknown') AS top_contributor, coalesce(top_share, 0) AS top_share FROM crit c JOIN act a ON a.node_id = c.node_id AND node_type = 'Repo' LEFT JOIN conc ON repo = c.node_id"))
def j7_gate_input_service(m):
    repos = m.active_nodes.filter("node_type = 'Repo'").select("node_id")
    return surfaces.gate_input(m.criticality.join(repos, "node_id", "left_semi"), m.concentration, m.adoption, "left").select("node_id", "criticality", "hhi", "top_contributor", "top_share")


@query(eco("SELECT project, criticality, funding FROM universe"))
def j8_project_universe(m):
    return m.fer.select("project", "criticality", "funding")


@query(eco("SELECT DISTINCT f.node_id, contributor, coalesce(criticality, 0) AS criticality FROM flagged f LEFT JOIN crit USING (node_id)"))
def j9_flagged_criticality(m):
    f = m.concentration.filter("pony_factor = 1").select(F.col("repo").alias("node_id"), F.col("top_contributor").alias("contributor"))
    return f.join(m.criticality.select("node_id", "criticality"), "node_id", "left").na.fill(0, ["criticality"])


@query(eco("SELECT a.node_id, criticality, hhi FROM act a JOIN crit USING (node_id) JOIN conc ON repo = node_id WHERE node_type = 'Repo'"))
def j10_debt_input(m):
    r = m.active_nodes.filter("node_type = 'Repo'").select("node_id")
    return r.join(m.criticality, "node_id").join(m.concentration, F.col("repo") == F.col("node_id")).select("node_id", "criticality", "hhi")


@query("""WITH e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b, CASE WHEN l_returnflag = 'N' THEN 'NPM' ELSE 'CARGO' END AS ecosystem FROM lineitem),
u AS (SELECT 'p' || p_partkey AS name, 'https://p/' || p_brand AS url FROM part WHERE p_size > 10 UNION ALL SELECT 's' || s_suppkey, 'https://s/' || s_name FROM supplier WHERE s_acctbal > 0)
SELECT CASE WHEN ecosystem = 'CARGO' THEN coalesce(x.url, a) ELSE a END AS src, CASE WHEN ecosystem = 'CARGO' THEN coalesce(y.url, b) ELSE b END AS dst, ecosystem FROM e LEFT JOIN u x ON x.name = a LEFT JOIN u y ON y.name = b""")
def j11_translate_names(m):
    edges, urls = _named_edges(m)
    return ingest.translate_names(edges, urls, "CARGO").select(F.col("from_repo").alias("src"), F.col("to_package").alias("dst"), "ecosystem")


def _named_edges(m):
    name = lambda p, c: F.concat(F.lit(p), c)
    edges = m.table("lineitem").select(name("p", "l_partkey").alias("from_repo"), name("s", "l_suppkey").alias("to_package"), F.when(F.col("l_returnflag") == "N", "NPM").otherwise("CARGO").alias("ecosystem")).distinct()
    p = m.table("part").filter("p_size > 10").select(name("p", "p_partkey").alias("name"), name("https://p/", "p_brand").alias("url"))
    return edges, p.unionByName(m.table("supplier").filter("s_acctbal > 0").select(name("s", "s_suppkey").alias("name"), name("https://s/", "s_name").alias("url")))


@query("SELECT 'p' || l_partkey AS name FROM lineitem UNION SELECT 's' || l_suppkey FROM lineitem")
def u3_package_names(m):
    return ingest.package_names(_named_edges(m)[0])


@query("SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 40")
def u7_live_first(m):
    """Something was ingested, so no cached row counts."""
    return ingest.live_else_cached(m.table("lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("k")), m.table("orders").select(F.col("o_orderkey").alias("k")))


@query("SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 1000 UNION ALL SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 1000)")
def u7_live_else_cached(m):
    """Nothing was ingested, so the cached rows count."""
    return ingest.live_else_cached(m.table("lineitem").filter("l_quantity > 1000").select(F.col("l_orderkey").alias("k")), m.table("orders").select(F.col("o_orderkey").alias("k")))


@query("SELECT coalesce(a.k, b.k) AS node_id, coalesce(downloads, 0) AS downloads, coalesce(stars, 0) AS stars, coalesce(forks, 0) AS forks FROM (SELECT l_partkey AS k, sum(l_quantity)::BIGINT AS downloads FROM lineitem WHERE l_linenumber = 6 GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, count(*) AS stars, count(DISTINCT l_suppkey) AS forks FROM lineitem WHERE l_linenumber = 7 GROUP BY 1) b ON a.k = b.k")
def j12_merge_signals(m):
    """Sixth lines give downloads, seventh lines stars and forks; many parts have one of them only."""
    line = lambda n: m.table("lineitem").filter(f"l_linenumber = {n}").groupBy(F.col("l_partkey").alias("node_id"))
    return adoption.merge_signals(line(6).agg(F.sum("l_quantity").cast("long").alias("downloads")), line(7).agg(F.count(F.lit(1)).alias("stars"), F.count_distinct("l_suppkey").alias("forks")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j14_not_processed(m):
    done = m.table("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return graph.not_processed(m.table("orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 'r1' ELSE 'r3' END AS run FROM orders")
def j14_ledger(m):
    """Three runs over orders: the first has half of them, the second breaks off before it is entered, the third has all."""
    ledger = landing.Ledger(m.spark, f"{shared_dir(m.spark)}/ledger-{uuid.uuid4().hex}", "o_orderkey")
    orders, work = m.table("orders").select("o_orderkey", "o_totalprice"), lambda todo: todo
    ledger.process("r1", orders.filter("o_orderkey % 2 = 0"), work)
    ledger.attempt("r2", orders, work)
    ledger.process("r3", orders, work)
    ledger.process("r3", orders, work)
    return ledger.output("o_orderkey long, o_totalprice double")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'""")
def j16_apply_delta(m):
    e = m.table("events").select("user_id", "event_id", "event_type", (F.col("event_type") == "error").alias("gone"))
    return graph.apply_delta(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id"], "event_id", "gone").select("user_id", "event_id", "event_type")


#: What Model.refreshed changes: ages of some nodes, nodes and edges that go, edges that come.
CHANGED = """
n2 AS (
  SELECT *, coalesce(days <= 90 AND NOT archived, false) AS active, CASE WHEN days IS NULL THEN node_type = 'ExternalRepo' ELSE days <= 90 AND NOT archived END AS retained
  FROM (SELECT node_id, node_type, CASE WHEN node_id % 100 = 7 THEN 400 WHEN node_id % 100 = 57 THEN 1 ELSE days END AS days, archived AND node_id % 50 <> 7 AS archived FROM nodes WHERE node_id % 211 <> 13)),
e2 AS (SELECT src, dst FROM alledges WHERE src % 40 <> 3 UNION SELECT node_id, node_id // 7 FROM nodes WHERE node_id % 37 = 5 AND node_id // 7 > 0),
p2 AS (SELECT e2.src, e2.dst FROM e2 JOIN n2 a ON a.node_id = e2.src JOIN n2 b ON b.node_id = e2.dst WHERE a.retained AND b.retained AND e2.src <> e2.dst),
w2 AS (SELECT dst AS pkg, src AS dependent FROM p2 UNION SELECT w.pkg, e.src FROM w2 w JOIN p2 e ON e.dst = w.dependent),
c2 AS (SELECT pkg, dependent FROM w2 WHERE pkg <> dependent)
"""


@query(eco("SELECT node_id, active, retained FROM n2", CHANGED))
def j16_p1_refreshed_nodes(m):
    return m.refreshed.nodes.select("node_id", "active", "retained")


@query(eco("SELECT src, dst FROM p2", CHANGED))
def j16_p2_refreshed_edges(m):
    return m.refreshed.edges


@query(eco("SELECT pkg, dependent FROM c2", CHANGED))
def j16_g1_refreshed_closure(m):
    return m.refreshed.closure.pairs()


@query(eco("SELECT node_id, coalesce(n, 0) AS criticality FROM n2 LEFT JOIN (SELECT pkg, count(*) AS n FROM c2 JOIN n2 d ON d.node_id = dependent AND d.active GROUP BY 1) ON pkg = node_id WHERE retained", CHANGED))
def j16_g2_refreshed_criticality(m):
    return m.refreshed.criticality


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def w7_first_per_key(m):
    return rank.first_per_key(m.table("events"), ["user_id"], "event_id").select("user_id", "event_id")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def w8_last_per_key(m):
    return rank.last_per_key(m.table("events"), ["user_id"], "event_id").select("user_id", "event_id")


# --- ranks and concentration ----------------------------------------------------------------------------------------


@query(eco("SELECT node_id, round(criticality_pct, 6) AS criticality_pct FROM crit"))
def w1_exclusive_percentile(m):
    return m.criticality.select("node_id", R("criticality_pct", 6).alias("criticality_pct"))


@query(eco("SELECT node_id, round(stars_pct, 6) AS stars_pct FROM adopt"))
def w2_average_percentile(m):
    return m.adoption.select("node_id", R("stars_pct", 6).alias("stars_pct"))


@query(eco("SELECT project, round(fund_pct, 6) AS fund_pct FROM fer0"))
def w5_funded_percentile(m):
    return m.fer.select("project", R("fund_pct", 6).alias("fund_pct"))


@query(eco("SELECT node_id, floor(criticality_pct)::BIGINT AS pct FROM crit"))
def w6_truncated_percentile(m):
    return rank.truncated_percentile(m.criticality.select("node_id", "criticality"), "criticality", "pct").select("node_id", "pct")


@query(eco("SELECT repo, pony_factor, hhi, entropy, hhi_tier, top_contributor, top_share, n_contributors, total_commits FROM conc"))
def a1_concentration(m):
    return m.concentration.drop("hhi_exact")


@query(eco("SELECT repo, contributor, commits, round(100 * share, 2) AS commit_share_pct FROM shares"))
def a2_commit_share(m):
    return concentration.commit_share_percent(m.active_contributions.select("repo", "contributor", "commits"))


@query("""SELECT user_id AS repo, event_type AS email, count(*) AS commits, min(ts) AS first_date, max(ts) AS last_date,
  (array_agg(props ORDER BY ts, props))[1] AS display, (count(DISTINCT props) - 1) AS n_aliases,
  array_to_string(list_sort(list_filter(list(DISTINCT props), lambda x: x <> (array_agg(props ORDER BY ts, props))[1])), ' | ') AS alias_names FROM events GROUP BY 1, 2""")
def a3_roll_up_commits(m):
    c = m.table("events").select(F.col("user_id").alias("repo"), F.col("event_type").alias("email"), F.col("props").alias("name"), F.col("ts").alias("committed_at"))
    return concentration.roll_up_commits(c).withColumns({"n_aliases": F.size("aliases").cast("long"), "alias_names": F.array_join("aliases", " | ")}).drop("aliases")


@query(eco("SELECT p_partkey AS repo, coalesce(age, 9999) AS days_since_commit FROM part LEFT JOIN ages ON repo = p_partkey"))
def a4_recency(m):
    return concentration.recency(m.table("part").select(F.col("p_partkey").alias("repo")), m.commits, m.as_of).select("repo", "days_since_commit")


@query(eco("SELECT node_id, downloads, stars, forks, round(adoption_score, 6) AS adoption_score FROM adopt"))
def a5_adoption(m):
    return m.adoption.select("node_id", "downloads", "stars", "forks", R("adoption_score", 6).alias("adoption_score"))


@query(eco("SELECT * FROM totals"))
def a6_a7_project_totals(m):
    return m.project_totals


@query(eco("SELECT project, criticality, round(funding, 2) AS funding, round(crit_pct, 1) AS crit_pct, round(fund_pct, 1) AS fund_pct, fer, tier, pony_risk_repos, any_pony FROM fer"))
def a8_funding_efficiency(m):
    return m.fer.select("project", "criticality", R("funding", 2).alias("funding"), R("crit_pct", 1).alias("crit_pct"), R("fund_pct", 1).alias("fund_pct"), "fer", "tier", "pony_risk_repos", "any_pony")


@query(eco("SELECT contributor, kci, n_repos, n_projects, round(kci_pct, 4) AS kci_pct, at_risk FROM keystones"))
def a9_keystones(m):
    return m.keystones.select("contributor", "kci", "n_repos", "n_projects", R("kci_pct", 4).alias("kci_pct"), "at_risk")


@query(eco("SELECT contributor, f.node_id, coalesce(criticality, 0) AS criticality FROM flagged f LEFT JOIN crit USING (node_id)"))
def a9_keystone_repos(m):
    return surfaces.keystone_repos(m.concentration, m.criticality)


@query(eco("SELECT node_id, project, days, criticality, hhi, trend, hhi_tier, risk FROM debt"))
def a10_maintenance_debt(m):
    return m.debt.select("node_id", "project", "days", "criticality", "hhi", "trend", "hhi_tier", "risk")


_FAILS = "(NOT criticality_passed)::INT + (NOT maintenance_passed)::INT + (NOT adoption_passed)::INT"


@query(eco(f"""SELECT count(*) AS total, count(*) FILTER (passed) AS n_passed, count(*) FILTER (NOT passed) AS n_failed, count(*) FILTER (borderline) AS n_borderline,
  round(avg(passed::INT), 4) AS pass_rate, round(avg(criticality_passed::INT), 4) AS criticality_pass_rate, round(avg(maintenance_passed::INT), 4) AS maintenance_pass_rate, round(avg(adoption_passed::INT), 4) AS adoption_pass_rate,
  count(*) FILTER (NOT passed AND {_FAILS} = 3) AS all_three_failed, count(*) FILTER (NOT passed AND {_FAILS} = 1 AND NOT criticality_passed) AS only_criticality_failed,
  count(*) FILTER (NOT passed AND {_FAILS} = 1 AND NOT maintenance_passed) AS only_maintenance_failed, count(*) FILTER (NOT passed AND {_FAILS} = 1 AND NOT adoption_passed) AS only_adoption_failed,
  count(*) FILTER (NOT passed AND {_FAILS} = 2) AS two_failed FROM gate"""))
def a11_gate_summary(m):
    return surfaces.gate_summary(m.gate, m.config)


@query(eco("SELECT count(*) AS total, count(*) FILTER (hhi_tier = 'critical') AS n_critical, count(*) FILTER (trend = 'declining') AS n_declining, (SELECT coalesce(string_agg(node_id::VARCHAR, ',' ORDER BY risk DESC, node_id), '') FROM (SELECT * FROM debt ORDER BY risk DESC, node_id LIMIT 5)) AS top FROM debt"))
def a12_debt_summary(m):
    return surfaces.debt_summary(m.debt).withColumn("top", _keys("top", "node_id"))


def _keys(column, key):
    """The keys of an array of structs, in order, as text."""
    return F.array_join(F.transform(column, lambda x: x[key].cast("string")), ",")


@query(eco("SELECT count(*) AS total, coalesce(sum(at_risk), 0)::BIGINT AS at_risk_total, coalesce(max(kci), 0) AS max_kci, (SELECT coalesce(string_agg(contributor::VARCHAR, ',' ORDER BY kci DESC, contributor), '') FROM (SELECT * FROM keystones ORDER BY kci DESC, contributor LIMIT 5)) AS top FROM keystones"))
def a13_keystone_summary(m):
    return surfaces.keystone_summary(m.keystones).withColumn("top", _keys("top", "contributor"))


@query(eco("SELECT t.tier, count(f.tier) AS n FROM (SELECT unnest(['critically_underfunded', 'underfunded', 'balanced', 'overfunded', 'significantly_overfunded', 'unfunded']) AS tier) t LEFT JOIN fer f ON f.tier = t.tier GROUP BY 1"))
def a14_fer_summary(m):
    return surfaces.fer_summary(m.fer)


@query(eco("SELECT coalesce(string_agg(project, ',' ORDER BY fer DESC, project), '') AS top FROM (SELECT * FROM fer WHERE tier = 'critically_underfunded' ORDER BY fer DESC, project LIMIT 5)"))
def a14_most_underfunded(m):
    return surfaces.most_underfunded(m.fer).select(_keys("top", "project").alias("top"))


_SNAPSHOT = """SELECT (SELECT count(*) FROM act WHERE node_type = 'Repo') AS active_repos, (SELECT count(DISTINCT project) FROM nodes WHERE node_type = 'Repo') AS projects, 0::BIGINT AS project_nodes,
  (SELECT count(*) FROM edges) AS dependency_edges, (SELECT max(core) FROM cores) AS max_core, (SELECT count(*) FROM bridges) AS bridge_edges,
  (SELECT round(avg(hhi), 1) FROM conc) AS mean_hhi, (SELECT round(median(hhi), 1) FROM conc) AS median_hhi, (SELECT round(avg(pony_factor), 4) FROM conc) AS pony_rate,
  (SELECT round(avg(criticality), 2) FROM crit) AS mean_criticality, (SELECT round(median(criticality), 2) FROM crit) AS median_criticality, (SELECT max(criticality) FROM crit) AS max_criticality,
  (SELECT round(avg(passed::INT), 4) FROM gate) AS gate_pass_rate, (SELECT count(*) FROM gate WHERE borderline) AS borderline, (SELECT count(*) FROM debt) AS debt_size, (SELECT count(*) FROM keystones) AS keystone_count,
  (SELECT coalesce(string_agg(node_id::VARCHAR, ',' ORDER BY criticality DESC, node_id), '') FROM (SELECT * FROM crit WHERE criticality > 0 ORDER BY criticality DESC, node_id LIMIT 10)) AS top_critical,
  (SELECT coalesce(string_agg(contributor::VARCHAR, ',' ORDER BY kci DESC, contributor), '') FROM (SELECT * FROM keystones ORDER BY kci DESC, contributor LIMIT 5)) AS top_keystones,
  (SELECT string_agg(tier || ':' || n, ',' ORDER BY tier) FROM (SELECT tier, count(*) AS n FROM fer GROUP BY 1)) AS fer_tiers"""


@query(eco(_SNAPSHOT))
def a15_snapshot(m):
    tiers_ = F.array_join(F.transform(F.map_entries("fer_tiers"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return m.snapshot.withColumns({"top_critical": _keys("top_critical", "node_id"), "top_keystones": _keys("top_keystones", "contributor"), "fer_tiers": tiers_})


@query(eco(" SELECT *, underfunded || ' of ' || fer_total || ' projects have too little funding for their importance, ' || debt_size || ' repositories carry maintenance debt, and ' || pass_pct || ' % of those scored pass the gate.' AS answer FROM facts", "facts AS (SELECT (SELECT count(*) FROM fer) AS fer_total, (SELECT count(*) FROM fer WHERE tier IN ('critically_underfunded', 'underfunded')) AS underfunded, (SELECT count(*) FROM debt) AS debt_size, (SELECT round(100 * avg(passed::INT))::BIGINT FROM gate) AS pass_pct)"))
def a16_north_star(m):
    return snapshots.north_star(m.fer, m.debt, m.gate)


@query(eco("SELECT 'commits' AS part, count(*) AS n FROM commits UNION ALL SELECT 'contributions', count(*) FROM contrib UNION ALL SELECT 'dependencies', count(*) FROM alledges UNION ALL SELECT 'adoption', count(*) FROM signals"))
def a17_coverage(m):
    return graph.coverage({"commits": m.commits, "contributions": m.contributions, "dependencies": m.all_edges, "adoption": m.signals})


@query("SELECT count(DISTINCT user_id) AS processed, (SELECT count(DISTINCT user_id) FROM events WHERE event_type <> 'error') AS accessible, count(DISTINCT user_id) - (SELECT count(DISTINCT user_id) FROM events WHERE event_type <> 'error') AS inaccessible, (SELECT count(DISTINCT props) FROM events WHERE event_type <> 'error') AS contributors FROM events")
def a18_run_summary(m):
    return concentration.run_summary(m.table("events").select(F.col("user_id").alias("repo"), F.col("props").alias("email"), (F.col("event_type") != "error").alias("accessible")))


@query(eco("SELECT CASE WHEN dst < 5 THEN 'hub' ELSE dst::VARCHAR END AS target, count(*) AS n, count(DISTINCT src) AS n_sources FROM alledges GROUP BY 1 ORDER BY n DESC, target LIMIT 8"))
def a19_t7_dependency_hubs(m):
    return graph.hubs(m.all_edges.withColumn("dst", names.canonical(F.col("dst").cast("string"), _HUBS)), 8)


#: Display names of the packages with the lowest keys, which most others depend on.
_HUBS = {str(i): "hub" for i in range(5)}


@query(eco("SELECT count(DISTINCT src) AS n_sources, count(*) AS n_edges FROM alledges"))
def a19_source_count(m):
    return graph.source_count(m.all_edges)


_TOP = "top AS (SELECT repo, sum(commits)::BIGINT AS total, (array_agg(contributor ORDER BY commits DESC, contributor))[1] AS top_contributor, round(100.0::DOUBLE * max(commits) / sum(commits), 2) AS top_pct FROM contrib GROUP BY 1)"


@query(eco(" SELECT b::BIGINT AS bin, count(repo) AS n FROM range(20) g(b) LEFT JOIN top ON least(floor(top_pct / 5), 19) = b GROUP BY 1", _TOP))
def a20_share_histogram(m):
    return concentration.share_histogram(concentration.top_contributors(m.contributions))


@query(eco(" SELECT count(*) AS n, count(*) FILTER (top_pct >= 50) AS n_flagged, round(100.0::DOUBLE * count(*) FILTER (top_pct >= 50) / count(*), 2) AS flagged_pct FROM top", _TOP))
def a20_flagged_share(m):
    return concentration.flagged_share(concentration.top_contributors(m.contributions))


@query(eco(" SELECT *, CASE WHEN top_pct < 30 THEN 'healthy' WHEN top_pct < 50 THEN 'moderate' WHEN top_pct < 80 THEN 'concentrated' ELSE 'critical' END AS band FROM top", _TOP))
def a21_p13_top_contributors(m):
    return concentration.top_contributors(m.contributions)


@query(eco("SELECT hhi_tier, count(*) AS n, round(avg(hhi), 1) AS mean_hhi, round(avg(pony_factor), 4) AS pony_rate, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM conc), 2) AS pct FROM conc GROUP BY 1"))
def a29_tier_summary(m):
    return concentration.tier_summary(m.concentration)


@query(eco(" SELECT CASE WHEN top_pct < 30 THEN 'healthy' WHEN top_pct < 50 THEN 'moderate' WHEN top_pct < 80 THEN 'concentrated' ELSE 'critical' END AS band, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM top), 2) AS pct, (SELECT round(avg(hhi), 1) FROM conc) AS mean_hhi, (SELECT round(avg(pony_factor), 4) FROM conc) AS pony_rate FROM top GROUP BY 1", _TOP))
def a22_band_summary(m):
    return concentration.band_summary(concentration.top_contributors(m.contributions), m.concentration)


@query(eco("SELECT * FROM (SELECT 'total' AS stage, count(*) AS n FROM gate UNION ALL SELECT 'criticality', count(*) FROM gate WHERE criticality_passed UNION ALL SELECT 'maintenance', count(*) FROM gate WHERE maintenance_passed UNION ALL SELECT 'adoption', count(*) FROM gate WHERE adoption_passed UNION ALL SELECT 'passed', count(*) FROM gate WHERE passed UNION ALL SELECT 'failed', count(*) FROM gate WHERE NOT passed)"))
def a23_gate_funnel(m):
    return surfaces.gate_funnel(m.gate)


_BOTS = (1, 4)
_BIP = "people AS (SELECT *, commits / sum(commits) OVER (PARTITION BY repo)::DOUBLE AS part FROM contrib), n AS (SELECT contributor, count(DISTINCT repo) AS k FROM people WHERE contributor NOT IN (1, 4) GROUP BY 1), kept AS (SELECT repo, p.contributor, commits, round(part * 100, 4) AS share_pct, k > 1 AS cross_repo FROM people p JOIN n ON n.contributor = p.contributor WHERE part * 100 >= 15 OR k > 1)"


@query(eco(" SELECT * FROM kept", _BIP))
def p9_p17_bipartite(m):
    return concentration.bipartite(m.contributions.select("repo", "contributor", "commits"), _BOTS)


@query(eco(" SELECT contributor, count(DISTINCT repo) AS n_repos, sum(commits)::BIGINT AS commits, bool_or(cross_repo) AS cross_repo, row_number() OVER (ORDER BY bool_or(cross_repo) DESC, sum(commits) DESC, contributor) AS place FROM kept GROUP BY 1", _BIP))
def a24_t9_contributors(m):
    return concentration.contributor_order(_bipartite(m))


def _bipartite(m):
    return concentration.bipartite(m.contributions.select("repo", "contributor", "commits"), _BOTS)


def _passing(m):
    return m.gate.filter("passed").select(F.col("node_id").alias("repo"))


@query(eco(" SELECT repo, count(*) AS n_contributors, coalesce(bool_or(passed), false) AS passed, row_number() OVER (ORDER BY coalesce(bool_or(passed), false) DESC, count(*) DESC, repo) AS place FROM kept LEFT JOIN gate ON node_id = repo GROUP BY 1", _BIP))
def a24_t9_repos(m):
    return concentration.repo_order(_bipartite(m), _passing(m))


@query(eco(" SELECT repo, contributor, CASE WHEN share_pct >= 70 THEN 'dominant' WHEN share_pct >= 40 THEN 'major' WHEN share_pct >= 20 THEN 'notable' ELSE 'minor' END AS band FROM kept", _BIP))
def p13_edge_bands(m):
    return _bipartite(m).select("repo", "contributor", tiers.edge_share_band(F.col("share_pct")).alias("band"))


@query(eco(" SELECT contributor FROM kept WHERE cross_repo UNION SELECT contributor FROM kept JOIN gate ON node_id = repo WHERE passed AND share_pct >= 20", _BIP))
def u5_labels(m):
    return concentration.labelled(_bipartite(m), _passing(m))


@query(eco(" SELECT src, dst, count(*) OVER (PARTITION BY src) >= 3 AS multi FROM (SELECT CASE WHEN src < 5 THEN 'hub' ELSE src::VARCHAR END AS src, CASE WHEN dst < 5 THEN 'hub' ELSE dst::VARCHAR END AS dst FROM dep JOIN (SELECT dst AS h FROM dep GROUP BY 1 HAVING count(*) >= 5) ON h = dst) WHERE src <> dst", "dep AS (SELECT src, dst FROM alledges UNION SELECT l_suppkey + 1000000000, l_partkey FROM lineitem)"))
def p8_p18_core_hub_edges(m):
    """Suppliers depend on the parts they deliver; a hub is what five or more depend on."""
    more = m.table("lineitem").select((F.col("l_suppkey") + 1_000_000_000).alias("src"), F.col("l_partkey").alias("dst"))
    e = m.all_edges.unionByName(more).distinct()
    core = e.groupBy("dst").count().filter("count >= 5").select("dst")
    name = lambda c: names.canonical(F.col(c).cast("string"), _HUBS)
    return graph.core_hub_edges(e, core, name("src"), name("dst"))


@query(eco("SELECT a.node_id, stars, forks, downloads, coalesce(passed, false) AS passed FROM adopt a LEFT JOIN gate g ON g.node_id = a.node_id"))
def a25_adoption_scatter(m):
    return adoption.scatter(m.adoption, m.gate)


@query("SELECT p_type AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM part), 2) AS pct FROM part GROUP BY 1")
def a26_category_counts(m):
    return rank.value_counts(m.table("part"), "p_type")


@query("SELECT o_orderstatus AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders), 2) AS pct FROM orders GROUP BY 1")
def a26_status_counts(m):
    return rank.value_counts(m.table("orders"), "o_orderstatus")


@query(eco("""SELECT round(sum(funding), 2) AS total, round(median(funding), 2) AS median, max(funding) AS max, round(sum(funding * (2 * i - n - 1)) / (max(n) * sum(funding)), 6) AS gini
  FROM (SELECT funding, row_number() OVER (ORDER BY funding) AS i, count(*) OVER () AS n FROM projects)"""))
def a27_funding_distribution(m):
    return rank.distribution(m.projects, "total_awarded_usd").select(R("total", 2).alias("total"), R("median", 2).alias("median"), "max", R("gini", 6).alias("gini"))


@query(eco("SELECT t.project, t.criticality, n_repos, t.pony_risk_repos, round((rank() OVER (ORDER BY t.criticality) + (count(*) OVER (PARTITION BY t.criticality) - 1) / 2.0) / (count(*) OVER ())::DOUBLE * 100, 6) AS crit_rank_pct, round(t.pony_risk_repos / greatest(n_repos, 1)::DOUBLE, 4) AS high_pony_ratio, fer, CASE WHEN fer IS NULL THEN 'unknown' ELSE tier END AS tier FROM totals t LEFT JOIN fer f USING (project)"))
def a30_scorecard(m):
    return surfaces.scorecard(m.project_totals, m.fer).withColumn("crit_rank_pct", R("crit_rank_pct", 6))


@query(eco("SELECT hhi_tier, least(floor(hhi / 250), 39)::BIGINT AS bin, count(*) AS n FROM conc GROUP BY 1, 2"))
def a32_hhi_histogram(m):
    return concentration.hhi_histogram(m.concentration)


@query("SELECT o_orderpriority AS category, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1")
def a33_categories(m):
    return surfaces.rollup(_awards(m), ["category"]).select("category", R("total", 2).alias("total"), "n")


def _awards(m):
    """Orders as awards: round, category, amount, voter, stage, flagged."""
    return m.table("orders").select(F.date_trunc("quarter", "o_orderdate").alias("round"), F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("amount"), F.col("o_custkey").alias("voter"), F.col("o_orderstatus").alias("stage"), (F.col("o_orderstatus") == "F").alias("flagged"))


@query("SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS round, round(sum(o_totalprice), 2) AS total, count(*) AS n, count(DISTINCT o_custkey) AS voters, round(100.0::DOUBLE * avg((o_orderstatus = 'F')::INT), 2) AS flagged_pct FROM orders GROUP BY 1")
def a33_rounds(m):
    return surfaces.rollup(_awards(m), ["round"]).select("round", R("total", 2).alias("total"), "n", "voters", R("flagged_pct", 2).alias("flagged_pct"))


@query("SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS round, o_orderpriority AS category, round(sum(o_totalprice), 2) AS total, count(*) AS n, count(DISTINCT o_custkey) AS voters, round(100.0::DOUBLE * avg((o_orderstatus = 'F')::INT), 2) AS flagged_pct FROM orders GROUP BY 1, 2")
def a33_dashboard_rollup(m):
    return surfaces.rollup(_awards(m), ["round", "category"]).withColumns({"total": R("total", 2), "flagged_pct": R("flagged_pct", 2)})


@query("SELECT o_orderstatus AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders), 2) AS pct FROM orders GROUP BY 1")
def a33_stages(m):
    return rank.value_counts(_awards(m), "stage")


@query("SELECT n_name AS github_org, count(*) AS project_count FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def a33_org_counts(m):
    c = m.table("customer").join(m.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return tables.org_counts(c.select(F.concat(F.lit("https://github.com/"), "n_name", F.lit("/"), "c_name").alias("github_url")))


@query(eco("SELECT tier, count(*) AS n, count(*) FILTER (any_pony) AS n_with_pony, (SELECT count(*) FROM fer WHERE tier IN ('critically_underfunded', 'underfunded')) AS n_underfunded FROM fer GROUP BY 1"))
def a34_fer_display(m):
    return surfaces.fer_display(m.fer)


@query(eco("SELECT node_id, round(criticality_pct, 4) AS criticality_pct, hhi, trend FROM debt"))
def a35_debt_scatter(m):
    return surfaces.debt_scatter(m.debt).withColumn("criticality_pct", R("criticality_pct", 4))


@query(eco("SELECT 'node' AS kind, node_type AS label, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', 'depends_on', count(*) FROM alledges UNION ALL SELECT 'edge', 'contributed_to', count(*) FROM contrib"))
def a36_type_counts(m):
    typed = m.all_edges.select(F.lit("depends_on").alias("edge_type")).unionAll(m.contributions.select(F.lit("contributed_to").alias("edge_type")))
    return graph.type_counts(m.nodes, typed)


@query(eco("SELECT (SELECT count(*) FROM crit WHERE criticality > 0) AS scored, (SELECT max(criticality) FROM crit) AS max_score, (SELECT round(100 * avg(pony_factor), 2) FROM conc) AS flagged_pct, (SELECT count(*) FROM conc WHERE hhi_tier = 'critical') AS n_critical, (SELECT count(*) FROM cores WHERE core = (SELECT max(core) FROM cores)) AS inner_core, (SELECT count(*) FROM fer WHERE tier IN ('critically_underfunded', 'underfunded')) AS underfunded"))
def a37_headline(m):
    return surfaces.headline(m.criticality, m.concentration, m.cores, m.fer)


# --- gate, orders, narratives ---------------------------------------------------------------------------------------


@query(eco("SELECT node_id, votes, passed, borderline, criticality_passed, maintenance_passed, adoption_passed FROM gate"))
def x3_gate(m):
    return m.gate.select("node_id", "votes", "passed", "borderline", "criticality_passed", "maintenance_passed", "adoption_passed")


@query(eco("SELECT node_id, row_number() OVER (PARTITION BY passed ORDER BY CASE WHEN passed AND NOT borderline THEN 1 ELSE 0 END, criticality_pct DESC, node_id) AS place FROM gate"))
def t1_w10_gate_order(m):
    return surfaces.gate_rank(m.gate).select("node_id", "place")


@query(eco("SELECT node_id, risk FROM debt ORDER BY risk DESC, node_id LIMIT 10"))
def t2_debt_top(m):
    return surfaces.debt_top(m.debt).select("node_id", "risk")


@query(eco("SELECT contributor, kci FROM keystones ORDER BY kci DESC, contributor LIMIT 10"))
def t3_keystone_top(m):
    return surfaces.keystone_top(m.keystones).select("contributor", "kci")


@query(eco("SELECT project, fer FROM fer ORDER BY fer DESC NULLS FIRST, project LIMIT 10"))
def t4_fer_order(m):
    return surfaces.fer_top(m.fer).select("project", "fer")


@query(eco("SELECT node_id, node_type, 'e' || node_id % 7 AS ecosystem, criticality, round(criticality_pct, 4) AS criticality_pct FROM crit JOIN act USING (node_id) WHERE criticality > 0 ORDER BY criticality DESC, node_id LIMIT 10"))
def t5_critical_top(m):
    nodes = m.active_nodes.withColumn("ecosystem", F.concat(F.lit("e"), F.col("node_id") % 7))
    return surfaces.critical_top(m.criticality, nodes, 10).withColumn("criticality_pct", R("criticality_pct", 4))


@query(eco("SELECT node_id, criticality, row_number() OVER (ORDER BY criticality DESC, node_id) AS place FROM crit"))
def t6_critical_order(m):
    return rank.place(m.criticality.select("node_id", "criticality", F.lit(0).alias("g")), "g", [F.col("criticality").desc(), F.col("node_id")], "place").drop("g")


_DECAY = "decay AS (SELECT a.node_id, coalesce(round(s, 3), 0) AS decay_criticality FROM act a LEFT JOIN (SELECT pkg, sum(exp(-coalesce(days, 0) / 30.0)) AS s FROM closure JOIN act d ON d.node_id = dependent AND d.active GROUP BY 1) ON pkg = a.node_id)"


@query(eco(" SELECT node_id, criticality, round(criticality_pct, 4) AS criticality_pct, decay_criticality FROM crit JOIN decay USING (node_id) ORDER BY criticality DESC, node_id LIMIT 20", _DECAY))
def t6_top_with_decay(m):
    best = m.criticality.orderBy(F.desc("criticality"), "node_id").limit(20)
    return m.decay.join(F.broadcast(best), "node_id").select("node_id", "criticality", R("criticality_pct", 4).alias("criticality_pct"), "decay_criticality")  # 20 rows


@query(eco("SELECT repo, top_share FROM conc ORDER BY top_share DESC, repo LIMIT 20"))
def t8_top_share(m):
    return surfaces.top_share_top(m.concentration).select("repo", "top_share")


@query(eco("SELECT repo, hhi FROM conc ORDER BY hhi DESC, repo LIMIT 10"))
def t10_hhi_top(m):
    return surfaces.concentrated_top(m.concentration).select("repo", "hhi")


@query(eco("SELECT project, fer FROM fer WHERE fer > 1.5 ORDER BY fer DESC, project LIMIT 10"))
def t10_underfunded_top(m):
    return surfaces.underfunded_top(m.fer).select("project", "fer")


@query(eco("SELECT node_id, round(adoption_score, 4) AS adoption_score FROM adopt ORDER BY round(adoption_score, 9) DESC, node_id LIMIT 15"))
def t10_adopted_top(m):
    return surfaces.adopted_top(m.adoption).select("node_id", R("adoption_score", 4).alias("adoption_score"))


@query(eco("SELECT project, fer, criticality FROM fer WHERE fer BETWEEN 0.8 AND 1.2 ORDER BY criticality DESC, project LIMIT 5"))
def t10_balanced_top(m):
    return surfaces.balanced_top(m.fer).select("project", "fer", "criticality")


@query(eco("SELECT node_id, criticality FROM crit ORDER BY criticality DESC, node_id LIMIT 8"))
def t10_critical_top(m):
    return rank.leading(m.criticality.select("node_id", "criticality"), "criticality", "node_id", 8)


@query(eco(""" SELECT node_id, a AS criticality_text, b AS maintenance_text, c AS adoption_text, CASE WHEN passed THEN 'Passes' ELSE 'Fails' END || ' with ' || votes || ' of 2 signals needed; ' || a || '; ' || b || '; ' || c || '.' AS explanation FROM texts""", """texts AS (SELECT *,
  'criticality ' || CASE WHEN criticality_passed THEN 'met' ELSE 'missed' END || ': ' || criticality || ' active packages build on it, more than ' || round(criticality_pct)::BIGINT || ' % of all packages have (50 % asked)' AS a,
  CASE WHEN maintenance_passed THEN 'maintenance met: HHI ' || round(hhi)::BIGINT || ' (under 2500 asked)' ELSE 'maintenance missed: ' || top_contributor || ' made ' || round(top_share * 100)::BIGINT || ' % of the commits, HHI ' || round(hhi)::BIGINT || ' (under 2500 asked)' END AS b,
  'adoption ' || CASE WHEN adoption_passed THEN 'met' ELSE 'missed' END || ': mean rank of downloads, stars and forks ' || round(adoption_score)::BIGINT || ' of 100 (40 asked)' AS c FROM gate)"""))
def n1_gate_narratives(m):
    return m.gate.select("node_id", "criticality_text", "maintenance_text", "adoption_text", "explanation")


@query(eco(""" SELECT project, CASE tier WHEN 'unfunded' THEN 'No funding to compare with; criticality rank ' || round(crit_pct)::BIGINT || '.' WHEN 'critically_underfunded' THEN 'Far too little money for what depends on it: ' || places || '.'
  WHEN 'underfunded' THEN 'Less money than its importance suggests: ' || places || '.' WHEN 'balanced' THEN 'Money and importance agree: ' || places || '.' WHEN 'overfunded' THEN 'More money than its importance suggests: ' || places || '.'
  ELSE 'Much more money than its importance suggests: ' || places || '.' END AS narrative FROM p""", "p AS (SELECT *, 'criticality rank ' || round(crit_pct)::BIGINT || ', funding rank ' || round(fund_pct)::BIGINT || ', ratio ' || printf('%.2f', round(fer::DECIMAL(18, 4), 2)::DOUBLE) AS places FROM fer)"))
def n2_funding_narratives(m):
    return m.fer.select("project", "narrative")


@query(eco("""SELECT project AS subject, project || ': ' || criticality || ' dependents (rank ' || round(criticality_pct)::BIGINT || '), ' || trend || ' for ' || days || ' days; ' || top_contributor || ' made ' || round(top_share * 100)::BIGINT || ' % of the commits (HHI ' || round(hhi)::BIGINT || ', ' || hhi_tier || ').' AS narrative FROM debt
  UNION ALL SELECT contributor::VARCHAR, 'Without ' || contributor || ', ' || n_repos || ' packages of ' || n_projects || ' projects lose their main maintainer (score ' || kci || '); ' || at_risk || ' packages lie downstream.' FROM keystones"""))
def n3_surface_narratives(m):
    return m.debt.select(F.col("project").alias("subject"), "narrative").unionAll(m.keystones.select(F.col("contributor").cast("string"), "narrative"))


@query(eco("SELECT node_id, CASE WHEN days < 14 THEN 'active' WHEN days < 45 THEN 'stable' WHEN days < 89 THEN 'stagnant' ELSE 'declining' END AS trend FROM nodes"))
def p12_commit_trend(m):
    return m.nodes.select("node_id", tiers.commit_trend(F.col("days_since_commit")).alias("trend"))


@query(eco("SELECT a.node_id, round(greatest(5, least(40, 5 + ln(1 + criticality) * 8)), 4) AS size, coalesce(core, 0) AS color, coalesce(pony_factor = 1, false) AS risk_border FROM crit a LEFT JOIN conc ON repo = node_id LEFT JOIN cores c ON c.node_id = a.node_id"))
def p20_node_encodings(m):
    return surfaces.node_encodings(m.criticality, m.cores, m.concentration).withColumn("size", R("size", 4))


_PAGE_URL = "regexp_replace(url, '^https?://[^/]+', CASE WHEN page_id % 5 = 0 THEN 'https://other.org' WHEN page_id % 2 = 0 THEN 'HTTP://GitHub.com' ELSE 'https://github.com' END) || CASE WHEN page_id % 3 = 0 THEN '/' WHEN page_id % 3 = 1 THEN '.git' ELSE '' END"


def _page_urls(m):
    """The pages' paths behind two hosts, with and without what is to be cut off."""
    host = F.when(F.col("page_id") % 5 == 0, "https://other.org").when(F.col("page_id") % 2 == 0, "HTTP://GitHub.com").otherwise("https://github.com")
    tail = F.when(F.col("page_id") % 3 == 0, "/").when(F.col("page_id") % 3 == 1, ".git").otherwise("")
    return m.table("pages").select("page_id", F.concat(F.regexp_replace("url", F.lit("^https?://[^/]+"), host), tail).alias("u"))


@query(f"WITH t AS (SELECT page_id, {_PAGE_URL} AS u FROM pages), c AS (SELECT *, regexp_replace(regexp_replace(trim(u), '/+$', ''), '\\.git$', '') AS x FROM t) SELECT page_id, nullif(regexp_extract(x, '(?i)^https?://github\\.com/([^/]+/[^/]+)$', 1), '') AS path, CASE WHEN u LIKE '%github.com/%' THEN split_part(regexp_replace(u, '/+$', ''), '/', -1) ELSE u END AS short FROM c")
def p5_p7_url_paths(m):
    return _page_urls(m).select("page_id", names.github_path(F.col("u")).alias("path"), names.short_name(F.col("u")).alias("short"))


@query(f"WITH t AS (SELECT page_id, {_PAGE_URL} AS u FROM pages), c AS (SELECT *, CASE WHEN u LIKE '%github.com/%' THEN regexp_replace(regexp_replace(split_part(u, 'github.com/', -1), '^/+', ''), '/+$', '') ELSE u END AS path FROM t) SELECT page_id, path, CASE WHEN path LIKE 'http%' THEN path WHEN path LIKE '%/%' THEN 'https://github.com/' || path ELSE path END AS url FROM c")
def p6_host_paths(m):
    path = names.host_path(F.col("u"), "github.com")
    return _page_urls(m).select("page_id", path.alias("path"), names.as_url(path).alias("url"))


@query("SELECT page_id, CASE WHEN page_id % 4 IN (0, 1) THEN 'NPM' WHEN page_id % 4 = 2 THEN 'GITHUB' ELSE 'PYPI' END AS ecosystem FROM pages")
def p14_ecosystem(m):
    heads = F.element_at(F.array(*[F.lit(x) for x in ("@scope/", "client-kit-", "https://github.com/o/", "see github.com/")]), (F.col("page_id") % 4 + 1).cast("int"))
    return m.table("pages").select("page_id", tiers.ecosystem_of(F.concat(heads, "url"), ("@", "client-kit")).alias("ecosystem"))


def _seeds(m):
    """Parts as project rows."""
    url = F.when(F.col("p_size") > 10, F.concat(F.lit("https://github.com/"), "p_brand", F.lit("/"), F.col("p_partkey")))
    return m.table("part").select(F.col("p_name").alias("title"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("category"), F.when(F.col("p_size") % 2 == 0, "Live").otherwise("Expired").alias("integration_status"), (F.col("p_partkey") % 3 == 0).cast("string").alias("open_source"), url.alias("github_url"))


@query("SELECT p_partkey AS ord, p_type AS category FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size % 2 = 0 AND p_partkey % 3 = 0 AND p_size > 10")
def p21_seeds(m):
    return tables.seed_projects(_seeds(m), ["ECONOMY", "PROMO"], ["Live"], "open_source = 'true'").select("ord", "category")


@query("SELECT p_partkey AS ord, p_type AS category FROM part WHERE p_size % 2 = 0 AND p_size > 10")
def p21_all_active(m):
    return tables.seed_projects(_seeds(m), None, ["Live"]).select("ord", "category")


@query("SELECT p_brand AS github_org, count(*) AS project_count FROM part WHERE p_size > 10 GROUP BY 1")
def p21_seed_orgs(m):
    return tables.org_counts(_seeds(m))


@query("SELECT user_id AS repo, bool_or(event_type <> 'error') AS accessible, CASE WHEN max(ts) FILTER (event_type <> 'error') IS NULL THEN 9999 ELSE date_diff('day', max(ts) FILTER (event_type <> 'error')::DATE, (SELECT max(ts)::DATE FROM events)) END AS days FROM events GROUP BY 1")
def p19_activity(m):
    e, day = _readings(m)
    return ingest.accessible_activity(e, day).select("repo", "accessible", F.col("days_since_commit").alias("days"))


def _readings(m):
    """Events as readings of a user's repository; errors are failed ones."""
    e = m.table("events")
    day = F.lit(e.agg(F.to_date(F.max("ts"))).first()[0])
    return e.select(F.col("user_id").alias("repo"), F.col("props").alias("contributor"), F.when(F.col("event_type") != "error", F.col("ts")).alias("committed_at"), (F.col("event_type") != "error").alias("accessible")), day


@query("SELECT user_id AS repo, props AS contributor, count(*) AS commits FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def p19_edges(m):
    return ingest.accessible_edges(_readings(m)[0])


# --- snapshots ------------------------------------------------------------------------------------------------------

_ROUNDS = """
rounds AS (SELECT date_trunc('quarter', o_orderdate)::DATE AS snapshot_date, CASE WHEN quarter(date_trunc('quarter', o_orderdate)) <> 1 THEN 'Q' || quarter(date_trunc('quarter', o_orderdate)) || ' ' || year(date_trunc('quarter', o_orderdate)) END AS label,
  count(DISTINCT o_custkey) AS active_repos, round(avg(o_totalprice) / 100, 1) AS mean_hhi, round(min(o_totalprice) / 100, 1) AS median_hhi, round(avg((o_orderstatus = 'O')::INT), 4) AS gate_pass_rate,
  round(avg((o_orderpriority LIKE '1%')::INT), 4) AS pony_rate, count(*) FILTER (o_totalprice > 300000) AS debt_size, count(*) FILTER (o_totalprice < 20000) AS keystone_count, count(*) FILTER (o_totalprice < 50000) AS bridge_edges,
  count(*) FILTER (o_orderstatus = 'P') AS borderline, count(DISTINCT o_custkey % 100) AS projects, count(*) AS dependency_edges
  FROM orders GROUP BY date_trunc('quarter', o_orderdate))"""


def _rounds(m):
    """A snapshot for each quarter of the orders; first quarters have no label."""
    q = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    o = m.table("orders").withColumn("snapshot_date", q)
    price, n_if = F.col("o_totalprice"), lambda c, name: F.count_if(c).alias(name)
    g = o.groupBy("snapshot_date").agg(
        F.count_distinct("o_custkey").alias("active_repos"), R(F.avg(price) / 100, 1).alias("mean_hhi"), R(F.min(price) / 100, 1).alias("median_hhi"), R(F.avg((F.col("o_orderstatus") == "O").cast("int")), 4).alias("gate_pass_rate"),
        R(F.avg(F.col("o_orderpriority").startswith("1").cast("int")), 4).alias("pony_rate"), n_if(price > 300000, "debt_size"), n_if(price < 20000, "keystone_count"), n_if(price < 50000, "bridge_edges"),
        n_if(F.col("o_orderstatus") == "P", "borderline"), F.count_distinct(F.col("o_custkey") % 100).alias("projects"), F.count(F.lit(1)).alias("dependency_edges"),
    )
    quarter = F.quarter("snapshot_date")
    return g.withColumn("label", F.when(quarter != 1, F.concat(F.lit("Q"), quarter, F.lit(" "), F.year("snapshot_date"))))


_METRICS = snapshots.METRICS
_DELTA = "delta AS (SELECT * FROM (SELECT lag(snapshot_date) OVER w AS earlier, snapshot_date AS later, lag(coalesce(label, snapshot_date::VARCHAR)) OVER w AS earlier_label, coalesce(label, snapshot_date::VARCHAR) AS later_label, " + ", ".join(f"round({m} - lag({m}) OVER w, 6) AS {m}_delta" for m in _METRICS) + " FROM rounds WINDOW w AS (ORDER BY snapshot_date)) WHERE earlier IS NOT NULL)"


def _delta(m):
    return snapshots.deltas(_rounds(m))


@query("WITH" + _ROUNDS + ", " + _DELTA + " SELECT * FROM delta")
def c1_j13_w9_deltas(m):
    return _delta(m).select("earlier", "later", "earlier_label", "later_label", *[R(f"{x}_delta", 6).alias(f"{x}_delta") for x in _METRICS])


def _moved(x, up, down, by):
    return f"CASE WHEN {x}_delta > 0 THEN '{up} up by ' || {by} WHEN {x}_delta < 0 THEN '{down} down by ' || {by} END"


_POINTS = "printf('%.1f', round(100 * abs({}_delta)::DECIMAL(18, 6), 1)::DOUBLE) || ' points'"
_N4 = f"""SELECT later, earlier_label || ' to ' || later_label || ': ' || concat_ws(', ', coalesce({_moved("gate_pass_rate", "gate passes", "gate passes", _POINTS.format("gate_pass_rate"))}, 'gate passes as before'),
  {_moved("mean_hhi", "concentration", "concentration", "round(abs(mean_hhi_delta))::BIGINT")}, {_moved("pony_rate", "flagged repositories", "flagged repositories", _POINTS.format("pony_rate"))},
  {_moved("debt_size", "debt entries", "debt entries", "abs(debt_size_delta)::BIGINT")}) || '.' AS narrative FROM delta"""


@query("WITH" + _ROUNDS + ", " + _DELTA + " " + _N4)
def n4_comparison_narratives(m):
    return _delta(m).select("later", "narrative")


_UP = "(pony_rate_delta < -0.01)::INT + (mean_hhi_delta < -50)::INT + (gate_pass_rate_delta > 0.01)::INT + (debt_size_delta < 0)::INT + (keystone_count_delta < 0)::INT"
_DOWN = "(pony_rate_delta > 0.01)::INT + (mean_hhi_delta > 50)::INT + (gate_pass_rate_delta < -0.01)::INT + (debt_size_delta > 0)::INT + (keystone_count_delta > 0)::INT"


@query("WITH" + _ROUNDS + ", " + _DELTA + f" SELECT later, {_UP} AS n_improved, {_DOWN} AS n_degraded, CASE WHEN {_UP} > {_DOWN} THEN 'improving' WHEN {_DOWN} > {_UP} THEN 'degrading' ELSE 'stable' END AS trend FROM delta")
def c2_trend(m):
    return snapshots.trend(_delta(m)).select("later", F.size("improved").alias("n_improved"), F.size("degraded").alias("n_degraded"), "trend")


def _c3(metric, low):
    up, down = ("worsening", "improving") if low else ("improving", "worsening")
    return f"SELECT earlier, later, '{metric}' AS metric, {metric}_before::DOUBLE AS before, {metric}_after::DOUBLE AS after, {metric}_delta::DOUBLE AS delta, CASE WHEN {metric}_delta = 0 THEN '--' WHEN {metric}_delta > 0 THEN '↑ ({up})' ELSE '↓ ({down})' END AS direction FROM delta"


_VALUES = "SELECT *, " + ", ".join(f"lag({m}) OVER w AS {m}_before, {m} AS {m}_after, round({m} - lag({m}) OVER w, 6) AS {m}_delta" for m, _ in snapshots.COMPARED) + ", lag(snapshot_date) OVER w AS earlier, snapshot_date AS later FROM rounds WINDOW w AS (ORDER BY snapshot_date)"


@query("WITH" + _ROUNDS + f", delta AS (SELECT * FROM ({_VALUES}) WHERE earlier IS NOT NULL) " + " UNION ALL ".join(_c3(*x) for x in snapshots.COMPARED))
def c3_comparison_table(m):
    return snapshots.comparison_table(_rounds(m)).select("earlier", "later", "metric", "before", "after", "delta", "direction")


@query("WITH" + _ROUNDS + " SELECT snapshot_date, gate_pass_rate, pony_rate, mean_hhi FROM rounds")
def c4_trend_series(m):
    return snapshots.trend_series(_rounds(m))


@query(eco("SELECT node_id, criticality, hhi FROM gate WHERE NOT passed ORDER BY criticality_pct DESC, node_id LIMIT 10"))
def c5_failed_top(m):
    return m.gate.filter("NOT passed").orderBy(F.desc("criticality_pct"), "node_id").limit(10).select("node_id", "criticality", "hhi")


@query(eco("SELECT node_id, criticality, hhi FROM gate WHERE borderline ORDER BY criticality_pct DESC, node_id LIMIT 10"))
def c5_borderline_top(m):
    return m.gate.filter("borderline").orderBy(F.desc("criticality_pct"), "node_id").limit(10).select("node_id", "criticality", "hhi")


@query(eco("SELECT node_id, criticality, round(criticality_pct, 4) AS criticality_pct, hhi, top_contributor::VARCHAR AS top_contributor, top_share, round(adoption_score, 4) AS adoption_score, votes, passed, borderline FROM gate"))
def c5_gate_table(m):
    return m.gate.select("node_id", "criticality", R("criticality_pct", 4).alias("criticality_pct"), "hhi", "top_contributor", "top_share", R("adoption_score", 4).alias("adoption_score"), "votes", "passed", "borderline")


_PAIRS = " UNION ALL ".join(f"SELECT '{k}' AS metric, printf('%.{digits}f', round({k}::DOUBLE * {100 if share else 1}, {digits})){" || '%'" if share else ''} AS value FROM s" for k, (digits, share) in snapshots.DASHBOARD.items())


@query(eco(" " + _PAIRS, "s AS (" + _SNAPSHOT + ")"))
def c5_dashboard(m):
    return snapshots.dashboard(m.snapshot)


# --- payloads, made from the events table ---------------------------------------------------------------------------


#: Events of one landed page, about.
PAGE = 100


def _pages(m, key="user_id"):
    """events with `page`: a key's events come in as many pages of about PAGE as it has, as an API lists them."""
    e = m.table("events")
    pages = e.groupBy(F.col(key).alias("_k")).agg(F.ceil(F.count(F.lit(1)) / PAGE).alias("_pages"))
    return e.join(pages, F.col(key) == F.col("_k")).withColumn("page", F.pmod(F.xxhash64("event_id"), F.col("_pages"))).drop("_k", "_pages")


def _payload(m, key, column):
    return _pages(m, key).groupBy(key, "page").agg(F.to_json(F.array_sort(F.collect_list(column))).alias("payload"))


@query("SELECT user_id AS repo, CASE WHEN event_type = 'error' THEN 'unknown_' || event_type || '@unknown' ELSE event_type || '@x.org' END AS email, CASE WHEN event_id % 2 = 0 THEN 'login' || event_id ELSE event_type END AS name, date_trunc('second', ts) AS committed_at FROM events")
def s13_commit_payload(m):
    author = F.struct(F.col("event_type").alias("name"), F.when(F.col("event_type") != "error", F.concat(F.lit(" "), F.initcap("event_type"), F.lit("@X.org "))).alias("email"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    c = F.struct(F.struct(author.alias("author")).alias("commit"), F.struct(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("login"), "event_id")).alias("login")).alias("author"))
    return payloads.commits(_payload(m, "user_id", c).withColumnRenamed("user_id", "repo")).select("repo", "email", "name", F.col("committed_at").cast("timestamp_ntz").alias("committed_at"))


@query(ORACLE_SQL["s13_commit_payload"])
def s13_streamed_commits(m):
    """The pages of s13 as landed files: taken in by two calls, the second of which replaces pages that were wrong at first."""
    author = F.struct(F.col("event_type").alias("name"), F.when(F.col("event_type") != "error", F.concat(F.lit(" "), F.initcap("event_type"), F.lit("@X.org "))).alias("email"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    c = F.struct(F.struct(author.alias("author")).alias("commit"), F.struct(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("login"), "event_id")).alias("login")).alias("author"))
    pages = _payload(m, "user_id", c).select(F.concat_ws("/", "user_id", "page").alias("id"), F.lit(1).cast("long").alias("landed"), "payload")
    folder = f"{shared_dir(m.spark)}/landing-{uuid.uuid4().hex}"
    odd = F.pmod(F.xxhash64("id"), F.lit(3))
    pages.filter(odd != 0).withColumn("payload", F.when(odd == 1, F.lit("[]")).otherwise(F.col("payload"))).write.json(f"{folder}/files/first")
    landing.land(m.spark, f"{folder}/files/*", f"{folder}/taken")
    pages.filter(odd < 2).withColumn("landed", F.lit(2).cast("long")).write.json(f"{folder}/files/second")
    landing.land(m.spark, f"{folder}/files/*", f"{folder}/taken")
    now = landing.landed(m.spark, f"{folder}/taken").withColumn("repo", F.split("id", "/")[0].cast("long"))
    return payloads.commits(now).select("repo", "email", "name", F.col("committed_at").cast("timestamp_ntz").alias("committed_at"))


@query("SELECT DISTINCT 'u' || user_id AS from_name, event_type AS to_name, 'NPM' AS ecosystem, true AS is_direct FROM events")
def s14_dependency_payload(m):
    return payloads.dependency_edges(_dependency_pages(m, "NPM")).select("from_name", "to_name", "ecosystem", "is_direct")


@query("""WITH t AS (SELECT DISTINCT user_id, event_type FROM events), c AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_type) AS prev FROM t)
  SELECT coalesce(prev, 'u' || user_id) AS from_name, event_type AS to_name, 'NPM' AS ecosystem, prev IS NULL AS is_direct FROM c""")
def s14_indirect_edges(m):
    """A user's event types as a chain: it depends on the first, the first on the second and so on."""
    return payloads.dependency_edges(_dependency_pages(m, "NPM", chain=True)).select("from_name", "to_name", "ecosystem", "is_direct")


def _dependency_pages(m, system, chain=False):
    """A user's event types as its dependencies."""
    node = lambda n: F.struct(F.struct(F.lit(system).alias("system"), n.alias("name"), F.lit("1").alias("version")).alias("versionKey"))
    g = m.table("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    nodes = F.concat(F.array(node(F.concat(F.lit("u"), "user_id"))), F.transform("types", node))
    edges = F.transform(F.sequence(F.lit(1), F.size("types")), lambda i: F.struct((i - 1 if chain else F.lit(0)).alias("fromNode"), i.alias("toNode"), F.lit("^1").alias("requirement")))
    return g.select(F.to_json(F.struct(nodes.alias("nodes"), edges.alias("edges"))).alias("payload"))


@query("SELECT 'p' || event_id AS name, '1.' || user_id AS version, 'MIT, ' || event_type AS licences, CASE WHEN event_id % 3 = 0 THEN 'https://home/' || event_id ELSE 'https://src/' || event_id END AS source_url, 'pkg:cargo/p' || event_id || '@1.' || user_id AS purl FROM events")
def s15_version_payload(m):
    link = lambda a, b: F.struct(F.lit(a).alias("label"), b.alias("url"))
    other, src, home = link("DOCS", F.lit("x")), link("SOURCE_REPO", F.concat(F.lit("https://src/"), "event_id")), link("HOME_PAGE", F.concat(F.lit("https://home/"), "event_id"))
    key = F.struct(F.lit("CARGO").alias("system"), F.concat(F.lit("p"), "event_id").alias("name"), F.concat(F.lit("1."), "user_id").alias("version"))
    links = F.when(F.col("event_id") % 3 == 0, F.array(other, home, src)).otherwise(F.array(other, src, home))
    p = F.to_json(F.struct(key.alias("versionKey"), F.array(F.lit("MIT"), F.col("event_type")).alias("licenses"), links.alias("links")))
    return payloads.version_metadata(m.table("events").select(p.alias("payload")))


@query("SELECT 'github.com/u/' || event_id AS id, user_id AS stars, event_id AS forks, (event_id % 7)::BIGINT AS issues, CASE WHEN event_id % 2 = 0 THEN (event_id % 11)::INT END AS maintained, CASE WHEN event_id % 2 = 0 THEN 'r' END AS reason FROM events")
def s16_project_payload(m):
    e = m.table("events")
    check = lambda n, s: F.struct(F.lit(n).alias("name"), s.cast("int").alias("score"), F.lit("r").alias("reason"))
    checks = F.when(F.col("event_id") % 2 == 0, F.array(check("License", F.lit(10)), check("Maintained", F.col("event_id") % 11), check("Maintained", F.lit(99)))).otherwise(F.array(check("License", F.lit(10))))
    p = F.to_json(F.struct(F.struct(F.concat(F.lit("github.com/u/"), "event_id").alias("id")).alias("projectKey"), F.col("user_id").alias("starsCount"), F.col("event_id").alias("forksCount"), (F.col("event_id") % 7).alias("openIssuesCount"), F.struct(checks.alias("checks")).alias("scorecard")))
    return payloads.project_enrichment(e.select(p.alias("payload")))


@query("SELECT user_id AS package, CASE WHEN event_id % 4 = 0 THEN 'fallback' || event_id ELSE event_type END AS dependent FROM events")
def s17_reverse_payload(m):
    dep = F.struct(F.col("event_id").alias("id"), F.col("event_id").alias("version_id"), F.concat(F.lit("fallback"), "event_id").alias("crate_id"), F.lit("^1").alias("req"))
    ver = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("crate"), F.lit("1").alias("num"))
    g = _pages(m).groupBy(F.col("user_id").alias("package"), "page").agg(F.collect_list(dep).alias("d"), F.collect_list(F.when(F.col("event_id") % 4 != 0, ver)).alias("v"))
    return payloads.reverse_dependencies(g.select("package", F.to_json(F.struct(F.col("d").alias("dependencies"), F.col("v").alias("versions"))).alias("payload"))).select("package", "dependent")


@query("SELECT 'c' || event_id AS name, user_id * 10 AS downloads, user_id AS recent, CASE WHEN event_id = 1 THEN 'https://known' WHEN event_id % 2 = 0 THEN 'https://github.com/o/' || event_id END AS repository FROM events")
def s18_package_payload(m):
    url = F.concat(F.when(F.col("event_id") % 2 == 0, "https://github.com/o/").otherwise("https://other.org/o/"), F.col("event_id"), F.lit("/"))
    c = F.struct(F.concat(F.lit("c"), "event_id").alias("id"), (F.col("user_id") * 10).alias("downloads"), F.col("user_id").alias("recent_downloads"), url.alias("repository"))
    return payloads.package_stats(m.table("events").select(F.to_json(F.struct(c.alias("crate"))).alias("payload")), {"c1": "https://known"})


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN nullif(2 * user_id, 0) ELSE user_id END AS downloads FROM events")
def s19_download_payload(m):
    e, n = m.table("events"), F.col("user_id").alias("downloads")
    a, b = F.to_json(F.struct(n)), F.to_json(F.struct(F.struct(F.col("user_id").alias("last_month")).alias("data")))
    c = F.to_json(F.struct(F.array(F.struct(n), F.struct(n)).alias("data")))
    p = F.when(F.col("event_id") % 3 == 0, a).when(F.col("event_id") % 3 == 1, b).otherwise(c)
    return e.select("event_id", payloads.downloads(p).alias("downloads"))


@query("SELECT event_type || event_id AS title, round(value, 2) AS amount FROM events")
def s20_grant_payload(m):
    g = F.array(F.struct(F.concat("event_type", "event_id").alias("title"), F.col("value").alias("amount")))
    p = F.when(F.col("event_id") % 2 == 0, F.to_json(g)).otherwise(F.to_json(F.struct(g.alias("applications"))))
    return payloads.grants(m.table("events").select(p.alias("payload"))).select("title", R("amount", 2).alias("amount"))


# --- scans over text columns of the tables --------------------------------------------------------------------------


@query("SELECT trim(p_name) AS title, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_retailprice END AS total_awarded_usd FROM part")
def s1_projects(m):
    p = m.table("part").select(F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("title"), F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("total_awarded_usd"))
    return tables.projects(p)


@query("SELECT 'https://github.com/' || p_brand AS github_url, min(p_partkey) AS ord FROM part WHERE p_size > 5 GROUP BY 1")
def s2_repos(m):
    url = F.when(F.col("p_size") > 5, F.concat(F.lit("https://github.com/"), "p_brand")).when(F.col("p_size") > 2, "nan")
    p = m.table("part").select(url.alias("github_url"), F.col("p_retailprice").cast("string").alias("total_awarded_usd"), F.col("p_partkey").alias("ord"))
    return tables.repos(p).select("github_url", "ord")


@query("SELECT n_name AS github_org, n_regionkey::BIGINT AS project_count FROM nation")
def s3_orgs(m):
    return tables.orgs(m.table("nation").select(F.col("n_name").alias("github_org"), F.col("n_regionkey").cast("string").alias("project_count")))


@query("SELECT 's' || l_suppkey AS contributor, 'https://github.com/o/p' || l_partkey AS repo, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber END::BIGINT AS commits FROM lineitem")
def s4_contributions(m):
    raw = m.table("lineitem").select(F.concat(F.lit("o/p"), "l_partkey").alias("repo_full_name"), F.concat(F.lit("s"), "l_suppkey").alias("contributor_login"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("string")).alias("commits_90d"), F.lit(0).alias("ord"))
    return tables.contributions(raw).drop("ord")


@query("SELECT l_partkey::VARCHAR AS from_repo, l_suppkey::VARCHAR AS to_package, l_returnflag = 'R' AS is_direct FROM lineitem")
def s5_dependencies(m):
    raw = m.table("lineitem").select(F.col("l_partkey").cast("string").alias("from_repo"), F.col("l_suppkey").cast("string").alias("to_package"), F.lit("NPM").alias("ecosystem"), F.when(F.col("l_returnflag") == "R", "True").otherwise("no").alias("is_direct"), F.lit(0).alias("ord"))
    return tables.dependencies(raw).select("from_repo", "to_package", "is_direct")


@query("SELECT CASE WHEN user_id % 2 = 0 THEN 'https://github.com/o/u' || user_id ELSE 'http://x/' || user_id END AS node_id, (array_agg(event_id ORDER BY event_id DESC))[1] AS downloads, 0::BIGINT AS stars FROM events GROUP BY user_id")
def s6_adoption(m):
    name = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("o/u"), "user_id")).otherwise(F.concat(F.lit("http://x/"), "user_id"))
    raw = m.table("events").select(name.alias("repo_full_name"), F.lit("NPM").alias("ecosystem"), F.col("event_id").cast("string").alias("monthly_downloads"), F.lit(None).cast("string").alias("github_stars"), F.lit("").alias("github_forks"), F.col("event_id").alias("ord"))
    return tables.adoption(raw).select("node_id", "downloads", "stars")


@query("SELECT DISTINCT 'r' || user_id AS repo, user_id::INT AS days_since_commit FROM events")
def s7_activity(m):
    """The cache comes in lines of about PAGE repositories each."""
    users = m.table("events").select("user_id").distinct()
    lines = max(1, users.count() // PAGE)
    entry = F.struct(F.concat(F.lit("r"), "user_id"), F.struct(F.col("user_id").alias("days_since_commit")))
    g = users.groupBy(F.pmod(F.xxhash64("user_id"), F.lit(lines)).alias("k")).agg(F.map_from_entries(F.collect_list(entry)).alias("x"))
    return tables.activity(g.select(F.to_json("x").alias("value"))).select("repo", "days_since_commit")


@query("SELECT DISTINCT trim(url) AS url FROM pages")
def s8_url_list(m):
    return tables.url_list(m.table("pages").select(F.concat(F.lit(" "), "url").alias("repo_url")))


@query(eco("SELECT user_id AS asked, g.node_id, passed, votes FROM (SELECT DISTINCT user_id FROM events) JOIN gate g ON g.node_id = user_id"))
def x6_gate_lookup(m):
    """The service's lookup, of all projects that the events' users ask for."""
    return surfaces.gate_lookup(m.gate, m.table("events").select(F.col("user_id").alias("asked"))).select("asked", "node_id", "passed", "votes")


@query(eco("""SELECT 'criticality' AS metric, node_id::VARCHAR AS name, criticality::DOUBLE AS value FROM crit UNION ALL SELECT 'hhi', repo::VARCHAR, hhi FROM conc UNION ALL SELECT 'adoption', node_id::VARCHAR, round(adoption_score, 4) FROM adopt
  UNION ALL SELECT 'kci', contributor::VARCHAR, kci FROM keystones UNION ALL SELECT 'fer', project, fer FROM fer UNION ALL SELECT 'risk', node_id::VARCHAR, risk FROM debt"""))
def x6_metric_listing(m):
    return surfaces.metric_listing(m.criticality, m.concentration, m.adoption, m.keystones, m.fer, m.debt).withColumn("value", R("value", 4))


# --- composites over tables of one's own: customers' repositories, the parts they use, suppliers who contribute -----


def _seed_tables(m):
    """Nations as projects, customers as repositories submitted under their nation's name in small letters."""
    n, c = m.table("nation"), m.table("customer")
    projects = n.select(F.concat(F.col("n_name"), F.lit(" ")).alias("title"), (1000 * F.col("n_nationkey")).cast("string").alias("total_awarded_usd"), F.col("n_nationkey").alias("ord"))
    repos = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("https://github.com/c/"), "c_custkey").alias("github_url"), F.when(F.col("c_mktsegment") == "BUILDING", "nan").otherwise(F.lower("n_name")).alias("submission_title"), F.lit("1.5").alias("total_awarded_usd"), F.col("c_custkey").alias("ord"))  # 25 nations
    return tables.projects(projects), tables.repos(repos)


_X1 = "x1 AS (SELECT n_name AS node_id, 'Project' AS node_type, NULL AS project, 1000.0 * n_nationkey AS funding FROM nation UNION ALL SELECT 'https://github.com/c/' || c_custkey, 'Repo', CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE n_name END, 1.5 FROM customer JOIN nation ON n_nationkey = c_nationkey)"


@query(f"WITH {_X1} SELECT node_id, node_type, project, funding::DOUBLE AS funding FROM x1")
def x1_graph_nodes(m):
    return build.build_graph(*_seed_tables(m)).nodes.select("node_id", "node_type", "project", "funding")


@query(f"WITH {_X1} SELECT node_id AS src, project AS dst, 'belongs_to' AS edge_type FROM x1 WHERE project IS NOT NULL")
def x1_graph_edges(m):
    return build.build_graph(*_seed_tables(m)).edges.select("src", "dst", "edge_type")


@query("""SELECT 'https://github.com/c/' || c_custkey AS src, CASE c_mktsegment WHEN 'FURNITURE' THEN 'NATION_0' ELSE n_name END AS dst, 'belongs_to' AS edge_type
  FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""")
def x1_near_titles(m):
    """Titles with another letter, titles that are as near to several projects (the first of them counts) and titles under the cutoff."""
    n, c = m.table("nation"), m.table("customer")
    segment, name = F.col("c_mktsegment"), F.lower("n_name")
    title = F.when(segment == "BUILDING", "nan").when(segment == "AUTOMOBILE", F.replace(name, F.lit("_"), F.lit(" "))).when(segment == "FURNITURE", "nation_").when(segment == "MACHINERY", F.concat(F.lit("zq "), "n_nationkey")).otherwise(F.initcap("n_name"))
    repos = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("https://github.com/c/"), "c_custkey").alias("github_url"), title.alias("submission_title"), F.lit("1.5").alias("total_awarded_usd"), F.col("c_custkey").alias("ord"))  # 25 nations
    return build.build_graph(_seed_tables(m)[0], tables.repos(repos), m.config).edges.select("src", "dst", "edge_type")


def _enriched(m):
    o, li = m.table("orders"), m.table("lineitem")
    url = F.concat(F.lit("https://github.com/c/"), "o_custkey")
    used = cut(li.join(apart(o.select("o_orderkey", "o_custkey")), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))  # read for dependencies and for contributions
    deps = used.select(url.alias("from_repo"), F.concat(F.lit("part-"), "l_partkey").alias("to_package"), F.lit("NPM").alias("ecosystem"), F.col("l_orderkey").alias("ord"))
    people = used.select(F.concat(F.lit("dev-"), "l_suppkey").alias("contributor"), url.alias("repo"), F.col("l_linenumber").cast("long").alias("commits"), F.col("l_orderkey").alias("ord"))
    sums = o.groupBy(url.alias("node_id")).agg(F.count(F.lit(1)).alias("stars"), F.count_distinct("o_orderpriority").alias("forks"), F.sum(F.floor("o_totalprice")).cast("long").alias("downloads"), F.max("o_orderdate").alias("last"))
    day = F.lit(o.agg(F.to_date(F.max("o_orderdate"))).first()[0])
    activity = sums.select(F.col("node_id").alias("repo"), F.datediff(day, F.to_date("last")).cast("long").alias("days_since_commit"), (F.col("forks") < 3).alias("archived"))
    return build.enrich_graph(build.build_graph(*_seed_tables(m)), deps, people, sums.select("node_id", "downloads", "stars", "forks"), activity, m.config)


_X2 = _X1 + """, used AS (SELECT 'https://github.com/c/' || o_custkey AS url, l_partkey, l_suppkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
sums AS (SELECT 'https://github.com/c/' || o_custkey AS url, count(*) AS stars, count(DISTINCT o_orderpriority) AS forks, sum(floor(o_totalprice))::BIGINT AS downloads, date_diff('day', max(o_orderdate)::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) AS days FROM orders GROUP BY 1),
x2 AS (SELECT node_id, node_type, project, days, forks < 3 AS archived, CASE WHEN days IS NOT NULL THEN days <= 90 AND forks >= 3 END AS active, stars, forks, downloads FROM x1 LEFT JOIN sums ON url = node_id
  UNION ALL SELECT DISTINCT 'part-' || l_partkey, 'ExternalRepo', NULL, NULL::BIGINT, NULL::BOOLEAN, NULL::BOOLEAN, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM used
  UNION ALL SELECT DISTINCT 'dev-' || l_suppkey, 'Contributor', NULL, NULL::BIGINT, NULL::BOOLEAN, true, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM used)"""


@query(f"WITH {_X2} SELECT node_id, node_type, project, days AS days_since_commit, archived, active, stars, forks, downloads FROM x2")
def x2_enriched_nodes(m):
    return _enriched(m).nodes.select("node_id", "node_type", "project", "days_since_commit", "archived", "active", "stars", "forks", "downloads")


@query(f"WITH {_X2} SELECT edge_type, src, dst FROM (SELECT 'belongs_to' AS edge_type, node_id AS src, project AS dst FROM x1 WHERE project IS NOT NULL UNION SELECT 'depends_on', url, 'part-' || l_partkey FROM used UNION SELECT 'contributed_to', 'dev-' || l_suppkey, url FROM used)")
def x2_enriched_edges(m):
    return _enriched(m).edges.select("edge_type", "src", "dst")


_X4 = _X2 + """, ret AS (SELECT * FROM x2 WHERE node_type NOT IN ('Repo', 'ExternalRepo') OR CASE WHEN days IS NULL THEN node_type = 'ExternalRepo' ELSE days <= 90 AND NOT archived END),
dep AS (SELECT DISTINCT url AS src, 'part-' || l_partkey AS dst FROM used JOIN ret ON node_id = url),
cr AS (SELECT node_id, count(src) FILTER (EXISTS (SELECT 1 FROM ret r WHERE r.node_id = src AND r.active)) AS criticality FROM ret LEFT JOIN dep ON dst = node_id WHERE node_type IN ('Repo', 'ExternalRepo') GROUP BY 1),
con AS (SELECT url AS repo, 'dev-' || l_suppkey AS contributor, sum(l_linenumber)::DOUBLE AS commits FROM used JOIN ret ON node_id = url GROUP BY 1, 2),
hh AS (SELECT repo, round(sum((commits / total) ** 2) * 10000, 1) AS hhi FROM (SELECT *, sum(commits) OVER (PARTITION BY repo) AS total FROM con) GROUP BY 1)"""


@query(f"WITH {_X2} SELECT DISTINCT url AS src, 'part-' || l_partkey AS dst FROM used")
def p4_of_mixed_nodes(m):
    """Of a graph with projects and contributors, the edges between packages."""
    g = _enriched(m)
    return graph.induced(g.edges, graph.dependency_nodes(g.nodes)).select("src", "dst")


def _full_run(m):
    """One run over the enriched graph for all queries of a model."""
    if "full_run" not in m.__dict__:
        m.full_run = run.ecosystem_of(_enriched(m), m.config)
    return m.full_run


@query(f"""WITH {_X4}, ex AS (SELECT repo, sum((commits / total) ** 2) * 10000 AS hhi, max(commits / total) AS top FROM (SELECT *, sum(commits) OVER (PARTITION BY repo) AS total FROM con) GROUP BY 1)
  SELECT node_id, criticality::BIGINT AS criticality, round(hhi, 4) AS hhi, coalesce((round(top, 6) >= 0.5)::BIGINT, -1) AS flagged, ex.repo IS NOT NULL AS in_gate FROM cr LEFT JOIN ex ON repo = node_id""")
def x4_full_run_rows(m):
    """The metric run over the enriched graph, package by package."""
    got = _full_run(m).results()
    conc = got["concentration"]().select(F.col("repo").alias("node_id"), R("hhi_exact", 4).alias("hhi"), F.col("pony_factor").cast("long").alias("flagged"))
    gated = got["gate"]().select("node_id", F.lit(True).alias("in_gate"))
    rows = got["criticality"]().select("node_id", F.col("criticality").cast("long").alias("criticality"))
    return rows.join(conc, "node_id", "left").join(gated, "node_id", "left").select("node_id", "criticality", "hhi", F.coalesce("flagged", F.lit(-1).cast("long")).alias("flagged"), F.coalesce("in_gate", F.lit(False)).alias("in_gate"))


@query(f"WITH {_X4} SELECT 'criticality' AS part, count(*) AS n, sum(criticality)::DOUBLE AS total FROM cr UNION ALL SELECT 'concentration', count(*), round(sum(hhi), 0) FROM hh UNION ALL SELECT 'dormant', (SELECT count(*) FROM x2) - count(*), 0 FROM ret UNION ALL SELECT 'edges', count(*), 0 FROM dep UNION ALL SELECT 'gate', count(*), 0 FROM hh JOIN cr ON node_id = repo")
def x4_full_run(m):
    """The metric run over the enriched graph: sizes and sums of what it derives."""
    e = _full_run(m)
    got = e.results()
    part = lambda n, df, total=None: df.agg(F.count(F.lit(1)).alias("n"), R(F.sum((total if total is not None else F.lit(0)).cast("double")), 0).alias("total")).select(F.lit(n).alias("part"), "n", F.coalesce("total", F.lit(0.0)).alias("total"))
    rows = [part("criticality", got["criticality"](), F.col("criticality")), part("concentration", got["concentration"](), F.col("hhi")), part("dormant", got["dormant"]()), part("edges", e.edges), part("gate", got["gate"]())]
    return reduce(DataFrame.unionByName, rows)


_THIRTY_BACK = ECO.replace("SELECT max(committed_at) AS d FROM commits)", "SELECT max(l_shipdate)::DATE - 30 AS d FROM lineitem)").replace("quantity FROM lineitem)", "quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) <= (SELECT max(l_shipdate)::DATE - 30 FROM lineitem))")
_FIGURES = """SELECT (SELECT d FROM ref) AS day, (SELECT count(*) FROM act WHERE node_type = 'Repo') AS active_repos, (SELECT count(*) FROM edges) AS dependency_edges, (SELECT count(*) FROM bridges) AS bridge_edges, (SELECT max(core) FROM cores) AS max_core,
  (SELECT round(avg(hhi), 1) FROM conc) AS mean_hhi, (SELECT round(avg(pony_factor), 4) FROM conc) AS pony_rate, (SELECT round(avg(passed::INT), 4) FROM gate) AS gate_pass_rate, (SELECT count(*) FROM debt) AS debt_size, (SELECT count(*) FROM keystones) AS keystone_count"""
_TWO = f"a AS MATERIALIZED ({_THIRTY_BACK} {_FIGURES}), b AS MATERIALIZED ({ECO} {_FIGURES})"


def _two_rounds(m):
    """Two runs, thirty days apart, through the store of snapshots."""
    if "_two_rounds" not in m.__dict__:
        folder = f"{shared_dir(m.spark)}/rounds-{uuid.uuid4().hex}"
        before = Model(m.spark, m.dir, m.config, days_back=30)
        rounds.close(before, rounds.Round(before.day, "Round 1"), folder)
        m._two_rounds = rounds.close(m, rounds.Round(m.day, "Round 2"), folder)
    return m._two_rounds


@query(f"WITH {_TWO} SELECT day AS snapshot_date, 'Round 1' AS label, * EXCLUDE (day) FROM a UNION ALL SELECT day, 'Round 2', * EXCLUDE (day) FROM b")
def x4_rounds(m):
    return _two_rounds(m)["rounds"]().select("snapshot_date", "label", "active_repos", "dependency_edges", "bridge_edges", "max_core", "mean_hhi", "pony_rate", "gate_pass_rate", "debt_size", "keystone_count")


@query(f"""WITH {_TWO} SELECT a.day AS earlier, b.day AS later, 'Round 1' AS earlier_label, 'Round 2' AS later_label, b.active_repos - a.active_repos AS active_repos_delta, b.debt_size - a.debt_size AS debt_size_delta,
  round(b.mean_hhi - a.mean_hhi, 6) AS mean_hhi_delta, round(b.pony_rate - a.pony_rate, 6) AS pony_rate_delta, round(b.gate_pass_rate - a.gate_pass_rate, 6) AS gate_pass_rate_delta FROM a, b""")
def x4_comparison(m):
    c = _two_rounds(m)["comparison"]()
    return c.select("earlier", "later", "earlier_label", "later_label", "active_repos_delta", "debt_size_delta", *[R(f"{x}_delta", 6).alias(f"{x}_delta") for x in ("mean_hhi", "pony_rate", "gate_pass_rate")])


_X5 = """days AS (SELECT max(ts)::DATE AS d FROM events), c AS (SELECT user_id AS repo, CASE WHEN event_type = 'error' THEN 'unknown_' || event_type || '@unknown' ELSE event_type || '@x.org' END AS email, ts::DATE AS day FROM events),
r AS (SELECT user_id AS repo, bool_or(event_type <> 'error') AS accessible FROM events GROUP BY 1)"""


def _landed(m):
    author = F.struct(F.col("event_type").alias("name"), F.when(F.col("event_type") != "error", F.concat("event_type", F.lit("@x.org"))).alias("email"), F.date_format("ts", "yyyy-MM-dd'T'00:00:00'Z'").alias("date"))
    c = F.struct(F.struct(author.alias("author")).alias("commit"), F.struct(F.lit(None).cast("string").alias("login")).alias("author"))
    pages = _payload(m, "user_id", c).withColumnRenamed("user_id", "repo")
    repos = m.table("events").groupBy(F.col("user_id").alias("repo")).agg(F.bool_or(F.col("event_type") != "error").alias("accessible"), F.lit(False).alias("archived"))
    day = F.lit(m.table("events").agg(F.to_date(F.max("ts"))).first()[0])
    return ingest.contributions(pages, repos, day, m.config)


@query(f"WITH {_X5}, g AS (SELECT repo, email, count(*) AS commits FROM c JOIN r USING (repo) WHERE accessible AND day >= (SELECT d FROM days) - 90 GROUP BY 1, 2) SELECT repo, email, commits, round(100.0::DOUBLE * commits / sum(commits) OVER (PARTITION BY repo), 2) AS commit_share_pct FROM g")
def x5_ingested_contributions(m):
    return _landed(m)[0].select("repo", "email", "commits", "commit_share_pct")


@query(f"WITH {_X5} SELECT r.repo, accessible, CASE WHEN accessible THEN date_diff('day', max(day), (SELECT d FROM days)) ELSE 9999 END AS days_since_commit FROM r JOIN c ON c.repo = r.repo GROUP BY 1, 2")
def x5_ingested_activity(m):
    return _landed(m)[1].select("repo", "accessible", "days_since_commit")


@query("SELECT DISTINCT coalesce(url, 'u' || user_id) AS from_repo, event_type AS to_package, 'CARGO' AS ecosystem FROM events LEFT JOIN (SELECT c_custkey, 'https://github.com/c/' || c_custkey AS url FROM customer) ON c_custkey = user_id")
def x5_ingested_dependencies(m):
    urls = m.table("customer").select(F.concat(F.lit("u"), "c_custkey").alias("name"), F.concat(F.lit("https://github.com/c/"), "c_custkey").alias("url"))
    return ingest.dependencies(_dependency_pages(m, "CARGO"), urls).select("from_repo", "to_package", "ecosystem")


@query("""WITH u AS (SELECT user_id, count(*) AS n, max(event_id) AS e FROM events GROUP BY 1), d AS (SELECT * FROM u WHERE user_id % 2 = 0), p AS (SELECT * FROM u WHERE user_id % 3 = 0)
SELECT 'https://github.com/u/' || coalesce(d.user_id, p.user_id) AS node_id, coalesce(d.n, 0) AS downloads, coalesce(p.n, 0) AS stars, coalesce(p.e, 0) AS forks FROM d FULL JOIN p ON d.user_id = p.user_id""")
def x5_ingested_adoption(m):
    """Users with an even number have download payloads, every third one project payloads."""
    u = m.table("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("e"))
    d = u.filter("user_id % 2 = 0").select(F.concat(F.lit("https://github.com/u/"), "user_id").alias("node_id"), F.to_json(F.struct(F.col("n").alias("downloads"))).alias("payload"))
    key = F.struct(F.concat(F.lit("github.com/u/"), "user_id").alias("id")).alias("projectKey")
    p = u.filter("user_id % 3 = 0").select(F.to_json(F.struct(key, F.col("n").alias("starsCount"), F.col("e").alias("forksCount"))).alias("payload"))
    return ingest.adoption(d, p)


@query(f"""WITH {_X5}, g AS (SELECT repo, email, count(*) AS commits FROM c JOIN r USING (repo) WHERE accessible AND day >= (SELECT d FROM days) - 90 GROUP BY 1, 2)
SELECT 'contributions' AS name, true AS first, true AS second, (SELECT count(*) FROM g) AS n UNION ALL SELECT 'activity', true, false, (SELECT count(*) FROM r)""")
def x5_store(m):
    """Ingested tables are stored twice; the second time no activity came, and the table of the first time stays."""
    folder = f"{shared_dir(m.spark)}/store-{uuid.uuid4().hex}"
    contributions, activity = _landed(m)
    contributions, activity = contributions.drop("aliases"), activity
    first = ingest.store({"contributions": contributions, "activity": activity}, folder)
    second = ingest.store({"contributions": contributions, "activity": activity.limit(0)}, folder)
    part = lambda name: m.spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(first[name]).alias("first"), F.lit(second[name]).alias("second"), "n")
    return part("contributions").unionAll(part("activity"))


# --- sinks ----------------------------------------------------------------------------------------------------------


@query("WITH" + _ROUNDS + " SELECT snapshot_date::VARCHAR AS date, coalesce(lower(replace(label, ' ', '_')), '') AS round, active_repos, mean_hhi, gate_pass_rate, debt_size FROM rounds")
def s10_s11_snapshot_round_trip(m):
    """Written twice: a rerun replaces its own rows."""
    path = f"{shared_dir(m.spark)}/snapshots-{uuid.uuid4().hex}"
    snaps = _rounds(m)
    for _ in range(2):
        tables.write_snapshot(snaps, path, "label")
    return tables.read_snapshots(m.spark, path, "active_repos long, mean_hhi double, gate_pass_rate double, debt_size long, date string, round string").select("date", F.coalesce("round", F.lit("")).alias("round"), "active_repos", "mean_hhi", "gate_pass_rate", "debt_size")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def s9_guarded_sink(m):
    """A table is written, and an empty one over it is not."""
    path = f"{shared_dir(m.spark)}/sink-{uuid.uuid4().hex}"
    o = m.table("orders").select("o_orderkey", "o_totalprice")
    tables.write_guarded(o, path)
    tables.write_guarded(o.filter("o_orderkey < 0"), path)
    return m.spark.read.parquet(path)


@query("SELECT repo, email, commits, display, alias_names FROM (" + ORACLE_SQL["a3_roll_up_commits"] + ")")
def s12_contributor_export(m):
    c = m.table("events").select(F.col("user_id").alias("repo"), F.col("event_type").alias("email"), F.col("props").alias("name"), F.col("ts").alias("committed_at"))
    path = f"{shared_dir(m.spark)}/export-{uuid.uuid4().hex}"
    tables.export_contributors(concentration.roll_up_commits(c), path)
    kind = "repo long, part int, contributors array<struct<email:string,display:string,commits:long,aliases:array<string>>>"
    back = m.spark.read.schema(kind).json(path).select("repo", F.inline("contributors"))
    return back.select("repo", "email", "commits", "display", F.array_join("aliases", " | ").alias("alias_names"))
