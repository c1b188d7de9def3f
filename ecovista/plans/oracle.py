"""The model of mapping.py in SQL, as common table expressions for the twins of the queries."""

ECO = """
WITH RECURSIVE
commits AS (SELECT l_partkey AS repo, l_suppkey AS contributor, CAST(l_shipdate AS DATE) AS committed_at, l_quantity AS quantity FROM lineitem),
ref AS (SELECT max(committed_at) AS d FROM commits),
ages AS (SELECT repo, date_diff('day', max(committed_at), (SELECT d FROM ref)) AS age FROM commits GROUP BY 1),
nodes AS (
  SELECT *, coalesce(days <= 90 AND NOT archived, false) AS active,
         CASE WHEN days IS NULL THEN node_type = 'ExternalRepo' ELSE days <= 90 AND NOT archived END AS retained
  FROM (SELECT p_partkey AS node_id, CASE WHEN p_partkey % 10 = 0 THEN 'ExternalRepo' ELSE 'Repo' END AS node_type,
               p_brand || '/' || p_type AS project, CASE WHEN p_partkey % 100 = 0 OR p_partkey % 97 = 5 THEN NULL ELSE age END AS days,
               p_size = 50 AS archived
        FROM part LEFT JOIN ages ON repo = p_partkey)),
alledges AS (
  SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part UNION ALL SELECT 2, 11)
  WHERE src <> dst),
act AS (SELECT * FROM nodes WHERE retained),
edges AS (SELECT e.* FROM alledges e JOIN act a ON a.node_id = e.src JOIN act b ON b.node_id = e.dst),
walk AS (SELECT dst AS pkg, src AS dependent FROM edges UNION SELECT w.pkg, e.src FROM walk w JOIN edges e ON e.dst = w.dependent),
closure AS (SELECT * FROM walk WHERE pkg <> dependent),
crit0 AS (
  SELECT a.node_id, coalesce(c.n, 0) AS criticality
  FROM act a LEFT JOIN (SELECT pkg, count(*) AS n FROM closure JOIN act d ON d.node_id = dependent AND d.active GROUP BY 1) c ON c.pkg = a.node_id),
crit AS (SELECT *, (rank() OVER (ORDER BY criticality) - 1) / (count(*) OVER ())::DOUBLE * 100 AS criticality_pct FROM crit0),
contrib AS (
  SELECT repo, contributor, count(*) AS commits, min(committed_at) AS first_date, max(committed_at) AS last_date
  FROM commits WHERE committed_at >= (SELECT d FROM ref) - 365 GROUP BY 1, 2),
acontrib AS (SELECT c.* FROM contrib c JOIN act a ON a.node_id = c.repo AND a.node_type = 'Repo'),
shares AS (SELECT *, sum(commits) OVER (PARTITION BY repo)::BIGINT AS total, commits / sum(commits) OVER (PARTITION BY repo)::DOUBLE AS share FROM acontrib),
conc AS (
  SELECT repo, (max(share) >= 0.5)::INT AS pony_factor, round(sum(share * share) * 10000, 1) AS hhi,
         round(abs(sum(CASE WHEN share > 0 THEN -share * ln(share) ELSE 0 END)), 3) AS entropy,
         CASE WHEN round(sum(share * share) * 10000, 6) < 1500 THEN 'healthy' WHEN round(sum(share * share) * 10000, 6) < 2500 THEN 'moderate'
              WHEN round(sum(share * share) * 10000, 6) < 5000 THEN 'concentrated' ELSE 'critical' END AS hhi_tier,
         (array_agg(contributor ORDER BY share DESC, contributor))[1] AS top_contributor, round(max(share), 3) AS top_share,
         count(*) AS n_contributors, max(total) AS total_commits
  FROM shares GROUP BY 1),
signals AS (SELECT repo AS node_id, count(*) AS stars, count(DISTINCT contributor) AS forks, sum(quantity)::BIGINT AS downloads FROM commits GROUP BY 1),
ad0 AS (SELECT a.node_id, coalesce(downloads, 0) AS downloads, coalesce(stars, 0) AS stars, coalesce(forks, 0) AS forks FROM act a LEFT JOIN signals s USING (node_id)),
ad1 AS (
  SELECT *, (rank() OVER (ORDER BY downloads) + (count(*) OVER (PARTITION BY downloads) - 1) / 2.0) / (count(*) OVER ())::DOUBLE * 100 AS downloads_pct,
         (rank() OVER (ORDER BY stars) + (count(*) OVER (PARTITION BY stars) - 1) / 2.0) / (count(*) OVER ())::DOUBLE * 100 AS stars_pct,
         (rank() OVER (ORDER BY forks) + (count(*) OVER (PARTITION BY forks) - 1) / 2.0) / (count(*) OVER ())::DOUBLE * 100 AS forks_pct
  FROM ad0),
adopt AS (SELECT *, (downloads_pct + stars_pct + forks_pct) / 3 AS adoption_score FROM ad1),
gate0 AS (
  SELECT c.node_id, criticality, criticality_pct, hhi, top_contributor, top_share, coalesce(adoption_score, 0) AS adoption_score,
         round(criticality_pct, 9) >= 50 AS criticality_passed, hhi < 2500 AS maintenance_passed, round(coalesce(adoption_score, 0), 9) >= 40 AS adoption_passed
  FROM crit c JOIN conc ON conc.repo = c.node_id LEFT JOIN adopt a ON a.node_id = c.node_id),
gate AS (
  SELECT *, criticality_passed::INT + maintenance_passed::INT + adoption_passed::INT AS votes,
         criticality_passed::INT + maintenance_passed::INT + adoption_passed::INT >= 2 AS passed,
         criticality_passed::INT + maintenance_passed::INT + adoption_passed::INT = 2 AS borderline FROM gate0),
debt AS (
  SELECT * FROM (
    SELECT a.node_id, a.project, a.days, criticality, criticality_pct, hhi, top_contributor, top_share,
           CASE WHEN days < 14 THEN 'active' WHEN days < 45 THEN 'stable' WHEN days < 89 THEN 'stagnant' ELSE 'declining' END AS trend,
           CASE WHEN hhi >= 5000 THEN 'critical' ELSE 'concentrated' END AS hhi_tier, round(criticality_pct / 100 * hhi / 10000, 4) AS risk
    FROM act a JOIN crit USING (node_id) JOIN conc ON repo = node_id WHERE node_type = 'Repo')
  WHERE round(criticality_pct, 9) >= 75 AND hhi >= 2500 AND trend IN ('stagnant', 'declining')),
flagged AS (SELECT repo AS node_id, top_contributor AS contributor FROM conc WHERE pony_factor = 1),
key0 AS (
  SELECT f.contributor, sum(coalesce(criticality, 0))::BIGINT AS kci, count(*) AS n_repos, count(DISTINCT project) AS n_projects
  FROM flagged f LEFT JOIN crit USING (node_id) LEFT JOIN act USING (node_id) GROUP BY 1),
key1 AS (SELECT *, (rank() OVER (ORDER BY kci) - 1) / (count(*) OVER ())::DOUBLE * 100 AS kci_pct FROM key0),
reach AS (SELECT f.contributor, count(DISTINCT c.dependent) AS at_risk FROM flagged f LEFT JOIN closure c ON c.pkg = f.node_id GROUP BY 1),
keystones AS (SELECT k.*, at_risk FROM key1 k JOIN reach USING (contributor) WHERE kci > 0),
totals AS (
  SELECT project, coalesce(sum(criticality), 0)::BIGINT AS criticality, count(*) AS n_repos, coalesce(sum(pony_factor), 0)::BIGINT AS pony_risk_repos
  FROM act LEFT JOIN crit USING (node_id) LEFT JOIN conc ON repo = node_id WHERE node_type = 'Repo' GROUP BY 1),
projects AS (
  SELECT p_brand || '/' || p_type AS project, sum(CASE WHEN p_size > 45 THEN p_retailprice ELSE 0 END::DECIMAL(18, 2))::DOUBLE AS funding FROM part GROUP BY 1),
universe AS (
  SELECT project, coalesce(criticality, 0) AS criticality, coalesce(funding, 0) AS funding, coalesce(pony_risk_repos, 0) AS pony_risk_repos FROM totals FULL JOIN projects USING (project)),
fer0 AS (
  SELECT *, (rank() OVER (ORDER BY criticality) - 1) / (count(*) OVER ())::DOUBLE * 100 AS crit_pct,
         CASE WHEN funding > 0 THEN (rank() OVER (PARTITION BY funding > 0 ORDER BY funding) - 1) / (count(*) OVER (PARTITION BY funding > 0))::DOUBLE * 100 ELSE 0 END AS fund_pct
  FROM universe),
fer1 AS (SELECT *, CASE WHEN funding > 0 AND fund_pct > 0 THEN round(crit_pct / fund_pct, 4) END AS fer FROM fer0),
fer AS (
  SELECT *, pony_risk_repos > 0 AS any_pony, CASE WHEN fer IS NULL THEN 'unfunded' WHEN fer > 2 THEN 'critically_underfunded' WHEN fer > 1.3 THEN 'underfunded'
              WHEN fer > 0.7 THEN 'balanced' WHEN fer > 0.4 THEN 'overfunded' ELSE 'significantly_overfunded' END AS tier FROM fer1),
und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges),
ends AS (SELECT a AS x, b AS y FROM und UNION ALL SELECT b, a FROM und),
peel(step, node, k) AS (
  SELECT 0, node_id, 1 FROM act UNION ALL
  SELECT step + 1, node, CASE WHEN every_one THEN k + 1 ELSE k END
  FROM (SELECT p.step, p.node, p.k, coalesce(d.deg, 0) AS deg, bool_and(coalesce(d.deg, 0) >= p.k) OVER () AS every_one
        FROM peel p LEFT JOIN (SELECT m.node, count(*) AS deg FROM peel m JOIN ends e ON e.x = m.node JOIN peel o ON o.node = e.y GROUP BY 1) d ON d.node = p.node)
  WHERE deg >= k),
cores AS (SELECT node AS node_id, max(k)::BIGINT - 1 AS core FROM peel GROUP BY 1),
away(a, b, n) AS (SELECT a, b, a FROM und UNION SELECT w.a, w.b, e.y FROM away w JOIN ends e ON e.x = w.n WHERE NOT (least(e.x, e.y) = w.a AND greatest(e.x, e.y) = w.b)),
bridges AS (SELECT a, b FROM und WHERE NOT EXISTS (SELECT 1 FROM away w WHERE w.a = und.a AND w.b = und.b AND w.n = und.b))
"""


def eco(select: str, more: str = "") -> str:
    """select over the model; more: further common table expressions."""
    return ECO + (", " + more if more else "") + select
