"""The gate and the three decision surfaces: maintenance debt, keystone contributors, funding efficiency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import narratives
from ..functions.lineage import apart, cut
from ..functions.tiers import FER_TIERS, commit_trend, fer_tier
from .cohesion import inner_core
from .rank import average_percentile, exclusive_percentile, funded_percentile, leading, place, top
from .reach import union_reach


def scored(crit: DataFrame) -> DataFrame:
    """node_id, criticality and its exclusive percentile."""
    return exclusive_percentile(crit, "criticality", "criticality_pct")


def gate_input(crit: DataFrame, conc: DataFrame, adoption: DataFrame, join: str = "inner") -> DataFrame:
    """Scores by project; join='left' keeps repos without contribution rows, with hhi 0 and contributor unknown."""
    a = adoption.select("node_id", "adoption_score")
    c = conc.select(F.col("repo").alias("node_id"), "hhi", "top_contributor", "top_share")
    g = crit.join(apart(c), "node_id", join).join(apart(a), "node_id", "left")
    return g.select("node_id", "criticality", "criticality_pct", F.coalesce("hhi", F.lit(0.0)).alias("hhi"), F.coalesce(F.col("top_contributor").cast("string"), F.lit("unknown")).alias("top_contributor"), F.coalesce("top_share", F.lit(0.0)).alias("top_share"), F.coalesce("adoption_score", F.lit(0.0)).alias("adoption_score"))


def gate(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Signals as structs (value, threshold, passed, narrative), votes, passed, borderline, explanation, order of the listing."""
    p = {
        "criticality": F.round("criticality_pct", 9) >= config.criticality_pass_percentile,
        "maintenance": F.col("hhi") < config.hhi_pass_below,
        "adoption": F.round("adoption_score", 9) >= config.adoption_pass_percentile,
    }
    votes = sum((x.cast("int") for x in p.values()), F.lit(0))
    df = rows.withColumns({f"{k}_passed": v for k, v in p.items()} | {"votes": votes})
    df = df.withColumns({"passed": F.col("votes") >= config.signals_required, "borderline": F.col("votes") == config.signals_required})
    texts = {
        "criticality_text": narratives.criticality(F.col("criticality"), F.col("criticality_pct"), F.col("criticality_passed"), config),
        "maintenance_text": narratives.concentration(F.col("hhi"), F.col("top_contributor"), F.col("top_share"), F.col("maintenance_passed"), config),
        "adoption_text": narratives.adoption(F.col("adoption_score"), F.col("adoption_passed"), config),
    }
    return df.withColumns(texts).withColumn("explanation", narratives.gate(F.col("passed"), F.col("votes"), [F.col(t) for t in texts], config))


def gate_order():
    """Failed first by percentile; then passed, borderline ones first; the key decides ties."""
    return [F.col("passed"), F.when(F.col("passed") & ~F.col("borderline"), 1).otherwise(0), F.col("criticality_pct").desc(), F.col("node_id")]


def gate_summary(g: DataFrame, config: Config = DEFAULT) -> DataFrame:
    fails = lambda *names: sum((F.when(~F.col(f"{n}_passed"), 1).otherwise(0) for n in names), F.lit(0))
    all_three = fails("criticality", "maintenance", "adoption")
    failed = ~F.col("passed")
    rate = lambda c: F.coalesce(F.round(F.avg(c.cast("int")), 4), F.lit(0.0))
    only = {f"only_{n}_failed": F.count_if(failed & (all_three == 1) & ~F.col(f"{n}_passed")) for n in ("criticality", "maintenance", "adoption")}
    return g.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("n_passed"), F.count_if(failed).alias("n_failed"), F.count_if("borderline").alias("n_borderline"), rate(F.col("passed")).alias("pass_rate"),
        *[rate(F.col(f"{n}_passed")).alias(f"{n}_pass_rate") for n in ("criticality", "maintenance", "adoption")],
        F.count_if(failed & (all_three == 3)).alias("all_three_failed"), *[c.alias(n) for n, c in only.items()], F.count_if(failed & (all_three == 2)).alias("two_failed"),
    )


def maintenance_debt(nodes: DataFrame, crit: DataFrame, conc: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Critical, concentrated repositories that stagnate or decline."""
    r = nodes.filter("node_type = 'Repo'").select("node_id", F.coalesce(F.col("project").cast("string"), F.col("node_id").cast("string")).alias("project"), F.col("days_since_commit").cast("long").alias("days"))
    j = r.join(apart(crit), "node_id").join(apart(conc.select(F.col("repo").alias("node_id"), "hhi", "top_contributor", "top_share")), "node_id").withColumn("trend", commit_trend(F.col("days"), config))
    hit = j.filter((F.round("criticality_pct", 9) >= config.debt_criticality_percentile) & (F.col("hhi") >= config.debt_hhi) & F.col("trend").isin("stagnant", "declining"))
    tier = F.when(F.col("hhi") >= config.hhi_critical, "critical").otherwise("concentrated")
    out = hit.withColumns({"hhi_tier": tier, "risk": F.round(F.col("criticality_pct") / 100 * F.col("hhi") / 10_000, 4)})
    text = narratives.debt(*[F.col(c) for c in ("project", "criticality_pct", "criticality", "top_contributor", "top_share", "hhi", "hhi_tier", "trend", "days")])
    return out.withColumn("narrative", text)


def debt_summary(debt: DataFrame, k: int = 5) -> DataFrame:
    """One row: size, critical and declining entries, and the k of the highest risk."""
    counts = debt.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("hhi_tier") == "critical").alias("n_critical"), F.count_if(F.col("trend") == "declining").alias("n_declining"))
    return counts.crossJoin(top(debt, "risk", "node_id", k))  # one row each


def debt_top(debt: DataFrame, k: int = 10) -> DataFrame:
    return leading(debt, "risk", "node_id", k)


def debt_scatter(debt: DataFrame) -> DataFrame:
    """Where each entry lies in a drawing of criticality against concentration, with its trend."""
    return debt.select("node_id", "criticality_pct", "hhi", "trend")


def keystone_repos(conc: DataFrame, crit: DataFrame) -> DataFrame:
    """contributor, node_id, criticality of each flagged repo: rows, as one owner may have any number of them."""
    flagged = conc.filter("pony_factor = 1").select(F.col("repo").alias("node_id"), F.col("top_contributor").alias("contributor"))
    return flagged.join(apart(crit.select("node_id", "criticality")), "node_id", "left").na.fill(0, ["criticality"])


def keystones(conc: DataFrame, crit: DataFrame, nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Per top contributor of flagged repos: summed criticality (0 dropped after the percentile), repos, projects, union reach."""
    flagged = conc.filter("pony_factor = 1").select(F.col("repo").alias("node_id"), "top_contributor")
    rows = keystone_repos(conc, crit).join(apart(nodes.select("node_id", "project")), "node_id", "left")
    g = cut(rows.groupBy("contributor").agg(F.sum("criticality").cast("long").alias("kci"), F.count(F.lit(1)).alias("n_repos"), F.count_distinct("project").alias("n_projects")))  # for the ranks and for the rows
    reach = union_reach(flagged.select(F.col("top_contributor").alias("owner"), "node_id"), closure).select(F.col("owner").alias("contributor"), F.col("reach").alias("at_risk"))
    ranked = exclusive_percentile(g, "kci", "kci_pct").filter("kci > 0").join(apart(reach), "contributor")
    return ranked.withColumn("narrative", narratives.keystone(*[F.col(c) for c in ("contributor", "n_repos", "n_projects", "kci", "at_risk")]))


def keystone_summary(k: DataFrame, n: int = 5) -> DataFrame:
    """One row with the n of the highest score; the sum counts packages under several contributors several times."""
    counts = k.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("at_risk"), F.lit(0)).cast("long").alias("at_risk_total"), F.coalesce(F.max("kci"), F.lit(0)).alias("max_kci"))
    return counts.crossJoin(top(k, "kci", "contributor", n, "n_repos", "at_risk"))  # one row each


def keystone_top(k: DataFrame, n: int = 10) -> DataFrame:
    return leading(k, "kci", "contributor", n)


def project_totals(nodes: DataFrame, crit: DataFrame, conc: DataFrame) -> DataFrame:
    """Per project: criticality of its repos, number of repos, flagged repos."""
    repos = nodes.filter("node_type = 'Repo' AND project IS NOT NULL AND project <> ''").select("node_id", "project")
    flags = conc.select(F.col("repo").alias("node_id"), "pony_factor")
    j = repos.join(apart(crit.select("node_id", "criticality")), "node_id", "left").join(apart(flags), "node_id", "left")
    return j.groupBy("project").agg(F.coalesce(F.sum("criticality"), F.lit(0)).cast("long").alias("criticality"), F.count(F.lit(1)).alias("n_repos"), F.coalesce(F.sum("pony_factor"), F.lit(0)).cast("long").alias("pony_risk_repos"))


def funding_efficiency(totals: DataFrame, projects: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Criticality percentile over funding percentile, for projects in either table; null without funding or with funding percentile 0."""
    p = projects.select(F.col("title").alias("project"), F.coalesce("total_awarded_usd", F.lit(0.0)).cast("decimal(18,2)").cast("double").alias("funding"))
    u = cut(totals.join(apart(p), "project", "full_outer").select("project", F.coalesce("criticality", F.lit(0)).cast("long").alias("criticality"), F.coalesce("funding", F.lit(0.0)).alias("funding"), F.coalesce("pony_risk_repos", F.lit(0)).cast("long").alias("pony_risk_repos")))
    r = funded_percentile(exclusive_percentile(u, "criticality", "crit_pct"), "funding", "fund_pct")
    fer = F.when((F.col("funding") > 0) & (F.col("fund_pct") > 0), F.round(F.col("crit_pct") / F.col("fund_pct"), 4))
    out = r.withColumn("fer", fer).withColumn("tier", fer_tier(F.col("fer"), config)).withColumn("any_pony", F.col("pony_risk_repos") > 0)
    return out.withColumn("narrative", narratives.funding(F.col("tier"), F.col("crit_pct"), F.col("fund_pct"), F.col("fer")))


def fer_summary(fer: DataFrame) -> DataFrame:
    """A row for each tier, those without projects too."""
    tiers = fer.sparkSession.createDataFrame([(t,) for t in FER_TIERS], "tier string")
    return tiers.join(fer.groupBy("tier").agg(F.count(F.lit(1)).alias("n")), "tier", "left").na.fill(0, ["n"])


def fer_display(fer: DataFrame) -> DataFrame:
    """Per tier: projects, those with a flagged repo, and the number of underfunded projects in all."""
    low = fer.agg(F.count_if(F.col("tier").isin("critically_underfunded", "underfunded")).alias("n_underfunded"))
    return fer.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if("any_pony").alias("n_with_pony")).crossJoin(low)  # one row


def gate_funnel(g: DataFrame) -> DataFrame:
    """stage, n: all projects, those that pass each signal, passed and failed."""
    signals = ("criticality", "maintenance", "adoption")
    row = g.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(f"{k}_passed").alias(k) for k in signals], F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("n")) for c in row.columns])))


def gate_lookup(g: DataFrame, asked: DataFrame) -> DataFrame:
    """Gate rows of the projects asked for (column asked)."""
    return asked.distinct().join(g, F.col("asked") == F.col("node_id"))


def metric_listing(crit: DataFrame, conc: DataFrame, adoption: DataFrame, keystones: DataFrame, fer: DataFrame, debt: DataFrame) -> DataFrame:
    """metric, name, value of every scored thing."""
    parts = [("criticality", crit, "node_id", "criticality"), ("hhi", conc, "repo", "hhi"), ("adoption", adoption, "node_id", "adoption_score"), ("kci", keystones, "contributor", "kci"), ("fer", fer, "project", "fer"), ("risk", debt, "node_id", "risk")]
    rows = [df.select(F.lit(m).alias("metric"), F.col(k).cast("string").alias("name"), F.col(v).cast("double").alias("value")) for m, df, k, v in parts]
    return reduce(DataFrame.unionByName, rows)


def node_encodings(crit: DataFrame, cores: DataFrame, conc: DataFrame) -> DataFrame:
    """Per package what a drawing shows: size by criticality (5 to 40), colour by core number, a border where one contributor dominates."""
    j = crit.join(apart(cores.select("node_id", "core")), "node_id", "left").join(apart(conc.select(F.col("repo").alias("node_id"), "pony_factor")), "node_id", "left")
    size = F.greatest(F.lit(5.0), F.least(F.lit(40.0), 5 + F.log1p("criticality") * 8))
    return j.select("node_id", size.alias("size"), F.coalesce("core", F.lit(0)).cast("long").alias("color"), F.coalesce(F.col("pony_factor") == 1, F.lit(False)).alias("risk_border"))


def headline(crit: DataFrame, conc: DataFrame, cores: DataFrame, fer: DataFrame) -> DataFrame:
    """One row of a run's first figures."""
    parts = [
        crit.agg(F.count_if(F.col("criticality") > 0).alias("scored"), F.max("criticality").alias("max_score")),
        conc.agg(F.round(100 * F.avg("pony_factor"), 2).alias("flagged_pct"), F.count_if(F.col("hhi_tier") == "critical").alias("n_critical")),
        inner_core(cores).agg(F.count(F.lit(1)).alias("inner_core")), fer.agg(F.count_if(F.col("tier").isin("critically_underfunded", "underfunded")).alias("underfunded")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


def rollup(awards: DataFrame, keys: list[str]) -> DataFrame:
    """awards: amount, voter, flagged -> per key: total (in cents exactly), n, voters, flagged_pct."""
    return awards.groupBy(*keys).agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"), F.count(F.lit(1)).alias("n"), F.count_distinct("voter").alias("voters"), (100 * F.avg(F.col("flagged").cast("int"))).alias("flagged_pct"))


def fer_top(fer: DataFrame, k: int = 10) -> DataFrame:
    """By FER, projects without one first."""
    return leading(fer, "fer", "project", k, nulls_first=True)


def underfunded_top(fer: DataFrame, over: float = 1.5, k: int = 10) -> DataFrame:
    return leading(fer.filter(F.col("fer") > over), "fer", "project", k)


def balanced_top(fer: DataFrame, low: float = 0.8, high: float = 1.2, k: int = 5) -> DataFrame:
    """The most critical projects whose funding fits."""
    return leading(fer.filter(F.col("fer").between(low, high)), "criticality", "project", k)


def concentrated_top(conc: DataFrame, k: int = 10) -> DataFrame:
    return leading(conc, "hhi", "repo", k)


def top_share_top(conc: DataFrame, k: int = 20) -> DataFrame:
    return leading(conc, "top_share", "repo", k)


def adopted_top(adoption: DataFrame, k: int = 15) -> DataFrame:
    """By adoption score; scores that differ by rounding errors tie."""
    return leading(adoption, "adoption_score", "node_id", k, digits=9)


def most_underfunded(fer: DataFrame, k: int = 5) -> DataFrame:
    """One row: the k critically underfunded projects of the highest FER."""
    return top(fer.filter("tier = 'critically_underfunded'"), "fer", "project", k)


def scorecard(totals: DataFrame, fer: DataFrame) -> DataFrame:
    """Per project with repos: flagged share, average-rank percentile of criticality, FER with tier unknown where there is none."""
    t = average_percentile(totals, "criticality", "crit_rank_pct").withColumn("high_pony_ratio", F.round(F.col("pony_risk_repos") / F.greatest("n_repos", F.lit(1)), 4))
    return t.join(fer.select("project", "fer", F.when(F.col("fer").isNull(), "unknown").otherwise(F.col("tier")).alias("tier")), "project", "left")


def gate_rank(g: DataFrame) -> DataFrame:
    """Place within passed and failed projects, borderline first among the passed."""
    return place(g, "passed", gate_order()[1:], "place")


def critical_top(crit: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """node_id, node_type, ecosystem, criticality, criticality_pct of the k most critical packages (ties: least id)."""
    best = leading(crit.filter("criticality > 0"), "criticality", "node_id", k)
    rows = nodes.select("node_id", "node_type", "ecosystem").join(F.broadcast(best), "node_id")  # k rows
    return rows.select("node_id", "node_type", "ecosystem", "criticality", "criticality_pct").orderBy(F.desc("criticality"), "node_id")
