"""One-row snapshots of the ecosystem, and their comparison between rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.narratives import comparison, north_star_text
from ..functions.tiers import direction
from .rank import quantile, top

#: (metric, lower is better) of the comparison table.
COMPARED = [("gate_pass_rate", False), ("mean_hhi", True), ("pony_rate", True), ("active_repos", False), ("bridge_edges", True), ("debt_size", True)]
#: Metrics of a snapshot that rounds are compared by.
METRICS = ["gate_pass_rate", "borderline", "pony_rate", "mean_hhi", "median_hhi", "debt_size", "active_repos", "projects", "dependency_edges", "bridge_edges", "keystone_count"]


def _beside(parts: list[DataFrame]) -> DataFrame:
    """One-row tables side by side."""
    return reduce(lambda a, b: a.crossJoin(b), parts)


def snapshot(nodes: DataFrame, crit: DataFrame, conc: DataFrame, gate: DataFrame, debt: DataFrame, keystones: DataFrame, fer: DataFrame, edges: DataFrame, cores: DataFrame, bridges: DataFrame) -> DataFrame:
    """One row of headline figures, with the ten most critical packages, the top five keystones and the number of projects by funding tier.

    projects: titles that repositories carry; project_nodes: nodes of the kind Project that are retained.
    """
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    repo, project = F.col("node_type") == "Repo", F.col("node_type") == "Project"
    tiers = fer.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        nodes.agg(F.count_if(repo & F.col("retained")).alias("active_repos"), F.count_distinct(F.when(repo, F.col("project"))).alias("projects"), F.count_if(project & F.col("retained")).alias("project_nodes")),
        count(edges, "dependency_edges"), cores.agg(F.coalesce(F.max("core"), F.lit(0)).alias("max_core")), count(bridges, "bridge_edges"),
        conc.agg(F.round(F.avg("hhi"), 1).alias("mean_hhi"), F.round(F.avg("pony_factor"), 4).alias("pony_rate")), quantile(conc, "hhi", 0.5, "median_hhi").select(F.round("median_hhi", 1).alias("median_hhi")),
        crit.agg(F.round(F.avg("criticality"), 2).alias("mean_criticality"), F.max("criticality").alias("max_criticality")), quantile(crit, "criticality", 0.5, "m").select(F.round("m", 2).alias("median_criticality")),
        gate.agg(F.round(F.avg(F.col("passed").cast("int")), 4).alias("gate_pass_rate"), F.count_if("borderline").alias("borderline")),
        count(debt, "debt_size"), count(keystones, "keystone_count"),
        top(crit.filter("criticality > 0"), "criticality", "node_id", 10, "criticality_pct").withColumnRenamed("top", "top_critical"),
        top(keystones, "kci", "contributor", 5, "n_repos", "at_risk").withColumnRenamed("top", "top_keystones"),
        tiers.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "n")))).alias("fer_tiers")),  # six rows at most
    ]
    return _beside(parts)


#: Rows of the report's dashboard: name, digits of the value, and whether it is a share to be shown in percent.
DASHBOARD = {"projects": (0, False), "active_repos": (0, False), "dependency_edges": (0, False), "max_core": (0, False), "bridge_edges": (0, False), "mean_hhi": (0, False), "median_hhi": (0, False), "pony_rate": (1, True), "mean_criticality": (2, False), "gate_pass_rate": (1, True), "borderline": (0, False), "debt_size": (0, False), "keystone_count": (0, False)}


def dashboard(snap: DataFrame) -> DataFrame:
    """metric, value (text) of a snapshot; shares in percent."""
    text = lambda m, digits, share: F.format_string(f"%.{digits}f" + ("%%" if share else ""), F.round(F.col(m).cast("double") * (100 if share else 1), digits))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), text(m, *how).alias("value")) for m, how in DASHBOARD.items()])
    return snap.select(F.inline(pairs))


def north_star(fer: DataFrame, debt: DataFrame, gate: DataFrame) -> DataFrame:
    a = fer.agg(F.count(F.lit(1)).alias("fer_total"), F.count_if(F.col("tier").isin("critically_underfunded", "underfunded")).alias("underfunded"))
    b = debt.agg(F.count(F.lit(1)).alias("debt_size"))
    c = gate.agg(F.coalesce(F.round(100 * F.avg(F.col("passed").cast("int"))), F.lit(0)).cast("long").alias("pass_pct"))
    row = _beside([a, b, c])
    return row.withColumn("answer", north_star_text(*[F.col(x) for x in ("fer_total", "underfunded", "debt_size", "pass_pct")]))


def _rounds() -> Window:
    """A round is one row, so the window is over a few rows."""
    return Window.partitionBy(F.lit(0)).orderBy("snapshot_date")


def deltas(snaps: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Later minus earlier for each pair of consecutive rounds, of the metrics that snaps has; labels (the date where a round
    has none) and a sentence where the metrics it speaks of are there."""
    metrics, w = [m for m in metrics or METRICS if m in snaps.columns], _rounds()
    label = F.coalesce(F.col("label"), F.col("snapshot_date").cast("string")) if "label" in snaps.columns else F.col("snapshot_date").cast("string")
    df = snaps.withColumn("later_label", label).withColumns({"earlier": F.lag("snapshot_date").over(w), "earlier_label": F.lag("later_label").over(w)})
    for m in metrics:
        df = df.withColumn(f"{m}_delta", F.col(m) - F.lag(m).over(w))
    out = df.filter("earlier IS NOT NULL").select("earlier", F.col("snapshot_date").alias("later"), "earlier_label", "later_label", *[f"{m}_delta" for m in metrics])
    if {"gate_pass_rate", "mean_hhi", "pony_rate", "debt_size"} <= set(metrics):
        out = out.withColumn("narrative", comparison(*[F.col(c) for c in ("earlier_label", "later_label", "gate_pass_rate_delta", "mean_hhi_delta", "pony_rate_delta", "debt_size_delta")]))
    return out


def _change(delta: Column, band: float, lower_is_better: bool) -> Column:
    better, worse = (delta < -band, delta > band) if lower_is_better else (delta > band, delta < -band)
    return F.when(better, 1).when(worse, -1).otherwise(0)


#: Metric, dead band, lower is better.
BANDS = [("pony_rate", 0.01, True), ("mean_hhi", 50.0, True), ("gate_pass_rate", 0.01, False), ("debt_size", 0.0, True), ("keystone_count", 0.0, True)]


def trend(delta: DataFrame) -> DataFrame:
    """Metrics improved and degraded beyond their dead bands, and the majority's trend."""
    changes = {m: _change(F.round(F.col(f"{m}_delta"), 9), band, low) for m, band, low in BANDS if f"{m}_delta" in delta.columns}
    names = lambda sign: F.array_compact(F.array(*[F.when(c == sign, F.lit(m)) for m, c in changes.items()]))
    df = delta.withColumns({"improved": names(1), "degraded": names(-1)})
    return df.withColumn("trend", F.when(F.size("improved") > F.size("degraded"), "improving").when(F.size("degraded") > F.size("improved"), "degrading").otherwise("stable"))


#: Metrics that are drawn over the rounds.
SERIES = ["gate_pass_rate", "pony_rate", "mean_hhi"]


def trend_series(snaps: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """snapshot_date and the metrics that snaps has, by date; null in rounds that lack one."""
    return snaps.select("snapshot_date", *[m for m in metrics or SERIES if m in snaps.columns]).orderBy("snapshot_date")


def comparison_table(snaps: DataFrame) -> DataFrame:
    """Rows (earlier, later, metric, before, after, delta, direction) for each pair of consecutive rounds."""
    w, parts = _rounds(), []
    for m, low in COMPARED:
        if m in snaps.columns:
            d = F.round(F.col("after") - F.col("before"), 6)
            part = snaps.select(F.lag("snapshot_date").over(w).alias("earlier"), F.col("snapshot_date").alias("later"), F.lit(m).alias("metric"), F.lag(m).over(w).cast("double").alias("before"), F.col(m).cast("double").alias("after")).filter("earlier IS NOT NULL")
            parts.append(part.withColumns({"delta": d, "direction": direction(d, low)}))
    return reduce(DataFrame.unionByName, parts)
