"""Reachability over dependency edges: the closure, criticality, decay, union reach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.lineage import apart, cut, cut_counted


#: Edges from which the walks may be doubled, and how many rows a doubling may make for each pair there is.
LINEAR, WASTE = 4, 4
#: Direct dependents from which a node is a hub, and the parts its edges are dealt into.
HUB, SALTS = 100_000, 32
#: Tables of pairs after which they are written as one.
COMPACT = 8


def transitive_dependents(edges: DataFrame, made: list[int] | None = None) -> DataFrame:
    """(pkg, dependent): every node that reaches pkg over edges src -> dst, pkg itself left out even on cycles.

    Pairs come in order of their distance.  From those n edges apart, one more edge gives those n + 1 apart: a pair is made
    once for each of its last edges, so rows stay in proportion to the result however dense or cyclic the graph is.
    Along long chains that takes many rounds, so from LINEAR edges on pairs n apart are joined with all pairs found
    instead, which gives all up to 2 n apart, where counts say that this makes WASTE rows a pair at most.  Edges of
    hubs are dealt into SALTS parts, and pairs that end at one are met with each.  made: gets the rows of each round.
    """
    base = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    hubs = base.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HUB).select(F.col("dst").alias("hub"))
    salted = not hubs.isEmpty()
    if salted:
        base = cut(_with_hubs(base, hubs))
    pairs = base.select(F.col("dst").alias("pkg"), F.col("src").alias("dependent"), F.lit(1).alias("d"), *(["src_hub"] if salted else []))
    parts, front, reached = [pairs], pairs, 1
    while True:
        by = reached if reached >= LINEAR and _worth_doubling(front, parts) else 1
        if by > 1:
            low = reduce(DataFrame.unionAll, parts).select(F.col("pkg").alias("middle"), F.col("dependent").alias("end"), F.col("d").alias("more"), *([F.col("src_hub").alias("end_hub")] if salted else []))
            walks = front.select("pkg", F.col("dependent").alias("middle")).join(apart(low), "middle").select("pkg", F.col("end").alias("dependent"), (F.col("more") + reached).alias("d"), *([F.col("end_hub").alias("src_hub")] if salted else []))
        else:
            walks = _one_edge_on(front, base, salted).withColumn("d", F.lit(reached + 1))
        walks = walks.filter("pkg <> dependent")
        new = walks.groupBy("pkg", "dependent").agg(F.min("d").alias("d"), *([F.max("src_hub").alias("src_hub")] if salted else []))
        known = reduce(DataFrame.unionAll, [p.select("pkg", "dependent") for p in parts])
        part, grown = cut_counted(apart(new).join(known, ["pkg", "dependent"], "left_anti"))
        if made is not None:
            made.append(walks.count())
        if not grown:
            return reduce(DataFrame.unionAll, [p.select("pkg", "dependent") for p in parts])
        parts.append(part)
        reached += by
        front = part.filter(F.col("d") == reached)
        if len(parts) > COMPACT:
            parts = [cut(reduce(DataFrame.unionByName, parts))]


def _with_hubs(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """Edges with salt (their part, if dst is a hub) and src_hub."""
    to = edges.join(hubs.select(F.col("hub").alias("dst"), F.lit(True).alias("dst_hub")), "dst", "left").join(hubs.select(F.col("hub").alias("src"), F.lit(True).alias("src_hub")), "src", "left")
    return to.select("src", "dst", F.when(F.col("dst_hub"), F.pmod(F.xxhash64("src"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt"), F.coalesce("src_hub", F.lit(False)).alias("src_hub"))


def _one_edge_on(front: DataFrame, edges: DataFrame, salted: bool) -> DataFrame:
    if not salted:
        return front.select("pkg", F.col("dependent").alias("dst")).join(edges, "dst").select("pkg", F.col("src").alias("dependent"))
    parts = F.when(F.col("src_hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = front.select("pkg", F.col("dependent").alias("dst"), F.explode(parts).alias("salt"))
    return dealt.join(edges.hint("merge"), ["dst", "salt"]).select("pkg", F.col("src").alias("dependent"), "src_hub")


def _worth_doubling(front: DataFrame, parts: list[DataFrame]) -> bool:
    """Whether joining front with all pairs makes no more than WASTE rows for each pair found."""
    pairs = reduce(DataFrame.unionAll, [p.select("pkg", "dependent") for p in parts])
    ends = front.groupBy(F.col("dependent").alias("pkg")).agg(F.count(F.lit(1)).alias("a"))
    both = pairs.groupBy("pkg").agg(F.count(F.lit(1)).alias("b")).join(apart(ends), "pkg", "left")
    row = both.agg(F.sum(F.col("a") * F.col("b")).alias("rows"), F.sum("b").alias("found")).first()
    return (row["rows"] or 0) <= WASTE * (row["found"] or 0)


def criticality(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """node_id, criticality: its active transitive dependents; 0 for nodes without."""
    active = nodes.filter(F.coalesce("active", F.lit(False))).select(F.col("node_id").alias("dependent"))
    counts = closure.join(apart(active), "dependent", "left_semi").groupBy(F.col("pkg").alias("node_id")).agg(F.count(F.lit(1)).alias("criticality"))
    return nodes.select("node_id").join(apart(counts), "node_id", "left").na.fill(0, ["criticality"])


def decay_criticality(nodes: DataFrame, closure: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """node_id, decay_criticality: active dependents, each weighted exp(-days / decay_days); unknown age counts as 0 days."""
    active = nodes.filter(F.coalesce("active", F.lit(False))).select(F.col("node_id").alias("dependent"), F.exp(-F.coalesce("days_since_commit", F.lit(0)) / config.decay_days).alias("weight"))
    sums = closure.join(apart(active), "dependent").groupBy(F.col("pkg").alias("node_id")).agg(F.round(F.sum("weight"), 3).alias("decay_criticality"))
    return nodes.select("node_id").join(apart(sums), "node_id", "left").na.fill(0.0, ["decay_criticality"])


def union_reach(members: DataFrame, closure: DataFrame) -> DataFrame:
    """members: owner, node_id. Per owner the number of distinct dependents of its nodes, active or not."""
    reached = apart(members).join(closure.withColumnRenamed("pkg", "node_id"), "node_id").groupBy("owner").agg(F.count_distinct("dependent").alias("reach"))
    return members.select("owner").distinct().join(apart(reached), "owner", "left").na.fill(0, ["reach"])


def neighbourhood(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """Per package: direct and transitive dependents and dependencies."""
    parts = [
        edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("direct_dependents")),
        edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("direct_dependencies")),
        closure.groupBy(F.col("pkg").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("transitive_dependents")),
        closure.groupBy(F.col("dependent").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("transitive_dependencies")),
    ]
    names = ["direct_dependents", "direct_dependencies", "transitive_dependents", "transitive_dependencies"]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("node_id").agg(*[F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w) for w in names])


#: Relative standard error of a sketch of hll_sketch_agg's default size (2**12 registers).
SKETCH_ERROR = 1.04 / 2**6


def approximate_criticality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Criticality by sketches of neighbourhoods, without pairs: each node's sketch takes in those of its dependents until no node's estimate changes."""
    seed = nodes.withColumn("own", F.coalesce("active", F.lit(False)))
    state = cut(seed.groupBy("node_id").agg(F.hll_sketch_agg(F.when(F.col("own"), F.col("node_id"))).alias("sketch"), F.max("own").alias("own")).withColumn("changed", F.lit(True)))
    back = edges.filter("src <> dst").select("src", "dst").distinct()
    while not state.filter("changed").isEmpty():
        sent = apart(back).join(state.filter("changed").select(F.col("node_id").alias("src"), "sketch"), "src").select(F.col("dst").alias("node_id"), "sketch")
        grown = state.select("node_id", "sketch").unionByName(sent).groupBy("node_id").agg(F.hll_union_agg("sketch").alias("sketch"))
        before = state.select("node_id", "own", F.hll_sketch_estimate("sketch").alias("before"))
        state = cut(apart(grown).join(before, "node_id").select("node_id", "sketch", "own", (F.hll_sketch_estimate("sketch") != F.col("before")).alias("changed")))
    return state.select("node_id", F.greatest(F.hll_sketch_estimate("sketch") - F.col("own").cast("long"), F.lit(0)).alias("criticality"))
