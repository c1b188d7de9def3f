"""Core numbers, connected components and bridges of the undirected dependency graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.lineage import apart, cut, cut_counted
from .graph import undirected


#: Rounds after which the pieces of a growing table are written as one.
COMPACT = 4


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))


def core_numbers(nodes: DataFrame, edges: DataFrame, sent: list[int] | None = None) -> DataFrame:
    """node_id, core: starts from degrees; a node takes the h-index of its neighbours' estimates, until none changes.

    A node keeps how many neighbours have which estimate.  Only nodes whose estimate fell tell their neighbours, so edges
    are read for those alone, and only nodes that are told take the h-index anew; the rows of the others are copied.
    sent: gets the number of rows told in each round.
    """
    both = cut(_both(undirected(edges)))
    first = both.groupBy("u").agg(F.count(F.lit(1)).alias("core"))
    told = both.join(first.select(F.col("u").alias("v"), "core"), "v").groupBy("u", F.col("core").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    seen = told.groupBy("u").agg(F.collect_list(F.struct("value", "n")).alias("seen"))  # a row for each estimate, not for each neighbour
    state, changed = _estimated(first.join(seen, "u"))
    while changed:
        fell = state.filter("core < was").select(F.col("u").alias("v"), "was", "core")
        told = both.join(fell, "v")
        news = told.select("u", F.explode(F.array(F.struct(F.col("was").alias("value"), F.lit(-1).alias("n")), F.struct(F.col("core").alias("value"), F.lit(1).alias("n")))).alias("x"))
        news = news.groupBy("u", "x.value").agg(F.sum("x.n").alias("n")).groupBy("u").agg(F.collect_list(F.struct("value", "n")).alias("news"))
        after = state.join(apart(news), "u", "left").select("u", "core", F.when(F.col("news").isNull(), F.col("seen")).otherwise(_summed("seen", "news")).alias("seen"))
        state, changed = _estimated(after)
        if sent is not None:
            sent.append(told.count())
    return nodes.select("node_id").join(state.select(F.col("u").alias("node_id"), "core"), "node_id", "left").na.fill(0, ["core"])


def _summed(a: str, b: str) -> Column:
    """Two lists of (value, n) as one, without what sums to 0; largest values first."""
    both = F.concat(F.col(a), F.col(b))
    values = F.sort_array(F.array_distinct(F.transform(both, lambda x: x["value"])), asc=False)
    sums = F.transform(values, lambda v: F.struct(v.alias("value"), F.aggregate(F.filter(both, lambda x: x["value"] == v), F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("n")))
    return F.filter(sums, lambda x: x["n"] > 0)


def _estimated(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows: u, core, seen -> written: u, core (at most the h-index of seen), was (the core before), seen; number of those that fell."""
    ordered = F.reverse(F.array_sort("seen"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("best"))
    step = lambda t, x: F.struct((t["n"] + x["n"]).alias("n"), F.greatest(t["best"], F.least(t["n"] + x["n"], x["value"])).alias("best"))
    changes = Observation()
    new = rows.select("u", F.least("core", F.aggregate(ordered, start, step)["best"]).alias("core"), F.col("core").alias("was"), "seen")
    return cut(new.observe(changes, F.count_if(F.col("core") < F.col("was")).alias("n"))), changes.get["n"]


def core_shells(cores: DataFrame) -> DataFrame:
    return cores.groupBy("core").agg(F.count(F.lit(1)).alias("n_nodes"))


def inner_core(cores: DataFrame) -> DataFrame:
    """Nodes of the greatest core number."""
    return cores.join(F.broadcast(cores.agg(F.max("core").alias("core"))), "core")  # one row


def bridge_share(found: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: bridges, undirected edges, share."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(found, "bridges").crossJoin(n(undirected(edges), "edges")).withColumn("share", F.round(F.col("bridges") / F.col("edges"), 4))  # one row each


def _star(edges: DataFrame, large: bool) -> DataFrame:
    near = _both(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(apart(least), "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(joined.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """pairs a, b -> node_id, component (least id), by alternating large and small stars; nodes with an edge only."""
    edges, state = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()), None
    while True:
        seen = Observation()
        edges = cut(_star(_star(edges, True), False).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")))
        now = seen.get
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node_id"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node_id"), F.col("v").alias("component")).distinct())


def _ends(edges: DataFrame) -> DataFrame:
    """u, e: each edge at both of its ends."""
    return edges.select(F.col("a").alias("u"), "e").unionAll(edges.select(F.col("b").alias("u"), "e"))


def _without_chains(edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame] | None:
    """Chains of nodes with two edges as one edge each: the edges (a, b, e) and which e have become which (node_id, component);
    none if fewer than `least` nodes are in chains.

    Edges that meet at such a node are linked, so a chain is a component of edges and is found in logarithmic rounds.
    A chain that comes back to its node, or is a ring, has no bridge and goes.
    """
    inner, n = cut_counted(_ends(edges).groupBy("u").agg(F.count(F.lit(1)).alias("d"), F.min("e").alias("a"), F.max("e").alias("b")).filter("d = 2"))
    if n < least:
        return None
    names = cut(components(inner.select("a", "b")))
    named = edges.join(names, F.col("e") == F.col("node_id"), "left").select("a", "b", F.coalesce("component", "e").alias("e"))
    outer = _ends(named).join(apart(inner.select("u")), "u", "left_anti")
    return cut(outer.groupBy("e").agg(F.min("u").alias("a"), F.max("u").alias("b")).filter("a <> b").select("a", "b", "e")), names


#: Leaves are pruned, and chains folded, while a round takes this share of the edges at least: rounds are logarithmic in number.
WORTH = 1 / 8


def bridges(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """a, b (a < b): edges whose removal disconnects their ends.

    An edge to a node of degree 1 is a bridge and is cut; the edges of a chain are all bridges or none, so chains are
    folded into one edge.  On what is left (few nodes have fewer than three edges) a breadth-first forest is grown from the
    least node of each component.  Every other edge gets two random 64-bit labels; a tree edge is a bridge exactly when
    the labels at the ends below it cancel out (up to a chance of 2**-128).  rounds: gets the edges before each round.
    """
    members = cut(undirected(edges).withColumn("e", F.monotonically_increasing_id()))  # e: the chain that an edge is part of
    kind = members.schema["a"].dataType
    rest, parts = members, []
    while True:
        leaf = _ends(rest).groupBy("u").agg(F.count(F.lit(1)).alias("d")).filter("d = 1").select("u")
        marked = rest.join(leaf.select(F.col("u").alias("a"), F.lit(True).alias("x")), "a", "left").join(apart(leaf.select(F.col("u").alias("b"), F.lit(True).alias("y"))), "b", "left")
        counts = Observation()
        marked = cut(marked.select("a", "b", "e", F.coalesce("x", "y", F.lit(False)).alias("leaf")).observe(counts, F.count_if("leaf").alias("pruned"), F.count_if(~F.col("leaf")).alias("left")))
        rest, pruned, left = marked.filter("NOT leaf").drop("leaf"), counts.get["pruned"], counts.get["left"]
        parts.append(members.join(marked.filter("leaf").select("e"), "e").select("a", "b"))
        if rounds is not None:
            rounds.append(pruned + left)
        if not left:
            break
        if pruned < WORTH * (pruned + left):
            folded = _without_chains(rest, max(1, WORTH * left))
            if folded is None:
                parts.append(_core_bridges(rest, members, kind))
                break
            rest, names = folded
            members = cut(members.join(names, F.col("e") == F.col("node_id"), "left").select("a", "b", F.coalesce("component", "e").alias("e")))
    return cut(reduce(DataFrame.unionAll, parts))


def _core_bridges(rest: DataFrame, members: DataFrame, kind) -> DataFrame:
    """a, b: the bridges among the edges rest (a, b, e), of which there may be several between two nodes."""
    both = cut(rest.select(F.col("a").alias("u"), F.col("b").alias("v"), "e").unionAll(rest.select(F.col("b").alias("u"), F.col("a").alias("v"), "e")))
    roots = components(rest.select("a", "b")).select(F.col("component").alias("node_id")).distinct()
    level = cut(roots.select("node_id", F.lit(None).cast(kind).alias("parent"), F.lit(None).cast("long").alias("e"), F.lit(0).alias("depth")))
    tree, depth, grown = level, 0, 1
    while grown:
        depth += 1
        nxt = both.join(level.select(F.col("node_id").alias("u")), "u").groupBy(F.col("v").alias("node_id")).agg(F.min(F.struct(F.col("u").alias("parent"), "e")).alias("x"))
        level, grown = cut_counted(nxt.join(apart(tree.select("node_id")), "node_id", "left_anti").select("node_id", "x.parent", "x.e", F.lit(depth).alias("depth")))
        tree = tree.unionByName(level)
        if depth % COMPACT == 0:  # what is scanned in a round stays a few tables
            tree = cut(tree)
    tree = cut(tree)
    chords = _ends(apart(rest).join(tree.select("e").filter("e IS NOT NULL"), "e", "left_anti"))
    sums = chords.groupBy(F.col("u").alias("node_id")).agg(*[F.bit_xor(F.xxhash64("e", F.lit(n))).alias(x) for n, x in ((1, "x"), (2, "y"))])
    known = cut(tree.join(sums, "node_id", "left").na.fill(0, ["x", "y"]))
    below, cutting = None, []
    for d in range(depth - 1, 0, -1):  # fold up the forest, deepest level first
        here = known.filter(F.col("depth") == d).select("node_id", "parent", "e", "x", "y")
        if below is not None:
            up = below.select(F.col("parent").alias("node_id"), "x", "y")
            here = here.join(apart(up.groupBy("node_id").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"))), "node_id", "left")
            here = here.select("node_id", "parent", "e", F.col("x").bitwiseXOR(F.coalesce("bx", F.lit(0))).alias("x"), F.col("y").bitwiseXOR(F.coalesce("by", F.lit(0))).alias("y"))
        below = cut(here)
        cutting.append(below.filter("x = 0 AND y = 0").select("e"))
    if not cutting:
        return members.limit(0).select("a", "b")
    return apart(members).join(reduce(DataFrame.unionAll, cutting), "e").select("a", "b")
