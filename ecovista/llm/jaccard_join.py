"""Jaccard join of documents on word n-grams: an exact join through a token-group matrix.

Documents with equal shingle sets are one class, found by a 128-bit digest of the set.  For the rest, sets are
ordered by one order of shingles for all, the common ones last; two sets of a similarity of 0.75 share a
shingle within the first n - ceil(0.75 n) + 1 (their prefixes).  On the shingles that more than one prefix has:

1. Grouping: each document is compared with one leader, a document that shares many shingles with it and with
   others; links found make groups of similar documents.
   Documents that were compared with one leader are told apart by how they differ from it: two of them, the first not
   linked with the leader, are linked only if they have most of the second's differences in common.
2. Matrix: for each shingle, the groups (by leader) that have it in the union of their members' prefixes, with the
   least and greatest set size.  The shingles of a document's prefix that are in a group's union bound its overlap with any
   member from above; only groups whose bound allows a link are opened, and within them only pairs whose own
   bound does.
3. Pairs left are compared on their whole shingle sets, and links make the components.

All bounds are lossless, so components are exact (up to equal 62-bit hashes of different shingles).  Hot
shingles are salted where rows are gathered; a group of copies of any size sends one row for each
task, and near copies are compared with leaders, not with one another.

Defined results: a document without words (or null) has no shingles and is a component of its own; one of 1 to 4
words has its whole sequence as one shingle; where ids are null or repeated, each row is a document of its own and a
component has the least id in it (null if there is none); repeated rows give repeated results; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, by_size, few, give_back, id_text, most_frequent, one_row_ids, without_ids, written
from .components import connected_components
from .text_kernel import distinct_sets, hash_words, mix, shingles, utf8

#: Shingles known as common; the order only steers the work, so the bound doesn't change results.
MAX_HOT = 200_000
#: A shingle is reported as common by a task that has it in so many documents.
LOCAL_HOT = 3
#: Shingles a task counts in one go.
CHUNK = 2_000_000
SALTS = 64
HOT = 1 << 62


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of texts as 62-bit numbers, by text."""
    offsets, hashes = shingles(hash_words(texts))
    return offsets, (hashes >> np.uint64(2)).astype(np.int64)


def _repeated(held: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that are there `least` times or more, ascending, and how often; empties held.  Sorted in place, so that a
    worker holds the values twice at most, and only those that repeat are made into arrays of their own."""
    tokens = np.concatenate(held)
    held.clear()
    tokens.sort()
    values = np.unique(tokens[: len(tokens) - least + 1][tokens[least - 1 :] == tokens[: len(tokens) - least + 1]]) if len(tokens) >= least else tokens[:0]
    return values, np.searchsorted(tokens, values, "right") - np.searchsorted(tokens, values, "left")


def common_shingles(docs: DataFrame) -> np.ndarray:
    """The commonest shingles, rarest first, as 62-bit numbers: counted over all documents, by task and then in all."""

    def run(batches):
        import pyarrow as pa

        give_back()
        held, size = [], 0

        def report():
            values, counts = _repeated(held, LOCAL_HOT)
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], ["token", "n"])

        for batch in by_size(batches, 0):
            offsets, tokens = _tokens(utf8(batch.column(0)))
            held.append(distinct_sets(offsets, tokens)[1])
            size += len(held[-1])
            if size >= CHUNK:
                yield report()
                size = 0
        if size:
            yield report()

    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = written(counts.filter(F.col("n") >= 2 * LOCAL_HOT), "common")
    top = sorted((r["n"], r["token"]) for r in most_frequent(counts, "n", MAX_HOT).collect())  # at most MAX_HOT rows
    return np.array([t for _, t in top], np.int64)


def _prefixes(docs: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """doc_id, n, k1, k2 (digest of the set), last (rank of the prefix's last shingle), prefix (null for a set the task has had)."""
    by_value = np.argsort(hot)
    values = hot[by_value]

    def run(batches):
        import pyarrow as pa

        give_back()
        seen: set = set()
        bits = np.zeros(1 << 22, bool)
        bits[values & ((1 << 22) - 1)] = True
        for batch in by_size(batches, 1):
            offsets, tokens = _tokens(utf8(batch.column(1)))
            maybe = np.flatnonzero(bits[tokens & ((1 << 22) - 1)])
            if len(maybe) and len(values):
                at = np.minimum(np.searchsorted(values, tokens[maybe]), len(values) - 1)
                same = values[at] == tokens[maybe]
                tokens[maybe[same]] = HOT + by_value[at[same]]
            count, k1, k2, last, prefixes = [], [], [], [], []
            for i, known in enumerate(batch.column(0).is_valid().to_pylist()):
                t = np.sort(tokens[offsets[i] : offsets[i + 1]])
                if len(t) > 1:
                    t = t[np.concatenate(([True], t[1:] != t[:-1]))]
                n = len(t)
                u = mix(t.astype(np.uint64))
                key = (int(u.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(u + np.uint64(n))).astype(np.int64)) if n else 0)
                count.append(n)
                k1.append(key[0])
                k2.append(key[1])
                p = n - -(-percent * n // 100) + 1 if n else 0
                last.append(int(t[p - 1]) if n else None)
                if n and known and key not in seen:  # a row without doc_id stands for no other
                    seen.add(key)
                    prefixes.append(t[:p])
                else:
                    prefixes.append(None)
            sizes = [0 if p is None else len(p) for p in prefixes]
            flat = np.concatenate([p for p in prefixes if p is not None] or [np.zeros(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(last, pa.int64()), lists],
                ["doc_id", "n", "k1", "k2", "last", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, last long, prefix array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its set of shingles."""

    def run(batches):
        import pyarrow as pa

        give_back()
        for batch in by_size(batches, 1):
            offsets, tokens = distinct_sets(*_tokens(utf8(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens, pa.int64()))], ["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens array<long>")


def verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets have percent * union <= 100 * intersection."""
    both = _with_sets(docs, pairs)
    common = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("i"), (F.size("a") + F.size("b")).alias("s"))
    return written(common.filter(f"100 * i >= {percent} * (s - i)").select("u", "v"), "links")


def compared(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Documents u compared with leaders v: linked, n (size of v's set), and the shingles in which they differ, extra (in u)
    and missing (in v); pairs that share less than half of the smaller set are left out, unless linked."""
    both = _with_sets(docs, pairs).withColumn("i", F.size(F.array_intersect("a", "b")))
    linked = (100 * F.col("i") >= percent * (F.size("a") + F.size("b") - F.col("i"))).alias("linked")
    near = both.filter((2 * F.col("i") >= F.least(F.size("a"), F.size("b"))))
    return written(near.select("u", "v", linked, F.size("b").alias("n"), F.array_except("a", "b").alias("extra"), F.array_except("b", "a").alias("missing")), "compared")


def _with_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) with the whole sets a and b."""
    pairs = written(pairs.select("u", "v").distinct(), "pairs")
    ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct()
    asked = docs.select("doc_id", "text").join(F.broadcast(ids) if few(ids) else ids.hint("merge"), "doc_id", "left_semi")
    sets = written(shingle_sets(asked), "sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("tokens").alias("a")).hint("merge"), "u")
    return left.join(sets.select(F.col("doc_id").alias("v"), F.col("tokens").alias("b")).hint("merge"), "v")


def _by_difference(found: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of documents of one leader, not both linked with it, from how they differ from it.

    Let b miss m of the leader's n shingles and have e others.  A document that is not linked with the leader, but with b,
    has more than m + p / (100 + p) * (e - m) of these m + e differences too: the leader itself lacks just that much to
    be linked with it, or more.  So it has one of any (m + e) - that number of them, and those that fewest documents of
    the leader have are asked.

    Sets of n - m + e shingles that have s differences in common share n - m - m' + s, so a link asks for a number of
    them that follows from the sizes.  On the first that both have, in the order of the rarest, as many must be left
    on both sides; and pairs that meet are decided by their differences alone, without a look at the texts.
    """
    p, q = percent, 100 + percent
    facts = found.select("v", "u", "linked", "n", F.size("extra").alias("e"), F.size("missing").alias("m"), F.concat(F.transform("extra", lambda t: F.struct(t.alias("token"), F.lit(True).alias("more"))), F.transform("missing", lambda t: F.struct(t.alias("token"), F.lit(False).alias("more")))).alias("d"))
    rows = facts.select("v", "u", "linked", "n", "e", "m", F.explode("d").alias("d")).select("v", "u", "linked", "n", "e", "m", "d.token", "d.more")
    key = ["v", "token", "more"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.bool_or(~F.col("linked")).alias("asked")).filter("c > 1 AND asked")
    # A difference that no other document has takes a place among the rarest without being asked for.
    shared = written(rows.join(counts.select(*key, "c").hint("merge"), key), "differences")
    held = shared.groupBy("u").agg(F.count(F.lit(1)).alias("held"))
    rarest = Window.partitionBy("u").orderBy("c", "token", "more")
    ranked = shared.join(held.hint("merge"), "u").withColumn("place", F.row_number().over(rarest) + F.col("e") + F.col("m") - F.col("held"))
    ranked = written(ranked.select(*key, "u", "linked", "n", "e", "m", (F.col("e") + F.col("m") - F.col("place") + 1).alias("left")), "ranked")
    side = lambda x: ranked.select(*key, "n", F.col("u").alias(x), *[F.col(c).alias(c + x) for c in ("linked", "e", "m", "left")])
    asking = side("b").filter(f"leftb > (100 * mb + {p} * eb) div {q}")
    met = asking.join(side("a").filter("NOT linkeda").drop("n").hint("merge"), key).filter("a <> b")
    na, nb = "(n - ma + ea)", "(n - mb + eb)"
    least = f"ceil({p} * ({na} + {nb}) / {q}) - n + ma + mb"
    met = met.filter(f"100 * least({na}, {nb}) >= {p} * greatest({na}, {nb}) AND least(lefta, leftb) >= {least}")
    pairs = met.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    differences = found.select("u", "n", "extra", "missing")
    of = lambda x: differences.select(F.col("u").alias(x), F.col("n").alias(f"n{x}"), F.col("extra").alias(f"e{x}"), F.col("missing").alias(f"m{x}")).hint("merge")
    both = pairs.join(of("u"), "u").join(of("v").drop("nv"), "v")
    common = "nu - size(mu) - size(mv) + size(array_intersect(mu, mv)) + size(array_intersect(eu, ev))"
    return both.selectExpr("u", "v", f"{common} AS i", "2 * nu - size(mu) + size(eu) - size(mv) + size(ev) AS s").filter(f"100 * i >= {p} * (s - i)").select("u", "v")


def jaccard_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    docs, row = one_row_ids(docs)
    if row == "doc_id":
        return _components(id_text(docs), percent)
    ranked = _ranked(docs, row, percent)
    names = ranked.groupBy("component_id").agg(F.min("rank.doc_id").alias("name"))
    return ranked.join(names.hint("merge"), "component_id").select("rank.doc_id", "n_shingles", F.col("name").alias("component_id"))


def _ranked(docs: DataFrame, row: str, percent: int) -> DataFrame:
    """For rows that only the column `row` tells apart: n_shingles, component_id (a row), rank (no id, doc_id, row)."""
    found = _components(docs.select(F.col(row).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), percent)
    found = written(found.withColumnRenamed("doc_id", "row"), "near")
    doc_id = F.col("doc_id").cast("long")
    ranks = docs.select(F.col(row).alias("row"), F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), F.col(row).alias("row")).alias("rank"))
    return found.join(ranks.hint("merge"), "row")


def _components(docs: DataFrame, percent: int) -> DataFrame:
    """The same for documents (doc_id, text) whose ids are neither null nor repeated."""
    arrow_batches(docs.sparkSession)
    sets = written(_prefixes(docs, common_shingles(docs), percent), "prefixes")
    facts = sets.select("doc_id", "n", "k1", "k2", "last").filter("doc_id IS NOT NULL AND n > 0")
    # Copies: one row for each task and digest arrives where a digest is gathered.
    heads = facts.groupBy("k1", "k2").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("k1", "k2", "v")
    copies = facts.select("doc_id", "k1", "k2").join(heads.hint("merge"), ["k1", "k2"]).select(F.col("doc_id").alias("u"), "v").filter("u <> v")

    rows = sets.filter("doc_id IS NOT NULL").select("doc_id", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "doc_id", (F.col("n") - F.col("pos")).alias("left"))
    salt = F.when(F.col("token") >= HOT, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0))
    counted = rows.withColumn("others", F.count(F.lit(1)).over(Window.partitionBy("token", salt)))
    shared = written(counted.filter((F.col("others") > 1) | (F.col("token") >= HOT)).select("token", "doc_id", "left"), "shared")

    weights = shared.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    nodes = written(weights.join(facts.groupBy("doc_id").agg(F.max("n").alias("n"), F.max("last").alias("last")).hint("merge"), "doc_id").select("doc_id", "n", "last", (F.col("c") / F.col("n")).alias("weight")), "nodes")
    placed = shared.join(nodes.hint("merge"), "doc_id")
    leaders = placed.groupBy("token").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"))).alias("best")).select("token", (-F.col("best.minus")).alias("leader"))
    chosen = shared.join(leaders.hint("merge"), "token").filter("doc_id <> leader").groupBy("doc_id", "leader").count()
    best = chosen.groupBy("doc_id").agg(F.max(F.struct("count", (-F.col("leader")).alias("minus"))).alias("best")).select(F.col("doc_id").alias("u"), (-F.col("best.minus")).alias("v"))
    found = compared(docs, _sized(best, nodes, percent), percent)
    links = found.filter("linked").select("u", "v")

    groups = written(connected_components(links.unionAll(copies)), "groups")
    leaders = found.select(F.col("u").alias("doc_id"), F.col("v").alias("lead"))
    more = verified(docs, _across(shared, nodes, groups, percent, leaders), percent).unionAll(written(_by_difference(found, percent), "links"))
    if not more.isEmpty():
        groups = connected_components(links.unionAll(more).unionAll(copies))
    names = groups.select(F.col("node").alias("doc_id"), "component").distinct()
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(names.hint("merge"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _sized(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose sizes allow a link."""
    n = nodes.select("doc_id", "n")
    found = pairs.join(n.select(F.col("doc_id").alias("u"), F.col("n").alias("nu")).hint("merge"), "u").join(n.select(F.col("doc_id").alias("v"), F.col("n").alias("nv")).hint("merge"), "v")
    return found.filter(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)").select("u", "v")


def _across(shared: DataFrame, nodes: DataFrame, groups: DataFrame, percent: int, leaders: DataFrame | None = None) -> DataFrame:
    """Pairs of documents of different groups that the bounds allow to be linked; documents of one leader, and their
    leader, were compared before, so a group is divided by leader.

    `left` is the number of a set's shingles from this one to its end in the common order.  The first shingle that two
    linked sets share has at least the needed overlap left in both; common shingles come last, so most sets that hold
    a passage of the many have too little left there and neither ask nor are asked on it.  Of two groups the smaller
    one asks, so that a large group is met once for each asking document, not by each of its members.
    """
    p, q = percent, 100 + percent
    member = nodes.join(groups.select(F.col("node").alias("doc_id"), "component").distinct().hint("merge"), "doc_id", "left").select("doc_id", "n", "last", F.coalesce("component", "doc_id").alias("grp"))
    member = member.withColumn("lead", F.col("doc_id")) if leaders is None else member.join(leaders.hint("merge"), "doc_id", "left").withColumn("lead", F.coalesce("lead", "doc_id"))
    sizes = member.groupBy("grp", "lead").agg(F.count(F.lit(1)).alias("docs"))
    member = member.join(sizes.hint("merge"), ["grp", "lead"])
    cells = shared.join(member.hint("merge"), "doc_id")
    several = cells.groupBy("token").agg((F.min("grp") < F.max("grp")).alias("more")).filter("more").select("token")
    cells = written(cells.join(several.hint("merge"), "token", "left_semi"), "cells")
    matrix = cells.groupBy("token", "grp", "lead", "docs").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("left").alias("most"), F.count(F.lit(1)).alias("members"))
    matrix = matrix.select("token", F.struct("grp", "lead").alias("other"), F.col("docs").alias("others"), "low", "high", "most", "members")
    fits = f"100 * high >= {p} * n AND 100 * n >= {p} * low"
    least = f"ceil({p} * (n + greatest(low, ceil(n * {p} / 100))) / {q})"
    first = f"grp <> other.grp AND lead <> other.lead AND (docs < others OR docs = others AND grp < other.grp) AND least(left, most) >= {least}"
    asked = cells.join(matrix.hint("merge"), "token").filter(first).filter(fits).select("doc_id", "n", "other").distinct()
    asked = written(asked, "asked")
    # A member's size is within [low, high] and within what the document's own size allows; the overlap needed falls
    # with the member's size, and so does what both may share behind their prefixes.
    low, high = f"greatest(min(low), ceil(n * {p} / 100))", f"least(max(high), floor(n * 100 / {p}))"
    need = f"least({_need(p, q, 'n', low)}, {_need(p, q, 'n', high)}, {_need(p, q, 'n', 'n')})"
    rows = cells.select("token", "doc_id", "left").join(asked.hint("merge"), "doc_id").join(matrix.hint("merge"), ["token", "other"]).filter(fits)
    opened = rows.groupBy("doc_id", "n", "other").agg(F.count(F.lit(1)).alias("m"), F.expr(need).alias("need")).filter("m >= need").select("doc_id", "n", "other")
    # Within an opened group, a member is met on the first shingle that both have.
    ask = cells.select("token", "doc_id", "left").join(opened.hint("merge"), "doc_id")
    members = cells.select("token", F.struct("grp", "lead").alias("other"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("left").alias("leftb"))
    met = ask.join(members.hint("merge"), ["token", "other"]).filter(f"100 * least(n, nb) >= {p} * greatest(n, nb) AND least(left, leftb) >= ceil({p} * (n + nb) / {q})")
    pairs = met.select(F.greatest("doc_id", "b").alias("u"), F.least("doc_id", "b").alias("v")).distinct()
    # The shingles that both prefixes have, against what the pair's own sizes ask for: all shingles of the prefix that
    # ends first are in the other's prefix or not in it at all.
    heads = cells.groupBy("doc_id").agg(F.collect_list("token").alias("t"), F.first("n").alias("n"), F.first("last").alias("last"))
    side = lambda x: heads.select(F.col("doc_id").alias(x), F.col("t").alias(f"t{x}"), F.col("n").alias(f"n{x}"), F.col("last").alias(f"l{x}")).hint("merge")
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    own = f"ceil({p} * (nu + nv) / {q}) - (ceil({p} * IF(lu <= lv, nu, nv) / 100) - 1)"
    return both.filter(f"size(array_intersect(tu, tv)) >= {own}").select("u", "v")


def _need(p: int, q: int, n: str, other: str) -> str:
    """The least number of prefix shingles that sets of these sizes share if they are linked."""
    return f"ceil({p} * ({n} + {other}) / {q}) - ceil({p} * greatest({n}, {other}) / 100)"


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with one document of each group (the one whose id names it); columns as they are.

    Where ids are null or repeated, each row is judged by its own text: the row with the least id stays, of several
    the first; rows without an id come last.
    """
    numbered, row = one_row_ids(docs)
    if row == "doc_id":
        found = written(_components(id_text(docs), percent), "near")
        return without_ids(docs, found.filter("doc_id <> component_id").select("doc_id"))
    ranked = _ranked(numbered, row, percent)
    best = ranked.groupBy("component_id").agg(F.min("rank").alias("best"))
    dropped = ranked.join(best.hint("merge"), "component_id").filter("rank <> best").select(F.col("rank.row"))
    return without_ids(numbered, written(dropped, "dropped"), row).drop(row)
