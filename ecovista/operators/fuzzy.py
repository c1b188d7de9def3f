"""Best match of titles by Ratcliff-Obershelp similarity.

The ratio is 2 M / T: T letters of both texts, M of them in blocks that follow one another in both.  All bounds below
are lossless for any pair of a ratio of c or more:

* lengths: the shorter text has at least c / (2 - c) of the longer one's letters;
* letters: at least c T / 2 are in common, counted by letter;
* edits: what is outside the blocks is at most (1 - c) T, and so is the edit distance;
* grams of q letters: between two blocks there is a letter of neither, so k blocks are at most 1 + T - 2 M, and their
  grams, M - (q - 1) k or more, at least ((q - 1/2) c - (q - 1)) T - (q - 1).  Two texts that share so many grams share
  one among the rarest of each.

Pairs in which one text is the other with a letter left out (T - 2 M = 1) are found by an equi-join on the texts without
one of their letters, whose rows grow with the texts only.  All other pairs of unequal texts have T - 2 M >= 2, and for a
title of n letters T is at most 2 n + T - 2 M, so their ratio is at most n / (n + 1); a title above it is settled.

The bound by grams has force only well above c = 2 (q - 1) / (2 q - 1), and long grams, which few texts share, need a high
c.  So the best match is searched from the top: equal texts, texts a letter apart, then at each of LEVELS by an index of
grams; a title whose best ratio reaches the level is settled, as all pairs of that ratio were found.  Titles left over,
with nothing so near to them, are compared at the cutoff itself.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import DEFAULT
from ..functions.lineage import cut, cut_counted

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Ratios at which an index of grams is asked before the cutoff, and the letters of a gram.
LEVELS = ((0.95, 4), (0.9, 3), (0.8, 2))
#: Grams known as frequent; all others count as rarer.  The order only steers the work.
FREQUENT = 4096
#: From this length on the ratio leaves out frequent letters, and equal texts need not have a ratio of 1.
LONG = 200


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


# Else filters on the ratio are moved below the joins that make the pairs, and it is computed there and once more for its column.
sequence_ratio = sequence_ratio.asNondeterministic()


def _sides(titles: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folded texts of both sides, each once: a, la; and b, lb with the first project that has it."""
    a = titles.select(F.lower("title").alias("a")).filter("a IS NOT NULL").distinct().withColumn("la", F.length("a"))
    b = projects.filter("project IS NOT NULL").groupBy(F.lower("project").alias("b")).agg(F.min(F.struct("ord", "project")).alias("first")).withColumn("lb", F.length("b"))
    return a, b


def _bounded(a: DataFrame, b: DataFrame, cutoff: float) -> DataFrame:
    """Pairs that the bounds by length and by letters allow."""
    lo = cutoff / (2 - cutoff)
    a, b = a.withColumn("ca", _letters("a")), b.withColumn("cb", _letters("b"))
    # An equi-join on each length a partner may have: no cross join.
    a = a.withColumn("lb", F.explode(F.sequence(F.ceil(F.col("la") * lo - 1e-9).cast("int"), F.floor(F.col("la") / lo + 1e-9).cast("int"))))
    common = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return a.hint("shuffle_hash").join(b, "lb").filter(2 * common >= cutoff * (F.col("la") + F.col("lb")) - 1e-9).select("a", "la", "b", "lb", "first")


def _letters(column: str) -> Column:
    """How often each of LETTERS is in a text, and how many others there are."""
    counts = [F.length(column) - F.length(F.replace(F.col(column), F.lit(c), F.lit(""))) for c in LETTERS]
    return F.array(*counts, F.length(F.regexp_replace(column, f"[{LETTERS}]", "")))


def grams(texts: DataFrame, text: str, q: int) -> DataFrame:
    """texts with g, the grams of q letters; those that repeat have a number, so that sets of them share what the texts share."""
    pieces = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(F.col(text), i, F.lit(q))))
    texts = texts.withColumn("g", F.when(F.length(text) >= q, pieces).otherwise(F.array().cast("array<string>")))
    return texts.withColumn("g", F.transform("g", lambda x, i: F.concat(x, (i + 1 - F.array_position("g", x)).cast("string"))))


def frequent_grams(a: DataFrame, b: DataFrame) -> DataFrame:
    """gram, c: the FREQUENT commonest grams."""
    counts = a.select(F.explode("g").alias("gram")).unionAll(b.select(F.explode("g").alias("gram"))).groupBy("gram")
    return counts.agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "gram").limit(FREQUENT)


def _shortened(texts: DataFrame, text: str, to: str) -> DataFrame:
    """texts (text and its length) with `to`: the text without one of its letters, each once."""
    x, length = F.col(text), F.col("l" + text)
    without = F.transform(F.sequence(F.lit(1), length), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, length)))
    return texts.filter(length > 0).select(text, "l" + text, F.explode(F.array_distinct(without)).alias(to))


def a_letter_apart(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs a, la, b, lb in which one text is the other with a letter left out; a: a, la; b: b, lb."""
    longer = _shortened(b.select("b", "lb"), "b", "a").join(a.select("a", "la").hint("shuffle_hash"), "a")
    shorter = _shortened(a.select("a", "la"), "a", "b").join(b.select("b", "lb").hint("shuffle_hash"), "b")
    return longer.select("a", "la", "b", "lb").unionAll(shorter.select("a", "la", "b", "lb"))


def _least_shared(level: float, q: int, letters: Column) -> Column:
    """The grams that a pair of so many letters at least shares."""
    return F.ceil(((q - 0.5) * level - (q - 1)) * letters - (q - 1) - 1e-9)


def _of_one(level: float, q: int, length: str) -> Column:
    """The same for all partners of a text of this length."""
    return _least_shared(level, q, F.col(length) * 2 / (2 - level))


def _rarest(texts: DataFrame, text: str, frequent: DataFrame, level: float, q: int) -> DataFrame:
    """gram, text, length: of each text the rarest grams, one of which every partner shares."""
    length = "l" + text
    rows = texts.select(text, length, F.explode("g").alias("gram")).join(F.broadcast(frequent), "gram", "left")  # FREQUENT rows at most
    order = Window.partitionBy(text).orderBy(F.coalesce("c", F.lit(0)), "gram")
    asked = F.col(length) - q + 2 - F.greatest(_of_one(level, q, length), F.lit(1))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= asked).select("gram", text, length)


def by_grams(a: DataFrame, b: DataFrame, level: float, q: int) -> DataFrame:
    """Pairs a, la, b, lb that an index of grams allows a ratio of level, for those of a (a, la) that it can decide on; b: b, lb."""
    a, b = cut(grams(a.filter(_of_one(level, q, "la") >= 1), "a", q)), cut(grams(b, "b", q))
    frequent = cut(frequent_grams(a, b))
    met = _rarest(a, "a", frequent, level, q).hint("merge").join(_rarest(b, "b", frequent, level, q), "gram")
    pairs = met.filter(2 * F.least("la", "lb") >= level * (F.col("la") + F.col("lb")) - 1e-9).select("a", "la", "b", "lb").distinct()
    both = pairs.hint("merge").join(a.select("a", F.col("g").alias("ga")), "a").hint("merge").join(b.select("b", F.col("g").alias("gb")), "b")
    return both.filter(F.size(F.array_intersect("ga", "gb")) >= _least_shared(level, q, F.col("la") + F.col("lb"))).select("a", "la", "b", "lb")


def candidates(pairs: DataFrame, level: float) -> DataFrame:
    """The pairs that the bound by edits leaves to be compared in Python."""
    return pairs.filter(F.levenshtein("a", "b") <= (1 - level) * (F.col("la") + F.col("lb")) + 1e-9)


def _compared(pairs: DataFrame, b: DataFrame, level: float) -> DataFrame:
    """a, m: of each text the best partner of a ratio of level or more."""
    found = candidates(pairs, level).withColumn("ratio", sequence_ratio("a", "b")).filter(F.col("ratio") >= level)
    return _best(found, b)


def _best(found: DataFrame, b: DataFrame) -> DataFrame:
    """a, m: of the pairs found, with their ratio, the best of each text."""
    found = found if "first" in found.columns else found.hint("merge").join(b.select("b", "first"), "b")
    return found.groupBy("a").agg(F.min(F.struct((-F.col("ratio")).alias("minus"), "first")).alias("m"))


def best_match(titles: DataFrame, projects: DataFrame, cutoff: float = DEFAULT.fuzzy_cutoff) -> DataFrame:
    """titles: title; projects: project, ord -> title, project, ratio: the best project at the cutoff or more; the first of equals.

    Titles and projects are compared in small letters; null matches nothing, an empty title only an empty project.
    """
    a, b = _sides(titles, projects)
    b = cut(b)
    equal = a.filter(f"la < {LONG}").hint("merge").join(b.select(F.col("b").alias("a"), "first"), "a").select("a", F.struct(F.lit(-1.0).alias("minus"), "first").alias("m"))
    done = [cut(equal)]
    left, n = cut_counted(a.hint("merge").join(done[0], "a", "left_anti"))
    if n:
        # Partners of these are under LONG as well.
        near = a_letter_apart(left.filter(f"la < {LONG - 1}"), b).withColumn("ratio", sequence_ratio("a", "b"))
        above = near.filter((F.col("ratio") > F.col("la") / (F.col("la") + 1) + 1e-12) & (F.col("ratio") >= cutoff))
        found, some = cut_counted(_best(above, b))
        if some:
            done.append(found)
            left, n = cut_counted(left.hint("merge").join(found, "a", "left_anti"))
    if n:
        for level, q in [(x, q) for x, q in LEVELS if x > cutoff]:
            found, some = cut_counted(_compared(by_grams(left, b, level, q), b, level))
            if some:
                done.append(found)
                left, n = cut_counted(left.hint("merge").join(found, "a", "left_anti"))
            if not n:
                break
    if n:
        decided = _of_one(cutoff, 2, "la") >= 1
        if cutoff > 2 / 3:
            done.append(_compared(by_grams(left, b, cutoff, 2), b, cutoff))
        done.append(_compared(_bounded(left.filter(~decided), b, cutoff), b, cutoff))
    best = done[0]
    for more in done[1:]:
        best = best.unionAll(more)
    out = titles.select("title").filter("title IS NOT NULL").distinct().withColumn("a", F.lower("title")).hint("merge").join(best, "a")
    return out.select("title", F.col("m.first.project").alias("project"), (-F.col("m.minus")).alias("ratio"))


def best_match_levenshtein(titles: DataFrame, projects: DataFrame, cutoff: float = DEFAULT.fuzzy_cutoff) -> DataFrame:
    """The same with 1 - edit distance / longer length."""
    a, b = _sides(titles, projects)
    pairs = _bounded(a, b, cutoff).withColumn("ratio", 1 - F.levenshtein("a", "b") / F.greatest("la", "lb")).filter(F.col("ratio") >= cutoff)
    best = pairs.groupBy("a").agg(F.min(F.struct((-F.col("ratio")).alias("minus"), "first")).alias("m"))
    out = titles.select("title").distinct().withColumn("a", F.lower("title")).hint("merge").join(best, "a")
    return out.select("title", F.col("m.first.project").alias("project"), F.round(-F.col("m.minus"), 6).alias("ratio"))
