"""Spelling variants: words of a corpus that differ by one letter, and the form that each is a variant of.

Words are counted in the scan.  Near words are found by pivotal grams.  All two-letter grams of the vocabulary
are ordered by how many words hold them, the rarest first.  A word's prefix is its first three grams in that
order (and any that tie with the third); its pivots are two grams of the prefix that share no letter, chosen
by dynamic programming so that together they are in as few words as possible.  One edit can't touch both
pivots.  So of two words that are near, the one whose prefix ends first in the order has a pivot that stands
unchanged in the other word, and as it comes no later than that word's prefix ends, it stands in that prefix.
Its place there is limited: an edit behind the pivot leaves its place from the left as it was, an edit before
it leaves its place from the right, and with it all that is on that side.  Of the rest, one edit leaves its first or
its last letter as it is.  Pivots are thus joined with prefixes by gram, side, place and such a letter, and verified.

Defined results: a null text has no words; a null doc_id counts as the empty string where a run is hashed;
repeated rows count as often as they are there; ties between forms go to the least word in code-point order;
an empty table gives an empty result; texts and words may be of any length; other columns are not read.
"""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, written

#: A run of letters counts from this length on; it is what a shorter one can't be edited into a word from.
LEAST_LETTERS = 6
LEAST_COUNT = 5
#: One run in so many loses a letter before it is counted.
EVERY = 199
#: A form has this many times the occurrences of its variant, or more.
TIMES = 5
#: Rows of the gram index that a task lays out at once.
INDEX_ROWS = 20_000
#: Hashes of words' parts are polynomials at this base, modulo this prime; pairs that share one by chance are ruled out in the end.
_BASE, _PRIME = 1_000_003, (1 << 61) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word, n: the distinct words of at least so many letters and occurrences."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_letters},}}"), F.lit(0))).alias("run"),
    ).select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    spelled = hashed.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))
    return spelled.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def gram_order(vocabulary: DataFrame) -> dict[str, int]:
    """The place of every two-letter gram, the rarest first.  Letters are lower-case a-z and 64 others, so there are 8,100 grams at most."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2))))
    counts = vocabulary.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return {r["gram"]: i for i, r in enumerate(sorted(counts.collect(), key=lambda r: (r["n"], r["gram"])))}


def pivots(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The two of (position, cost) that share no letter and cost least together; places ascend.

    best[i] is the cheapest single gram among the first i, so each place is met with the best one that ends before it.
    """
    found, least, behind = None, None, 0
    for position, cost in places:
        while places[behind][0] + 2 <= position:
            if least is None or places[behind][1] < least[1]:
                least = places[behind]
            behind += 1
        if least is not None and (found is None or least[1] + cost < found[0]):
            found = (least[1] + cost, [least, (position, cost)])
    return found[1]


def _index(vocabulary: DataFrame, order: dict[str, int]) -> DataFrame:
    """The grams of prefixes: word, last (place of the prefix's last gram in the order), pivot, key.

    A key is a hash of side, size and what an edit on the other side of the gram leaves as it is: the part up to the
    gram, the gram included, and of the rest, in which the edit is, either the letter beside the gram or the outer one
    (neither, if there is no more than one letter).  A pivot has keys for each size that its partner may have.
    """
    arrow_batches(vocabulary.sparkSession)
    columns = ["word", "last", "pivot", "key"]

    def hashes(letters: str) -> list[int]:
        """Of every beginning of letters, the empty one first."""
        found = [1]
        for c in letters:
            found.append((found[-1] * _BASE + ord(c)) % _PRIME)
        return found

    def rows(word: str):
        size = len(word)
        ranks = [order[word[p : p + 2]] for p in range(size - 1)]
        last = sorted(ranks)[2]
        prefix = [(p, r) for p, r in enumerate(ranks) if r <= last]
        chosen = {p for p, _ in pivots(prefix)}
        lefts, rights = hashes(word), hashes(word[::-1])
        for p, _ in prefix:
            # An edit behind the gram leaves the left part, one before it the right part.
            ends = ((lefts[p + 2], size - p - 2, word[p + 2 : p + 3], word[-1]), (-rights[size - p], p, word[p - 1 : p], word[0]))
            for part, left, near, far in ends:
                stays = ([1] if left < 2 else []) + ([2 * ord(near) + 2, 2 * ord(far) + 3] if left else [])
                for partner in (size - 1, size, size + 1) if p in chosen else ():
                    yield from ((word, last, True, ((part * _BASE + partner) * _BASE + x) % _PRIME) for x in stays)
                yield from ((word, last, False, ((part * _BASE + size) * _BASE + x) % _PRIME) for x in stays)

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int64()]
        for batch in batches:
            found = (row for word in batch.column(0).to_pylist() for row in rows(word))
            while some := list(islice(found, INDEX_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], columns)

    return vocabulary.select("word").mapInArrow(run, "word string, last int, pivot boolean, key long")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """a, b: each pair of words (column word, distinct, of LEAST_LETTERS letters or more) one edit apart, once."""
    grams = written(_index(vocabulary, gram_order(vocabulary)), "grams")
    a, b = grams.filter("pivot").alias("a"), grams.filter("NOT pivot").alias("b")
    # The pivots are those of the word whose prefix ends first.
    ends_first = F.expr("a.last < b.last OR a.last = b.last AND a.word < b.word")
    met = a.hint("merge").join(b, (F.col("a.key") == F.col("b.key")) & ends_first)
    return met.select(F.col("a.word").alias("a"), F.col("b.word").alias("b")).filter(F.levenshtein("a", "b", 1) == 1).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: forms are followed to the last one, in doubling steps."""
    step, left = forms.select("word", F.col("form").alias("root")), 1
    while left:
        step = written(step, "roots")
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        step = step.join(onward.hint("merge"), "root", "left")
        left = step.filter("onward IS NOT NULL").limit(1).count()
        step = step.select("word", F.coalesce("onward", "root").alias("root"))
    return step


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, times: int = TIMES, every: int = EVERY) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    n_near: words one edit away.  form: the most frequent of them, if it has `times` the occurrences or more; root:
    forms followed to the last one, the word itself if it has none.
    """
    vocabulary = written(words(docs, LEAST_LETTERS, least_count, every), "words")
    pairs = written(near_pairs(vocabulary), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionAll(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    others = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(others.hint("merge"), "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other"))).alias("best"))
    form_n = -F.col("best.minus")
    joined = vocabulary.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form_n >= times * F.col("n"), F.struct(F.col("best.other").alias("word"), form_n.alias("n"))).alias("form"),
    )
    formed = written(joined.select("word", F.col("form.word").alias("form"), "n", "n_near", F.col("form.n").alias("form_n")), "forms")
    roots = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
