"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around the hits.

The lexicon is learned from labelled documents: words, and stems that begin several words of a text, that mark toxic
documents and stand there in ever new surroundings (a word that always follows the same word comes from copies
of one text).  Each word of a text
is matched with the trie of these terms under an edit distance of 1 (2 for long terms); the rows of the
distance table are the states of the Levenshtein automaton, and a branch of the trie is left when its state is dead.
Around each hit a window of words tells quotation (quotation marks, words of reporting) from abuse (words of
address).  Counts of hits by kind go into a logistic regression, with a prior under which quoted hits count nothing.

The lexicon and the regression are fitted on about MAX_SAMPLE labelled rows, by a hash of doc_id; everything
else covers all rows.

Defined results: a null or empty text has no hits and gets the score of a text without hits; a null doc_id is
held out; repeated rows each get a row; without labelled rows of both kinds the prior and an empty lexicon hold
(all scores are low); other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _Memo
from .common import arrow_batches, give_back, id_text, shuffle_partitions, written

#: Labelled rows that are learned from, about.
MAX_SAMPLE = 12_000
#: A term is in at least this share of the toxic documents that the commonest term is in; rarer words come from copies.
MIN_SHARE = 0.12
THRESHOLD = 0.7
WINDOW = 6

# Marks and words that tell quotation from abuse, and letters often written as other signs.
QUOTES = "\"“”„«»‹›`"
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes word words term terms phrase means meaning defined insult insults slur".split())
ADDRESS = frozenset("you your youre u ur he she they them him her".split())
LEET = str.maketrans("013457@$!|", "oieastasil")

STEMS = (5, 6, 7)
#: Marks a stem in the list of terms.
STEM = "*"

# Of 1, logs of the hits (all, the more the nearer; misspelled ones; both again in quotation), log of the distinct terms, log of the
# hits near words of address, log of the hits of stems, two or more hits of stems.
PRIOR = np.array([-3.0, 3.5, 0.0, 0.0, 0.0, 0.7, 0.5, 0.5, 1.5])
STIFFNESS = np.array([0.05, 0.3, 30.0, 3.0, 3.0, 0.3, 1.0, 0.3, 0.3])


def distance_allowed(term: str) -> int:
    return 2 if len(term) >= 8 else 1 if len(term) >= 4 else 0


def exchanged(word: str, at: int) -> str:
    """The word with the letters on both sides of this place exchanged."""
    return word[: at - 1] + word[at] + word[at - 1] + word[at + 1 :] if 0 < at < len(word) else word


class LexiconTrie:
    """The terms as a trie; `match` intersects it with a word's Levenshtein automaton."""

    def __init__(self, terms):
        self.root: dict = {}
        self.stems = tuple(sorted(t.removesuffix(STEM) for t in terms if t.endswith(STEM)))
        self.terms = frozenset(t for t in terms if not t.endswith(STEM))
        # With at most d edits, one of d + 1 parts of the term is in the word as it is: the first at its head, the last at
        # its end.  Only an exchange of the letters at a joint spoils two parts; the two parts so exchanged count as one.
        heads, tails, inner, whole = set(), set(), set(), set()
        for t in self.terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
            d, n = distance_allowed(t), len(t)
            cuts = [n * i // (d + 1) for i in range(d + 2)]
            heads.add(t[: cuts[1]])
            tails.add(t[cuts[d] :])
            if d == 1:
                whole.add(exchanged(t, cuts[1]))
            if d == 2:
                inner.add(t[cuts[1] : cuts[2]])
                heads.add(exchanged(t, cuts[1])[: cuts[2]])
                tails.add(exchanged(t, cuts[2])[cuts[1] :])
                whole.add(exchanged(exchanged(t, cuts[1]), cuts[2]))
        esc = lambda x: "|".join(map(re.escape, sorted(x)))
        self.hint = re.compile(f"^(?:{esc(heads)})|(?:{esc(tails)})$" + (f"|{esc(inner)}" if inner else "")) if self.terms else None
        self.whole = frozenset(whole)
        self.sizes = (min(map(len, self.terms), default=1) - 2, max(map(len, self.terms), default=0) + 2)

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, distance) of the nearest term within its allowed distance; ties go to the first in order of letters."""
        if word in self.terms:
            return word, 0
        if word.startswith(self.stems):
            return STEM, 0
        if not self.sizes[0] <= len(word) <= self.sizes[1] or self.hint is None or not (self.hint.search(word) or word in self.whole):
            return None
        best: tuple[int, str] | None = None
        n = len(word)
        stack = [(self.root, list(range(n + 1)), None, "")]
        while stack:
            node, row, older, before = stack.pop()
            for c, below in node.items():
                if c == "":
                    if row[n] <= distance_allowed(below) and (best is None or (row[n], below) < best):
                        best = (row[n], below)
                    continue
                left = row[0] + 1
                new = [left]
                for i in range(n):
                    a = row[i] + (word[i] != c)
                    if row[i + 1] + 1 < a:
                        a = row[i + 1] + 1
                    if left + 1 < a:
                        a = left + 1
                    if i and older and word[i] == before and word[i - 1] == c and older[i - 1] + 1 < a:
                        a = older[i - 1] + 1  # two letters exchanged
                    new.append(a)
                    left = a
                if min(new) <= 2:
                    stack.append((below, new, row, c))
        return (best[1], best[0]) if best else None


def plain(token: str) -> list[str]:
    """A token's words: compatibility forms, lower case, without marks around and within."""
    s = unicodedata.normalize("NFKC", token).casefold()
    return re.findall(r"[^\W_]+", s)


@dataclass
class ToxicityModel:
    terms: list[str]
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    #: Words of clean documents that happen to be like a term; they are no misspellings.
    clean: frozenset[str] = frozenset()

    def prepare(self):
        self.trie = LexiconTrie(self.terms)
        self.seen = _Memo(self._token)
        return self

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "clean": self.clean}

    def _token(self, token: bytes) -> tuple[tuple[str, int], ...]:
        """Hits within a token of bytes: (term, distance)."""
        text = token.decode("utf-8", "replace")
        hits = [m for w in plain(text) if w not in self.clean and (m := self.trie.match(w))]
        if not hits and not text.isalpha():
            # Letters written as other signs, and letters set apart by marks.
            hits = [(m[0], max(m[1], 1)) for w in plain(text.translate(LEET)) if (m := self.trie.match(w))]
            joined = re.sub(r"[\W\d_]+", "", text.casefold())
            if not hits and joined in self.trie.terms:
                hits = [(joined, 1)]
        return tuple(hits)

    def features(self, text: str) -> np.ndarray:
        tokens = text.encode("utf-8", "replace").lower().split()
        found = [(i, h) for i, h in enumerate(map(self.seen.__getitem__, tokens)) if h]
        x = np.zeros(len(PRIOR))
        x[0] = 1
        if not found:
            return x
        kinds, terms, address, stems = [0, 0, 0, 0], set(), 0, 0
        for i, hits in found:
            quoted, addressed = self._context(tokens, i)
            for term, d in hits:
                if term == STEM:
                    stems += not quoted
                    continue
                kinds[2 * quoted] += (1, 0.8, 0.5)[d]
                kinds[2 * quoted + 1] += d > 0
                if not quoted:
                    terms.add(term)
                    address += addressed
        x[1:5] = np.log1p(kinds)
        x[5:] = *np.log1p([len(terms), address, stems]), stems >= 2
        return x

    def _context(self, tokens: list[bytes], i: int) -> tuple[bool, bool]:
        """(quoted, with a word of address near) for the token at i."""
        near = [t.decode("utf-8", "replace") for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]]
        at = min(i, WINDOW)
        left, word, right = near[:at], near[at], near[at + 1 :]
        opens = any(t[0] in QUOTES for t in [*left, word]) and (word[0] in QUOTES or not any(t[-1] in QUOTES or t.rstrip(".,;:!?")[-1:] in QUOTES for t in left))
        closes = any(t.rstrip(".,;:!?")[-1:] in QUOTES for t in [word, *right] if t)
        words = {w for t in left[-3:] for w in plain(t)}
        quoted = opens and closes or bool(words & REPORTING)
        return quoted, bool({w for t in near for w in plain(t)} & ADDRESS)

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn the lexicon and the weights from labelled rows that are not held out."""
    arrow_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    chosen = marks.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = chosen.count()
    # About MAX_SAMPLE ids pass a bound on a hash, so no task sorts or collects them.
    chosen = chosen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, MAX_SAMPLE / max(n, 1)) * (1 << 20)))
    sample = id_text(docs).join(F.broadcast(chosen), "doc_id")  # about MAX_SAMPLE ids

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], []]
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, seen = re.findall(r"[^\W_]+", text.lower()), {}
                for w, b in zip(found, ["", *found]):
                    seen.setdefault(w, b)
                heads = Counter(w[:n] for w in found for n in STEMS if len(w) >= n)
                shown = {h + STEM for h, n in heads.items() if n >= 2}
                for w, b in zip(found, ["", *found]):
                    for n in STEMS:
                        if (h := w[:n] + STEM) in shown:
                            shown.discard(h)
                            seen[h] = b
                for w, b in seen.items():
                    if 4 <= len(w) <= 30:
                        out[0].append(w)
                        out[1].append(toxic)
                        out[2].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], ["word", "toxic", "before"])

    sample = written(sample.select("doc_id", "text", "toxic").repartition(shuffle_partitions(docs.sparkSession)), "toxicity-sample")
    seen = sample.select("text", "toxic").mapInArrow(words, "word string, toxic int, before string")
    totals = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel([])
    counts = seen.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"), F.approx_count_distinct(F.when(F.col("toxic") == 1, F.col("before"))).alias("ways"))
    counts = written(counts.filter("a + b >= 2"), "toxicity-words")
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    marking = counts.filter((F.col("a") >= max(3, n1 // 100)) & (odds >= 2.5) & (F.col("ways") >= 0.6 * F.col("a")))
    most = marking.agg(F.max("a")).first()[0] or 0
    terms = marking.filter(F.col("a") >= MIN_SHARE * most)
    chosen_terms: list[str] = []
    found = sorted(terms.select("a", "word").collect(), key=lambda r: (-r["a"], len(r["word"]), r["word"]))  # bounded by the sample
    for w in (r["word"] for r in found):  # a stem stands for the words and stems it begins; a whole word for stems of it
        body = w.removesuffix(STEM)
        if not any(body.startswith(c[:-1]) if c.endswith(STEM) else w != body and c.startswith(body) for c in chosen_terms):
            chosen_terms.append(w)
    model = ToxicityModel(sorted(chosen_terms))

    model.clean = frozenset(r["word"] for r in counts.filter(~F.col("word").endswith(STEM) & _near(model, F.col("word")) & (F.col("b") >= 2) & (F.col("b") * n1 > F.col("a") * n0 * 0.2)).select("word").collect())  # bounded by the sample

    def rows(batches):
        import pyarrow as pa

        give_back()
        m = model.prepare()
        for batch in batches:
            x = [m.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    got = sample.select("text", "toxic").mapInArrow(rows, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()  # at most one row for each of the sample
    if got:
        model.weights = logistic(np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got]), np.array([r["count"] for r in got]))
    return model


def _near(model: ToxicityModel, words):
    """Whether a word is like a term without being one."""

    @F.pandas_udf("boolean")
    def near(column: pd.Series) -> pd.Series:
        trie = LexiconTrie(model.terms)
        return pd.Series([bool((m := trie.match(w)) and m[1]) for w in column])

    return near(words)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights by Newton's method, with Gaussian priors at PRIOR of precision STIFFNESS."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - STIFFNESS * (w - PRIOR)
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(STIFFNESS)
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_column(model: ToxicityModel, text):
    """Scores of a text column, as a column."""
    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        if not hasattr(model, "trie"):
            give_back()
            model.prepare()
        return pd.Series([model.score(model.features(t)) for t in texts])

    return scores(F.coalesce(text.cast("string"), F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    arrow_batches(docs.sparkSession)
    scored = id_text(docs).select("doc_id", score_column(model, F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those whose score reaches THRESHOLD; columns as they are."""
    model = fit(docs, labels)
    arrow_batches(docs.sparkSession)
    return docs.filter(score_column(model, F.col("text")) < THRESHOLD)
