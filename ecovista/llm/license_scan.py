"""Licences: paragraphs classified by a sparse logistic regression on word n-grams, confirmed by templates.

A paragraph is a run of lines that aren't blank, however its lines are broken; it is read sentence by sentence.  A
sentence is looked at if it has a word that the templates have and the corpus hardly has (learned, so no statement
depends on a fixed list of cues).  Its features, or those of it in the middle of its neighbours' words, are words
and pairs of words.  The classifier is trained here: on names of licences with their versions in the frames in
which they are named, on paragraphs of the licences' texts, on both with words dropped, exchanged and put in; on
made-up licences' names in the same frames (the class of other licences); and on all lines of the corpus in
paragraphs that don't speak of licences, in windows of WINDOW_WORDS words.  These are dealt into shards by a hash; each shard trains on the
statements and on its own windows, which together weigh as NEGATIVES statements do, and the shards' weights are averaged
(exactly, as whole numbers).  Which words the corpus has, and how often, is counted over all windows as well.  There is
one weight vector for each family.  Probabilities are calibrated on statements and windows held out of training (a
temperature).  The bound under which a statement that speaks of licensing is of the unknown
class is set on statements of real licences that are in no family and not trained on: at most one in ten of them
may pass.  A prediction is confirmed by word pairs: by the share of a template's that the statement has, or of the
statement's that a template has; and a version that is named must be one that the family has.  Sentences of one
family next to each other are one row, unless their versions differ.

Defined results: texts without licence statements, null texts and null ids give no row, or a row with null doc_id
in the last case; repeated rows repeat; very long paragraphs are read whole; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _Memo
from .common import arrow_batches, id_text, most_frequent, written
from .licence_texts import NAMES, OTHERS, TEXTS

#: How a statement names a licence, and how it adds a version to the name.
FRAMES = ["{}", "Licensed under the {}.", "Released under the {}.", "Distributed under the terms of the {}.", "This work is licensed under the {}.", "Available under {}", "The code is published under {} terms.", "License: {}"]
VERSIONED = ["{}, version {}", "{}, v. {}", "{} {}", "{} v{}"]
FAMILIES = [*NAMES, "other", "none"]
OTHER, NONE = len(NAMES), len(NAMES) + 1
#: Statements of made-up licences that the class of other licences is trained on.
MADE_UP = 400
#: Beginnings of words by which a statement of no known family still speaks of licensing.
LICENSING = ("licen", "copyright", "copyleft", "spdx")
BUCKETS = 1 << 14
#: What all windows of the corpus weigh together, in statements; fewer windows weigh one each.  A word that less than one in so many windows has hardly is in the corpus.
NEGATIVES = 3000
#: Windows of a shard, about; how much of their weight is one step of training; the share that is held out.
SHARD = 100_000
STEP = 4
HELD = 5
EPOCHS = 6
#: Words of the corpus that are put between those of statements: the most frequent ones.
FILLER = 20_000
#: Words that are counted in a task before they are passed on.
COUNTED = 200_000
HEATS = (0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0)
#: Weights are averaged as whole numbers of this part of one, so that no order of adding matters.
UNIT = 2.0**-32
COPIES = 6
#: The least bound of the unknown class, and the share of other licences' statements that may pass the one set on them.
LEAST = 0.5
FALSE_SHARE = 0.1
CONFIRM = 0.5
#: Words of a sentence that are classified together; a longer sentence is cut, with half of it as overlap.
WINDOW_WORDS = 60
_PARAGRAPH = re.compile(r"(?:[^\n]*\S[^\n]*(?:\n|$))+")
_SENTENCE = re.compile(r"(?<=[.;:!?])\s+(?=[\"'(\[]?[A-Z])|$")
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def sentences(paragraph: str):
    """(start, end) of a paragraph's sentences, in order."""
    at = 0
    for m in _SENTENCE.finditer(paragraph):
        if m.start() > at:
            yield at, m.start()
        at = m.end()


def features(words: list[str]) -> np.ndarray:
    """Buckets of words and pairs of neighbouring words."""
    grams = {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}
    return np.array(sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams}), np.int64)


def plain_version(text: str) -> str:
    """A version as it is compared: without zeros at its end."""
    return re.sub(r"(\.0)+$", "", text)


def joined_names(family: str) -> list[str]:
    """Identifiers with a version behind a v."""
    _, identifiers, versions = NAMES[family]
    return [f"{i}v{plain_version(v)}" for i in identifiers for v in versions if "-" not in i + v]


def statements_of(family: str) -> list[str]:
    """The names of a family in all frames, with and without its versions, and its identifiers."""
    names, identifiers, versions = NAMES[family]
    clauses = [v for v in versions if v.endswith("clause")]
    numbers = [v for v in versions if v not in clauses]
    called = [*names, *(how.format(n, v.removesuffix(".0") if k % 2 else v) for n in names for k, v in enumerate(numbers) for how in VERSIONED)]
    out = [FRAMES[k % len(FRAMES)].format(c) for k, c in enumerate(called)] + [f.format(n) for n in [*names, *joined_names(family)] for f in FRAMES]
    spdx = [*(i for i in identifiers if not numbers), *(f"{i}-{v}{tail}" for i in identifiers for v in numbers for tail in (("", "-only", "-or-later") if "GPL" in i else ("",)))]
    return out + [f"SPDX-License-Identifier: {i}" for i in spdx] + spdx


def windows(words: list[str]) -> list[list[str]]:
    """The words in windows of WINDOW_WORDS that overlap by half."""
    half = WINDOW_WORDS // 2
    return [words[i : i + WINDOW_WORDS] for i in range(0, max(1, len(words) - half), half)]


class Windows:
    """Windows of the corpus's lines, laid out for training: the features of all behind each other, in steps."""

    def __init__(self, rows: list[np.ndarray], size: int):
        self.steps = []
        for i in range(0, len(rows), size):
            part = rows[i : i + size]
            counts = np.array([len(x) for x in part])
            flat = np.concatenate(part)
            columns, local = np.unique(flat, return_inverse=True)
            order = np.argsort(local, kind="stable")
            owner = np.repeat(np.arange(len(part)), counts)[order]
            self.steps.append((columns, local, np.concatenate(([0], np.cumsum(counts)[:-1])), np.maximum(1.0, np.sqrt(counts) / 3)[:, None], owner, np.searchsorted(local[order], np.arange(len(columns)))))

    @staticmethod
    def logits(step: tuple, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        columns, local, begins, scale, _, _ = step
        return np.add.reduceat(weights[columns][local], begins, axis=0) / scale + bias


def _softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class LicenceModel:
    """A multinomial logistic regression over hashed features, with a temperature."""

    def __init__(self, negatives: list[str]):
        """Trained on lines that are given; see fit for those of a table."""
        lines = [w for t in negatives for w in windows(words_of(t)) if w]
        counts = Counter(w for x in lines for w in x)
        self.prepare(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:FILLER], len(lines))
        rows = [features(w) for w in lines]
        held = [zlib.crc32(" ".join(w).encode()) % HELD == 0 for w in lines]
        self.weights, self.bias = self.train([x for x, h in zip(rows, held) if not h])
        self.finish(self.losses([x for x, h in zip(rows, held) if h]) * UNIT, counts)

    def prepare(self, frequent: list[tuple[str, int]], n_windows: int) -> None:
        """Make the statements that are trained on: frequent are the corpus's most frequent words with their counts."""
        self.n_windows = n_windows
        self.share = min(1.0, NEGATIVES / max(n_windows, 1))  # what a window weighs
        rng = self.rng = random.Random(11)
        total = sum(n for _, n in frequent)
        filler = self.filler = [w for w, n in frequent for _ in range(max(1, FILLER * n // total))] or ["the"]
        rows, labels = [], []
        # What each family's statements read like: (words, version, whether they are of the licence's text).
        self.known = {f: [(words_of(t), None) for t in statements_of(f)] for f in NAMES}
        for f, texts in TEXTS.items():
            for text, version in texts:
                parts = [words_of(text[a:b]) for a, b in sentences(text)]
                self.known[f] += [(w, version) for part in [*parts, words_of(text)] for w in windows(part)]

        def train(base: list[str], label: int, copies: int) -> None:
            for k in range(copies):
                w = [x for x in base if not k or rng.random() > 0.08] or list(base)
                for _ in range(rng.randrange(0, 12) if k else 0):
                    w.insert(rng.choice((0, len(w))), rng.choice(filler))
                rows.append(features(w))
                labels.append(label)

        for y, family in enumerate(NAMES):
            for base, _ in self.known[family]:
                train(base, y, COPIES)
        ends = ("public license", "license", "licence", "open license", "software license", "free license", "public licence", "commons license")
        # Half of them end as the families' names do, where what is left is not a family's name itself.
        called = {n.lower() for ns, ids, _ in NAMES.values() for n in (*ns, *ids)}
        tails = sorted({t for n in called if (t := n.partition(" ")[2]) and not any(re.search(rf"\b{re.escape(c)}\b", t) for c in called)})
        for k in range(MADE_UP):
            name = " ".join([*rng.choices(filler, k=rng.randrange(1, 4)), rng.choice(ends if k % 4 < 2 else tails)])
            name = rng.choice(VERSIONED).format(name, f"{rng.randrange(1, 4)}.{rng.randrange(0, 3)}") if k % 2 else name
            train(words_of(FRAMES[1 + k % (len(FRAMES) - 1)].format(name)), OTHER, 2)
        order = list(range(len(rows)))
        rng.shuffle(order)
        cut = len(order) * 4 // 5
        self.training, self.held_out = ([(rows[i], labels[i]) for i in part] for part in (order[:cut], order[cut:]))

    def train(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(weights, bias) by stochastic descent over the statements and these windows, of which a step takes several."""
        share = max(self.share, min(1.0, NEGATIVES * (HELD - 1) / HELD / max(len(rows), 1)))
        steps = Windows(rows, max(1, round(STEP / share))).steps
        weights, bias = np.zeros((BUCKETS, len(FAMILIES))), np.zeros(len(FAMILIES))
        order = [(i, -1) for i in range(len(self.training))] + [(-1, i) for i in range(len(steps))]
        random.Random(11).shuffle(order)
        for epoch in range(EPOCHS):
            rate = 0.3 / (1 + epoch)
            for i, j in order:
                if i >= 0:
                    x, y = self.training[i]
                    scale = max(1.0, np.sqrt(len(x)) / 3)
                    p = self._softmax(weights[x].sum(axis=0) / scale + bias)
                    p[y] -= 1
                    weights[x] -= rate * p / scale
                    bias -= rate * p
                else:
                    columns, _, _, scale, owner, begins = steps[j]
                    p = _softmax_rows(Windows.logits(steps[j], weights, bias))
                    p[:, NONE] -= 1
                    weights[columns] -= rate * share * np.add.reduceat((p / scale)[owner], begins, axis=0)
                    bias -= rate * share * p.sum(axis=0)
        return weights, bias

    def losses(self, rows: list[np.ndarray]) -> np.ndarray:
        """The summed loss of windows held out of training under each of HEATS, each loss in whole UNITs."""
        out = np.zeros(len(HEATS), np.int64)
        for step in Windows(rows, 1000).steps:
            z = Windows.logits(step, self.weights, self.bias)
            out += [np.round(-np.log(_softmax_rows(z / heat)[:, NONE] + 1e-12) / UNIT).astype(np.int64).sum() for heat in HEATS]
        return out

    def template_words(self) -> set[str]:
        return {w for ws in self.known.values() for base, _ in ws for w in base if not w[0].isdigit()}

    def finish(self, losses: np.ndarray, counts: dict[str, int]) -> None:
        """The temperature, from the loss of the windows held out and the statements held out; cues and bound.  counts: how often
        the corpus has the templates' words."""
        rng, filler = self.rng, self.filler
        held = [(self._logits(x), y) for x, y in self.held_out]
        own = [-sum(np.log(self._softmax(z / heat)[y] + 1e-12) for z, y in held) for heat in HEATS]
        self.heat = HEATS[int(np.argmin(np.array(own) + self.share * losses))]
        usual = {w for w, n in counts.items() if n * self.share >= 1}
        del self.training, self.held_out, self.rng, self.filler  # not needed by the tasks that scan
        self.pairs = {f: [(set(zip(w, w[1:])) or {(x,) for x in w}, v) for w, v in ws] for f, ws in self.known.items()}
        # Names of one word confirm by themselves; identifiers, which may be other words as well, don't.
        self.own = {f: frozenset(w[0] for n in (*NAMES[f][0], *joined_names(f)) if len(w := words_of(n)) == 1) for f in NAMES}
        self.versions = {f: {plain_version(v): v for v in NAMES[f][2]} for f in NAMES}
        self.naming = {f: {"version", "v", "license", "licence", "by"} | {w for n in (*NAMES[f][0], *NAMES[f][1]) for w in words_of(n)} for f in NAMES}
        self.cues = frozenset(self.template_words() - usual)
        # The unknown class: other licences' statements, as they are and with words of the corpus around.
        strange = [words_of(f.format(n)) for n in OTHERS for f in FRAMES]
        strange += [[rng.choice(filler) for _ in range(4)] + w + [rng.choice(filler) for _ in range(4)] for w in strange]
        sure = sorted((float(p[:OTHER].max()) for w in strange if (p := self.probabilities(w)).argmax() < OTHER), reverse=True)
        self.bound = max([LEAST, *(x + 1e-9 for x in sure[int(FALSE_SHARE * len(strange)) :][:1])])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return self.weights[x].sum(axis=0) / max(1.0, np.sqrt(len(x)) / 3) + self.bias

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max())
        return e / e.sum()

    def probabilities(self, words: list[str]) -> np.ndarray:
        return self._softmax(self._logits(features(words)) / self.heat)

    def named_versions(self, words: list[str], family: str) -> set[str]:
        """Versions that the words give for a licence of this family: numbers behind its name, or joined to it."""
        found = set()
        for before, w in zip(["", *words], words):
            if family == "bsd":
                found |= {m[1] + "-clause" for m in [re.fullmatch(r"(?:bsd-)?(\d)-clause", w)] if m}
            elif m := re.fullmatch(r"(.*?)[-.]?v?(\d{1,2}(?:\.\d{1,2})*)(?:-only|-or-later)?", w):
                if m[1] in self.naming[family] if m[1] else before in self.naming[family]:
                    found.add(plain_version(m[2]))
        return found

    def classify(self, words: list[str]) -> tuple[str, float, float, str | None]:
        """(family, probability, share of word pairs, version); unknown if not sure, not confirmed or of a version that the family hasn't."""
        p = self.probabilities(words)
        best = int(p.argmax())
        if best == NONE:
            return "none", float(p[best]), 0.0, None
        share, version, fits = 0.0, None, True
        if best < OTHER:
            family = FAMILIES[best]
            pairs = set(zip(words, words[1:]))
            # The template that most of is there; of equals the one with a version.  One of a single word is by the share of the words that it is.
            whole = lambda t: len(pairs & t) / max(1, min(len(t), len(pairs))) if len(t) != 1 or len(next(iter(t))) == 2 else len(t & {(x,) for x in words}) / len(words)
            share, _, version = max((whole(t), v is not None, v or "") for t, v in self.pairs[family])
            share = 1.0 if not self.own[family].isdisjoint(words) else share
            named = self.named_versions(words, family) if self.versions[family] else set()
            fits = named <= self.versions[family].keys()
            version = ", ".join(sorted(self.versions[family].get(v, v) for v in named)) or version or None
        if best < OTHER and fits and p[best] >= self.bound and share >= CONFIRM:
            return FAMILIES[best], float(p[best]), share, version
        return ("unknown" if any(w.startswith(LICENSING) for w in words) else "none"), float(p[best]), share, None

    def statements(self, paragraph: str) -> list[tuple[int, int, str, float, float, str | None]]:
        """(start, end, family, probability, share, version) of a paragraph's licence statements; those of one family that meet are one."""
        parts = [(a, b, words_of(paragraph[a:b])) for a, b in sentences(paragraph)]
        out: list[tuple] = []
        for k, (a, b, words) in enumerate(parts):
            if self.cues.isdisjoint(words):
                continue
            # A sentence by itself, in its windows if it is long; if none tells, in the middle of its neighbours' words.
            best = max((self.classify(w) for w in windows(words) if not self.cues.isdisjoint(w)), key=_rank)
            room = WINDOW_WORDS - len(words)
            if best[0] in ("none", "unknown") and len(parts) > 1 and room > 0:
                before = parts[k - 1][2] if k else []
                before = before[max(0, len(before) - room // 2) :]
                after = parts[k + 1][2][: room - len(before)] if k + 1 < len(parts) else []
                best = max(best, self.classify([*before, *words, *after]), key=_rank)
            if best[0] == "none":
                continue
            if out and out[-1][2] == best[0] and out[-1][6] == k - 1 and len({out[-1][5], best[3]} - {None}) < 2:
                out[-1] = (out[-1][0], b, best[0], max(out[-1][3], best[1]), max(out[-1][4], best[2]), out[-1][5] or best[3], k)
            else:
                out.append((a, b, *best, k))
        return [x[:6] for x in out]


def _rank(found: tuple) -> tuple:
    """Families before the unknown class before none, then the more probable."""
    return found[0] != "none", found[0] != "unknown", found[1]


_speaks = re.compile("licen[sc]|copyright|rights reserved|creative commons|spdx|redistribut|public domain|permission")


def lines_windows(text: str):
    """(where it is, words) of the windows of all lines in paragraphs that speak of no licence."""
    for paragraph in _PARAGRAPH.finditer(text):
        if _speaks.search(paragraph.group().lower()):
            continue
        for k, line in enumerate(paragraph.group().split("\n")):
            for m, w in enumerate(windows(words_of(line)) if len(line) > 20 else ()):
                if w:
                    yield (paragraph.start(), k, m), w


def _with_tail(word: str) -> tuple[int, bytes]:
    """A word's checksum, and what follows another word's if this one stands behind it."""
    return zlib.crc32(word.encode()), b" " + word.encode()


def features_of(rows: list[list[str]], known: _Memo) -> list[np.ndarray]:
    """features of many windows at once."""
    values, sizes = [], []
    for words in rows:
        sums, tails = zip(*map(known.__getitem__, words))
        values += sums
        values += map(zlib.crc32, tails[1:], sums)  # the checksum of both words with a blank between them
        sizes.append(2 * len(words) - 1)
    owner = np.repeat(np.arange(len(rows)), sizes)
    both = np.unique(owner * BUCKETS + np.array(values, np.int64) % BUCKETS)
    return np.split(both % BUCKETS, np.searchsorted(both, np.arange(1, len(rows)) * BUCKETS))


def _featured(batches, held: bool):
    """(hashes of where they stand and what they read, features) of the windows that are held out of training, or of the others."""
    known = _Memo(_with_tail, COUNTED)
    for batch in batches:
        hashes, rows = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for at, w in lines_windows(text):
                h = zlib.crc32(f"{doc} {at} {' '.join(w)}".encode("utf-8", "replace"))
                if (h % HELD == 0) == held:
                    hashes.append(h)
                    rows.append(w)
            if len(rows) > 2000:
                yield hashes, features_of(rows, known)
                hashes, rows = [], []
        if rows:
            yield hashes, features_of(rows, known)


def _word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often the windows have each word; the null word is the number of windows."""

    def run(batches):
        import pyarrow as pa

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                for _, w in lines_windows(text):
                    counts.update(w)
                    counts[None] += 1
            if len(counts) > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> LicenceModel:
    """Train on the statements and on all lines of paragraphs that speak of no licence."""
    arrow_batches(docs.sparkSession)
    docs = id_text(docs)
    counts = written(_word_counts(docs), "licence-words")
    n = sum(r["n"] for r in counts.filter("word IS NULL").collect())  # one row at most
    counts = counts.filter("word IS NOT NULL")
    model = LicenceModel.__new__(LicenceModel)
    frequent = most_frequent(counts, "n", FILLER).collect()  # FILLER words at most
    model.prepare(sorted(((r["word"], r["n"]) for r in frequent), key=lambda x: (-x[1], x[0])), n)
    shards = -(-n // SHARD)
    names = [f"w{i}" for i in range(len(FAMILIES))]

    def windows_to_train(batches):
        import pyarrow as pa

        for hashes, rows in _featured(batches, False):
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array([x.astype("<u2").tobytes() for x in rows], pa.binary())], ["h", "x"])

    def train(shard):
        """A shard's weights in UNITs, a row for each bucket that isn't 0; the bias is behind the buckets."""
        import pyarrow as pa

        shard = shard.sort_by([("h", "ascending"), ("x", "ascending")])
        weights, bias = model.train([np.frombuffer(x, "<u2").astype(np.int64) for x in shard.column("x").to_pylist()])
        all_of = np.round(np.vstack((weights, bias)) / UNIT).astype(np.int64)
        at = np.flatnonzero(all_of.any(axis=1))
        return pa.table([pa.array(at), *(pa.array(all_of[at, i]) for i in range(len(FAMILIES)))], ["bucket", *names])

    dealt = docs.mapInArrow(windows_to_train, "h long, x binary").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(max(shards, 1))))
    trained = dealt.groupBy("shard").applyInArrow(train, ", ".join(f"{c} long" for c in ["bucket", *names]))
    sums = trained.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]).collect()  # BUCKETS + 1 rows at most
    whole = np.zeros((BUCKETS + 1, len(FAMILIES)))
    for r in sums:
        whole[r["bucket"]] = [r[c] * UNIT for c in names]
    if sums:  # each shard has a bias
        whole /= next(r["n"] for r in sums if r["bucket"] == BUCKETS)
    else:
        whole[:-1], whole[-1] = model.train([])
    model.weights, model.bias = whole[:-1], whole[-1]

    def losses(batches):
        import pyarrow as pa

        for _, rows in _featured(batches, True):
            # Whole parts of each loss, so that no order of adding matters.
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in model.losses(rows)], [f"l{i}" for i in range(len(HEATS))])

    lost = docs.mapInArrow(losses, ", ".join(f"l{i} long" for i in range(len(HEATS)))).agg(*[F.coalesce(F.sum(f"l{i}"), F.lit(0)).alias(f"l{i}") for i in range(len(HEATS))]).first()
    used = counts.filter(F.col("word").isin(sorted(model.template_words()))).collect()  # words of the templates only
    model.finish(np.array(lost) * UNIT, {r["word"]: r["n"] for r in used})
    return model


def scan_licences(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """One row per licence statement: doc_id, paragraph (its number), start_char, end_char, family, version (null: none named), probability, template_share."""
    model = model or fit(docs)
    arrow_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for number, m in enumerate(_PARAGRAPH.finditer(text)):
                    if model.cues.isdisjoint(words_of(m.group())):
                        continue
                    for a, b, family, p, share, version in model.statements(m.group()):
                        for column, x in zip(out, (doc, number, m.start() + a, m.start() + b, family, round(p, 6), round(share, 6), version)):
                            column.append(x)
            types = [pa.int64()] * 4 + [pa.string(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "paragraph", "start_char", "end_char", "family", "probability", "template_share", "version"])

    return id_text(docs).mapInArrow(run, "doc_id long, paragraph long, start_char long, end_char long, family string, probability double, template_share double, version string")
