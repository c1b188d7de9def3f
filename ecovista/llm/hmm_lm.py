"""A hidden Markov language model over words, trained by Baum-Welch with counts added up over partitions.

Each state emits symbols: the end of a text, each of the FREQUENT commonest words, and classes of all other
words (by a hash of their last letters).  Within a class a word's probability is its own count, by absolute
discounting, and what the discount takes from the seen words of a class is the probability of the one
unseen word of the class, as the base model has one.  So emission tables have a fixed size, while every word
of the corpus keeps its own count.

  1. Words of all training texts are counted: each task sends a row for each distinct word it has.
  2. Symbols of every text are written once (2 bytes a token), with the words outside the known ones.
  3. Expectation: each task runs the scaled forward and backward recursions over its training texts from end to
     end, many of a like length at once, and sends its expected counts (a table of fixed size).  Maximisation: the
     driver adds these tables up.
  4. Every text gets its exact likelihood by the scaled forward recursion over its whole length, plus the log
     probabilities of its words within their classes, looked up by a join on the word.

Defined results: a null or empty text is the end token alone; a null doc_id is held out; repeated rows count as
often as they are there and get a row each; without training texts the model is uniform over the symbols; a very long
text is one sequence, in training (28 bytes a token) as in scoring; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, by_size, id_text, most_frequent, written

FREQUENT = 16_384
#: Words the workers know the counts of without a join: the commonest.
KNOWN = 100_000
CLASSES = 1024
SYMBOLS = 1 + FREQUENT + CLASSES
STATES = 6
ROUNDS = 5
#: Tokens of texts that the expectation step takes at once, or one text; more of long ones, since a step of the
#: recursion costs much the same for few texts as for many.
BATCH_TOKENS = 400_000
LONG, LONG_TOKENS = 600, 2_000_000
#: Tokens it holds to find texts of a like length among (2 bytes each).
HELD_TOKENS = 10_000_000
#: Symbols (in bytes) that the forward recursion takes at once.
FORWARD_BYTES = 8 << 20
END = b"\n"  # no word is this


def word_class(word: bytes) -> int:
    """Symbol of a word that isn't frequent."""
    return 1 + FREQUENT + zlib.crc32(word[-3:]) % CLASSES


def words_of(text: str) -> list[bytes]:
    """Lower-case words; bytes' own white space is 0x20 and 0x09-0x0D, and their lower() changes A-Z only."""
    return text.encode("utf-8", "replace").lower().split()


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(True))


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    @classmethod
    def initial(cls, unigram: np.ndarray) -> Model:
        """States that stay, with emissions around the counts, each state with its own deviations."""
        rng = np.random.Generator(np.random.PCG64(7))
        emit = unigram[:, None] * rng.gamma(4.0, 0.25, (SYMBOLS, STATES))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
        """Maximisation, smoothed: every state keeps a little of the corpus's own distribution."""
        emit = emit + 20 * unigram[:, None]
        move = move + 0.1
        start = start + 0.1
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def expected(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions over whole texts, and their log likelihood."""
    texts = sorted((s for s in texts if len(s)), key=len, reverse=True)
    start, move, emit, total = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS, STATES)), 0.0
    at = 0
    b32, a32 = model.emit.astype(np.float32), model.move.astype(np.float32)
    while at < len(texts):
        longest = len(texts[at])
        group = texts[at : at + max(1, (LONG_TOKENS if longest > LONG else BATCH_TOKENS) // longest)]
        at += len(group)
        lengths = np.array([len(s) for s in group])
        alive = np.array([int((lengths > t).sum()) for t in range(longest)])
        seen = np.zeros((longest, len(group)), np.int64)
        for j, s in enumerate(group):
            seen[: len(s), j] = s
        alpha = np.empty((longest, len(group), STATES), np.float32)
        scale = np.ones((longest, len(group)), np.float32)
        a = model.start.astype(np.float32)[None] * b32[seen[0]]
        for t in range(longest):
            n = alive[t]
            if t:
                a = (a[:n] @ a32) * b32[seen[t, :n]]
            c = a.sum(axis=1)
            a = a / c[:, None]
            alpha[t, :n], scale[t, :n] = a, c
        total += float(np.log(scale, dtype=np.float64).sum())
        beta = np.ones((len(group), STATES), np.float32)
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            gamma = alpha[t, :n] * beta[:n]
            if t:
                w = b32[seen[t, :n]] * beta[:n] / scale[t, :n, None]
                move += alpha[t - 1, :n].T @ w
                beta[:n] = w @ a32.T
            else:
                start += gamma.sum(axis=0)
            alpha[t, :n] = gamma
        flat = np.arange(longest)[:, None] < lengths[None]
        symbols, gammas = seen[flat], alpha[flat]
        for k in range(STATES):
            emit[:, k] += np.bincount(symbols, weights=gammas[:, k], minlength=SYMBOLS)
    return start, move * model.move, emit, total


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Exact log10 likelihood of each symbol sequence: scaled forward recursion over its whole length."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    out = np.zeros(len(texts))
    if not len(order):
        return out
    flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    logs = np.zeros(len(order))
    n = int((lengths > 0).sum())
    a = np.broadcast_to(model.start, (n, STATES))
    t = 0
    while n:
        if t:
            a = a[:n] @ model.move
        a = a * model.emit[flat[begin[:n] + t]]
        c = a.sum(axis=1)
        a = a / c[:, None]
        logs[:n] += np.log10(c)
        t += 1
        while n and lengths[n - 1] <= t:
            n -= 1
    out[order] = logs
    return out


def _counts(docs: DataFrame) -> DataFrame:
    """word, c over all training texts, the end of a text included."""

    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words_of(text))
                held[END] += 1
            if len(held) > 500_000:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return docs.filter(~held_out(F.col("doc_id"))).select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _encoded(docs: DataFrame, known: list[tuple[bytes, int]], inner: np.ndarray) -> DataFrame:
    """Per row: doc_id, held, n_tokens, symbols (16-bit); of known words hits, base (sum of log10(c + 1)) and inner (sum of
    log probabilities within classes); rare words with their numbers. inner: by place in known."""

    def run(batches):
        import pyarrow as pa

        place = {w: i for i, (w, _) in enumerate(known)}
        symbol = np.array([0 if w == END else i + 1 if i < FREQUENT else word_class(w) for i, (w, _) in enumerate(known)] + [0], np.uint16)
        logs = np.array([np.log10(c + 1.0) for _, c in known] + [0.0])
        within = np.append(inner, 0.0)
        for batch in by_size(batches, 1):
            words: list[bytes] = []
            sizes = []
            for text in batch.column(1).to_pylist():
                own = words_of(text)
                words += own
                words.append(END)
                sizes.append(len(own) + 1)
            at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
            symbols = symbol[at]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rare: list[Counter] = [Counter() for _ in sizes]
            for i in np.flatnonzero(at < 0).tolist():
                w = words[i]
                rare[owner[i]][w] += 1
                symbols[i] = word_class(w)
            sums = lambda x: np.bincount(owner, weights=x[at] * (at >= 0), minlength=len(sizes))
            ends = np.cumsum(sizes)
            raw = symbols.astype("<u2").tobytes()
            flat = pa.StructArray.from_arrays([pa.array([w for r in rare for w in r], pa.binary()), pa.array([k for r in rare for k in r.values()], pa.int64())], ["w", "k"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)]), pa.int32()), flat)
            out = [
                pa.array(sizes, pa.int64()), pa.array([raw[2 * (e - n) : 2 * e] for e, n in zip(ends, sizes)], pa.binary()),
                pa.array(np.bincount(owner, weights=at >= 0, minlength=len(sizes)).astype(np.int64)), pa.array(sums(logs)), pa.array(sums(within)), lists,
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *out], ["doc_id", "held", "n_tokens", "symbols", "hits", "base", "inner", "rare"])

    schema = "doc_id long, held boolean, n_tokens long, symbols binary, hits long, base double, inner double, rare array<struct<w:binary,k:long>>"
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held")).mapInArrow(run, schema)


def train(encoded: DataFrame, unigram: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the training rows' symbols."""
    model = Model.initial(unigram)
    rows = encoded.filter("NOT held").select("symbols")
    for _ in range(rounds):

        def run(batches, model=model):
            import pyarrow as pa

            sums = None
            held: list[np.ndarray] = []
            size = 0

            def add():
                nonlocal sums, held, size
                got = expected(model, held)
                sums = got if sums is None else tuple(a + b for a, b in zip(sums, got))
                held, size = [], 0

            for batch in batches:
                for s in batch.column(0).to_pylist():
                    held.append(np.frombuffer(s, "<u2"))
                    size += len(held[-1])
                    if size >= HELD_TOKENS:
                        add()
            if held:
                add()
            if sums is not None:
                start, move, emit, total = sums
                table = np.concatenate((start, move.ravel(), emit.ravel(), [total]))
                at = np.flatnonzero(table)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(table[at], pa.float64())], ["at", "x"])

        sums = rows.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # a table of fixed size
        table = np.zeros(STATES + STATES * STATES + SYMBOLS * STATES + 1)
        table[sums["at"].to_numpy()] = sums["x"].to_numpy()
        start, move, emit, _ = np.split(table, np.cumsum([STATES, STATES * STATES, SYMBOLS * STATES]))
        model = model.update(start, move.reshape(STATES, STATES), emit.reshape(SYMBOLS, STATES), unigram)
    return model


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = id_text(docs)
    counts = written(_counts(docs), "word-counts")
    n, v, n1, n2 = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    top = most_frequent(counts.filter(F.col("word") != F.lit(END)), "c", KNOWN).toArrow()  # at most KNOWN rows
    known = sorted(zip((bytes(w) for w in top["word"].to_pylist()), top["c"].to_pylist()), key=lambda x: (-x[1], x[0]))
    ends = (counts.filter(F.col("word") == F.lit(END)).select("c").first() or [0])[0]
    # Totals of the classes: a table of fixed size.
    classes = _class_totals(counts, known[:FREQUENT])
    discount = min(0.9, n1 / (n1 + 2 * n2)) if n1 else 0.5
    unigram = np.zeros(SYMBOLS)
    unigram[0] = ends
    unigram[1 : 1 + min(FREQUENT, len(known))] = [c for _, c in known[:FREQUENT]]
    unigram[1 + FREQUENT :] = classes[:, 0]
    unigram = (unigram + 0.5) / (unigram + 0.5).sum()
    lost = np.where(classes[:, 1] > 0, np.log10(np.maximum(discount * classes[:, 1], 1e-300)), 0.0) if n else np.zeros(CLASSES)
    size = np.log10(np.maximum(classes[:, 0], 1))

    if ends:
        known.append((END, ends))
    # A frequent word and the end are symbols of their own; other known words have a probability within their class.
    inner = np.array([0.0 if i < FREQUENT or w == END else np.log10(c - discount) - size[word_class(w) - 1 - FREQUENT] for i, (w, c) in enumerate(known)])
    encoded = written(_encoded(docs, known, inner).withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = train(encoded, unigram, rounds)

    def forward(batches):
        import pyarrow as pa

        held: list = []
        size = 0

        def scored():
            rows = np.concatenate([b.column(0).to_numpy() for b in held])
            logs = log_likelihoods(model, [np.frombuffer(s, "<u2") for b in held for s in b.column(1).to_pylist()])
            inner = np.concatenate([b.column(2).to_numpy() for b in held])
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(logs + inner)], ["row", "known_score"])

        # Many texts at once: a step of the recursion costs much the same for few texts as for many.
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > FORWARD_BYTES:
                yield scored()
                held, size = [], 0
        if held:
            yield scored()

    scores = encoded.select("row", "symbols", "inner").mapInArrow(forward, "row long, known_score double")
    # Words that aren't among the known ones: looked up by a join.
    rare = encoded.select("row", F.explode("rare").alias("x")).select("row", F.col("x.w").alias("word"), F.col("x.k").alias("k"))
    met = rare.join(counts.hint("merge"), "word", "left").select("row", "k", F.coalesce("c", F.lit(0)).alias("c"), (F.crc32(F.substring("word", -3, 3)) % CLASSES).cast("int").alias("class"))
    lost_map, size_map = (F.array(*[F.lit(float(x)) for x in a]) for a in (lost, size))
    grouped = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("hits"),
        F.sum(F.col("k") * F.log10(F.col("c") + F.lit(1.0))).alias("base"),
        F.sum(F.when(F.col("c") > 0, F.col("k") * F.log10(F.col("c") - F.lit(discount))).otherwise(F.col("k") * F.element_at(lost_map, F.col("class") + 1)) - F.col("k") * F.element_at(size_map, F.col("class") + 1)).alias("rare_score"),
    )
    facts = encoded.select("row", "doc_id", "held", "n_tokens", F.col("hits").alias("hits0"), F.col("base").alias("base0"))
    joined = facts.join(scores.hint("merge"), "row").join(grouped.hint("merge"), "row", "left")
    zero = F.lit(0.0)
    return joined.select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("hits0") + F.coalesce("hits", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base0") + F.coalesce("base", zero) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("known_score") + F.coalesce("rare_score", zero)).alias("score"),
    )


def _class_totals(counts: DataFrame, frequent: list[tuple[bytes, int]]) -> np.ndarray:
    """For each class of words that aren't frequent: tokens and distinct words."""
    out = np.zeros((CLASSES, 2))
    for k, c, d in counts.filter(F.col("word") != F.lit(END)).groupBy((F.crc32(F.substring("word", -3, 3)) % CLASSES).alias("k")).agg(F.sum("c"), F.count(F.lit(1))).collect():
        out[k] = c, d
    for w, c in frequent:
        out[word_class(w) - 1 - FREQUENT] -= c, 1
    return out
