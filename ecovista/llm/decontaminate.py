"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts are lower-cased and their white space is made single blanks.  Items are grouped by length (windows of a group
are PART of its items' letters, at most 1.25 times less); each item has windows at several of its word starts, and
windows of a group's length start at each word of a document.  A CGK random walk reads a window with a pointer that
stays or moves on by a random bit of step and letter; texts of a small edit distance then agree in most places of
what is read, so the edit distance becomes a Hamming distance.  Each of TABLES samples of PLACES places of the walks'
outputs, all within SPAN steps, is a key; a window with a key of an item is a candidate.  Candidates are verified
exactly: the least edit distance between the item and any substring near the window, by bit-parallel dynamic
programming.

Windows in which under SHARE of the 10-byte pieces are pieces of any item are left out before the walks: an edit
distance within MAX_EDIT seldom leaves so few in all windows of an item.  Recall is measured in the tests up to
MAX_EDIT, and for items without their head or tail.  The documents are only mapped over, never shuffled; items go to
the tasks in blocks of at most ITEM_BLOCK, whose size bounds what is broadcast; with several blocks, each one's result
is written before the next is read.

Defined results: null or empty texts and items match nothing; items of fewer than SHORT letters must be there as they
are, not as part of a longer word; a row for each document row and item, so repeated rows repeat; null ids stay null;
other columns are not read; very long texts are read whole, in parts of CHUNK letters' worth of documents; empty tables
give empty results.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, give_back, id_text, one_row_ids, without_ids, written

MAX_EDIT = 0.15
SHORT = 32
WALKS = 2
TABLES = 16
PLACES = 14
#: Steps of a walk that the places of one sample lie within: an edit spoils all places behind it until the walks of both
#: texts meet again, so places near one another agree together.
SPAN = 32
#: Windows of each item: of this share of its letters, at so many word starts spread over it.
PART = 0.7
ANCHORS = 6
#: Letters of a piece, and the least share of a window's pieces that items have too.
GRAM = 10
SHARE = 0.1
ITEM_BLOCK = 20_000
BITMAP = 1 << 23
#: Letters searched in one go.
CHUNK = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _grams(data: np.ndarray) -> np.ndarray:
    """Places in the bitmap of all GRAM-byte pieces of data (8 bytes and 2 more)."""
    n = len(data) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64)
    raw = data.tobytes()
    head, tail = np.ndarray((n,), "<u8", raw, 0, (1,)), np.ndarray((n,), "<u2", raw, 8, (1,))
    return ((head ^ tail.astype(np.uint64) << np.uint64(41)) * _MUL >> np.uint64(41)).astype(np.int64)


class _Walk:
    """CGK walks over windows of one length, and the sampled places of each table."""

    def __init__(self, length: int):
        rng = np.random.Generator(np.random.PCG64(length))
        self.length, self.steps = length, 3 * length
        self.moves = rng.integers(0, 2, (WALKS, self.steps, 256), dtype=np.uint8)
        # Walks read about half as many letters as they make steps; later places only show the padding.
        used = 2 * length
        begins = rng.integers(0, used - SPAN + 1, TABLES)
        self.samples = [(k % WALKS, begins[k] + np.sort(rng.choice(SPAN, PLACES, replace=False))) for k in range(TABLES)]
        self.needed = [sorted({int(p) for w, s in self.samples if w == walk for p in s}) for walk in range(WALKS)]
        self.weights = rng.integers(1, 2**63, PLACES, dtype=np.uint64) | np.uint64(1)

    def keys(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """tables x windows; data must go on for the window's length behind every start (zeros behind the text's end)."""
        out = np.empty((TABLES, len(starts)), np.uint64)
        end = starts + self.length
        for walk in range(WALKS):
            at = starts.copy()
            kept: dict[int, np.ndarray] = {}
            wanted = set(self.needed[walk])
            last = self.needed[walk][-1] if self.needed[walk] else -1
            for step in range(last + 1):
                letter = np.where(at < end, data[np.minimum(at, end - 1)], 0) if step >= self.length else data[at]
                if step in wanted:
                    kept[step] = letter
                at = at + self.moves[walk, step][letter]
            for k, (w, places) in enumerate(self.samples):
                if w == walk:
                    h = np.zeros(len(starts), np.uint64)
                    for weight, p in zip(self.weights, places):
                        h = (h ^ kept[int(p)].astype(np.uint64)) * weight
                        h ^= h >> np.uint64(29)
                    out[k] = h
        return out


def best_substring(pattern: str, text: str) -> tuple[int, int]:
    """(edit distance, end) of the substring of text nearest to pattern; of equals the first end. Bit-parallel over the pattern."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, where = m, 0
    for j, c in enumerate(text, 1):
        x = masks.get(c, 0)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp) & full, vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        vp, vn = hn | ~(d0 | hp) & full, hp & d0
        if score < best:
            best, where = score, j
    return best, where


def whole_words(text: str, item: str) -> int:
    """Where item first stands in text without being part of a longer word, or -1."""
    at = text.find(item)
    while at >= 0:
        end = at + len(item)
        if not (at and text[at - 1].isalnum() and item[0].isalnum() or end < len(text) and text[end].isalnum() and item[-1].isalnum()):
            return at
        at = text.find(item, at + 1)
    return -1


class Matcher:
    """Finds items in texts."""

    def __init__(self, items: list[tuple[int, str]], max_edit: float = MAX_EDIT):
        self.max_edit = max_edit
        named = [(i, t) for i, x in items if x and (t := normal(x))]
        self.short = [(i, t) for i, t in named if len(t) < SHORT]
        self.items = [(i, t) for i, t in named if len(t) >= SHORT]
        self.bits = np.zeros(BITMAP, bool)
        by_size: dict[int, list[int]] = {}
        for n, (_, t) in enumerate(self.items):
            raw = np.frombuffer(t.encode(), np.uint8)
            self.bits[_grams(raw)] = True
            size = SHORT
            while size * 5 // 4 <= max(SHORT, PART * len(raw)):
                size = size * 5 // 4
            by_size.setdefault(size, []).append(n)
        self.groups = []
        for size, members in sorted(by_size.items()):
            walk = _Walk(size)
            windows = [(n, at) for n in members for at in self._anchors(self.items[n][1].encode(), size)]
            data = np.concatenate([np.frombuffer(self.items[n][1].encode(), np.uint8)[at : at + size] for n, at in windows])
            keys = walk.keys(np.append(data, np.zeros(size, np.uint8)), np.arange(len(windows)) * size)
            order = np.argsort(keys, axis=1, kind="stable")
            self.groups.append((walk, np.array(windows, np.int64)[order], np.take_along_axis(keys, order, 1)))

    @staticmethod
    def _anchors(raw: bytes, size: int) -> list[int]:
        """Word starts, spread over an item, at which windows of this size begin: the first and up to ANCHORS others."""
        starts = [0] + [i + 1 for i, c in enumerate(raw) if c == 32 and i + 1 <= len(raw) - size]
        return sorted({starts[round(k * (len(starts) - 1) / ANCHORS)] for k in range(ANCHORS + 1)})

    def find_all(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text: (item number among all, start, end, distance) in letters of the normal text."""
        out: list[list] = [[] for _ in texts]
        normals = [normal(t) for t in texts]
        for k, t in enumerate(normals):
            for item, s in self.short:
                if (at := whole_words(t, s)) >= 0:
                    out[k].append((item, at, at + len(s), 0))
        group, size = [], 0
        for k, t in enumerate(normals):
            group.append(k)
            size += len(t)
            if size > CHUNK:
                self._find(group, normals, out)
                group, size = [], 0
        if group:
            self._find(group, normals, out)
        return out

    def _find(self, numbers: list[int], normals: list[str], out: list[list]) -> None:
        if not self.groups:
            return
        longest = self.groups[-1][0].length
        raw = [normals[k].encode("utf-8", "replace") for k in numbers]
        gap = b"\0" * longest
        data = np.frombuffer(gap.join(raw) + gap, np.uint8)
        begins = np.cumsum([0, *[len(r) + longest for r in raw[:-1]]])
        sums = np.concatenate(([0], np.cumsum(self.bits[_grams(data)], dtype=np.int32)))
        is_start = np.empty(len(data), bool)
        is_start[0] = True
        is_start[1:] = (data[:-1] == 32) | (data[:-1] == 0) & (data[1:] != 0)
        starts = np.flatnonzero(is_start & (data != 0))
        found: dict[tuple[int, int], set[int]] = {}
        for walk, members, keys in self.groups:
            pieces = walk.length - GRAM + 1
            s = starts[starts + pieces < len(sums)]
            s = s[sums[s + pieces] - sums[s] >= SHARE * pieces]
            for at in range(0, len(s), 8192):
                part = s[at : at + 8192]
                mine = walk.keys(data, part)
                for table in range(TABLES):
                    known, low = keys[table], np.searchsorted(keys[table], mine[table], "left")
                    hit = np.flatnonzero((low < len(known)) & (known[np.minimum(low, len(known) - 1)] == mine[table]))
                    for h in hit:
                        i = low[h]
                        while i < len(known) and known[i] == mine[table][h]:
                            start = int(part[h])
                            doc = int(np.searchsorted(begins, start, "right") - 1)
                            item, anchor = members[table][i].tolist()
                            found.setdefault((doc, item), set()).add(max(0, start - int(begins[doc]) - anchor))
                            i += 1
        for (doc, item), places in sorted(found.items()):
            match = self._verify(raw[doc], normals[numbers[doc]], self.items[item][1], sorted(places))
            if match:
                out[numbers[doc]].append((self.items[item][0], *match))

    def _verify(self, raw: bytes, text: str, item: str, places: list[int]) -> tuple[int, int, int] | None:
        """The nearest substring around the windows that begin at these bytes, if near enough."""
        n = len(item)
        most = int(self.max_edit * n)
        slack = most + 8
        best, done = None, -1
        for byte in places:  # where the item would begin, by each of its windows that was met
            at = len(raw[:byte].decode("utf-8", "replace")) if len(raw) != len(text) else byte
            if at < done:
                continue
            a, b = max(0, at - slack), min(len(text), at + n + 2 * slack)
            done = at + slack // 2  # windows that begin there are covered by this region
            d, end = best_substring(item, text[a:b])
            if d <= most and (best is None or d < best[2]):
                _, back = best_substring(item[::-1], text[a : a + end][::-1])
                best = (a + end - back, a + end, d)
        return best


def find_contamination(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT) -> DataFrame:
    """One row per document row and item near a passage of it: doc_id, item_id, start_char, end_char, distance, item_chars."""
    arrow_batches(docs.sparkSession)
    docs = id_text(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    schema = "doc_id long, item_id long, start_char long, end_char long, distance long, item_chars long"

    def block(number: int) -> DataFrame:
        # A block holds about ITEM_BLOCK items whatever the table's size.
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()
        own = [(i, r["text"]) for i, r in enumerate(rows)]
        ids = [r["item_id"] for r in rows]

        def run(batches):
            import pyarrow as pa

            give_back()
            matcher = Matcher(own, max_edit)
            sizes = [len(normal(t)) for _, t in own]
            for batch in batches:
                found = matcher.find_all([t for t in batch.column(1).to_pylist()])
                doc_ids = batch.column(0).to_pylist()
                out = [(d, ids[i], a, b, e, sizes[i]) for d, hits in zip(doc_ids, found) for i, a, b, e in hits]
                columns = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "start_char", "end_char", "distance", "item_chars"])

        return docs.mapInArrow(run, schema)

    if blocks == 1:
        return block(0)
    return reduce(DataFrame.unionAll, [written(block(k), "contaminated") for k in range(blocks)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT) -> DataFrame:
    """docs without the rows that hold a passage near a benchmark item; columns as they are.

    Where ids are null or repeated, rows are told apart by numbers of their own, so each text is judged on its own.
    """
    numbered, row = one_row_ids(docs)
    found = written(find_contamination(numbered.select(F.col(row).alias("doc_id"), "text"), benchmark, max_edit), "contaminated")
    kept = without_ids(numbered, found.select("doc_id").distinct(), row)
    return kept if row == "doc_id" else kept.drop(row)
