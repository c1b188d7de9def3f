"""Packing of tokenised documents into sequences of a fixed capacity, by minimum bin slack.

Documents are encoded and cut into pieces in the scan; what is written is a row of numbers for each piece, with
its number among the pieces of its length in its task.  Planning needs only how many pieces of each length
there are: capacity numbers, whatever the size of the corpus.  A bin takes the longest piece left and, from
the lengths left, the combination that leaves the least slack; it is found by subset sums on a bitset.  The
combination is used for as many bins as there are pieces for, so a length runs short with each plan made
and plans are few.  Pieces are then dealt to the bins' places by their number within their length.

Defined results: a null or empty text is the end id only; documents longer than the capacity, and no others,
are cut, the first piece being the shorter one; rows with a null or repeated doc_id are documents of their
own; an empty table gives an empty result; texts may be of any length; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _Memo, byte_letters
from .common import arrow_batches, by_size, id_text, kept_in_worker, written

CAPACITY = 2048
#: Words whose ids a worker keeps; longer words are never kept.
MEMO_WORDS = 300_000
MEMO_LETTERS = 64
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
#: What byte-level vocabularies' cutting pattern means for Latin-1 texts (fixed values).
_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


class ByteEncoder:
    """Ids by a tokenizer file, as the library gives them.

    Where the file cuts texts as byte-level vocabularies do, Latin-1 texts are cut here and words' ids are kept in a
    table of bounded size; all else goes through the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        cutter = spec["pre_tokenizer"] or {}
        self.marks = [t["content"][:2] for t in spec["added_tokens"]]
        self.direct = spec["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
        letters = byte_letters()
        self.as_letters = {i: "".join(letters[b] for b in chr(i).encode()) for i in range(256)}
        self.words = _Memo(self._word, MEMO_WORDS)

    def _word(self, word: str) -> bytes:
        return np.array([t.id for t in self.tokenizer.model.tokenize(word.translate(self.as_letters))], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.direct and not any(m in text for m in self.marks):
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return b"".join(map(self.words.__getitem__, _CUT.findall(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@kept_in_worker
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder for a worker process."""
    return ByteEncoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, task, nth (its number among the task's pieces of its length)."""
    arrow_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        e, end, task = byte_encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in by_size(batches, 1):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = e.encode(text) + end
                total = len(ids) // 4
                for n, stop in enumerate(range((total - 1) % capacity + 1, total + 1, capacity)):
                    start = max(0, stop - capacity)
                    length = stop - start
                    rows.append((doc_id, n, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * stop]), task, int(seen[length])))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    return id_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (each no more often than counts has it) with the largest sum of at most room; longer ones where there is a choice.

    Bit s of a set says that lengths taken so far can sum to s.  Longer lengths come last, so that the way back meets
    them first; a length's copies come in groups of 1, 2, 4, ... and a rest, which make up any number of copies.
    """
    limit, sums, steps = (1 << room + 1) - 1, 1, []
    for length in sorted(counts):
        left, group = min(counts[length], room // length), 1
        while left > 0:
            take = min(group, left)
            steps.append((length, take, sums))
            sums |= sums << length * take & limit
            left, group = left - take, group * 2
    at, found = sums.bit_length() - 1, []
    for length, take, before in reversed(steps):
        more = length * take
        if at >= more and before >> at - more & 1:
            found += [length] * take
            at -= more
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, longest first; number of such bins): all pieces of the histogram (length -> pieces)."""
    left, plans = {k: n for k, n in histogram.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        chosen = [longest, *fullest({k: n for k, n in rest.items() if n and k <= capacity - longest}, capacity - longest)]
        used = {k: chosen.count(k) for k in chosen}
        bins = min(left[k] // n for k, n in used.items())
        plans.append((chosen, bins))
        for k, n in used.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
    return plans


def _places(plans: list[tuple[list[int], int]], capacity: int):
    """For each length, in order of the numbers of its pieces: (first number, copies a bin, first bin, offset in a bin)."""
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
    dealt, first_bin = [0] * (capacity + 1), 0
    for chosen, bins in plans:
        offset = 0
        for length in dict.fromkeys(chosen):
            copies = chosen.count(length)
            found[length].append((dealt[length], copies, first_bin, offset))
            dealt[length] += copies * bins
            offset += copies * length
        first_bin += bins
    return [np.array(x, np.int64).reshape(-1, 4) for x in found]


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # A row for each length and task: the tasks of one length are ordered, not its pieces.
    before = written(by_task.select("length", "task", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before")), "before")
    places = _places(plan({r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity), capacity)  # `capacity` rows at most
    numbered = cut.hint("merge").join(before.select("length", "task", "before"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                here, table = np.flatnonzero(length == value), places[value]
                first, copies, first_bin, at = table[np.searchsorted(table[:, 0], number[here], "right") - 1].T
                nth = number[here] - first
                sequence[here], offset[here] = first_bin + nth // copies, at + nth % copies * value
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
