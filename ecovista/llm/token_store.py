"""Token-id files: range asymmetric numeral system with static tables, interleaved blocks, checkpoints and checksums.

A file is a Parquet table; each row is a segment of whole documents in ascending doc_id order:

  part, seq     place of the segment: range partition, number within it; own: ids of its partition before it
  doc_ids       little-endian 64-bit ids (null ids are flagged in doc_nulls), doc_sizes: 32-bit ids per document
  symbols       the distinct ids (32-bit), freqs: their frequencies out of 2**20 (32-bit), shared by all blocks
  words         32-bit words of all blocks, one block after the other
  checkpoints   per block: first word (32-bit), then the decoder's start state of each lane (64-bit)
  checksums     per block: crc32 of its ids as little-endian 32-bit integers
  n_ids         ids in the segment; the last block is filled up with the commonest id

Any block can be decoded on its own from its checkpoint and the table, and is checked by its checksum.

Defined results: a null or empty text has the end id only; rows with a null doc_id come first; ties of doc_id are
ordered by text; other columns are not read; an empty table gives an empty file and result.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TextCutter, _Memo, byte_letters
from .common import arrow_batches, id_text, kept_in_worker, shared_dir, shuffle_partitions

SCALE = 20
LANES = 32
STEPS = 512
BLOCK = LANES * STEPS
#: A segment is closed once it has so many ids.
SEGMENT_IDS = 1 << 20
#: Words whose ids a worker keeps.
MEMO_WORDS = 1_000_000
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_MASK32 = np.uint64(0xFFFFFFFF)


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, freqs): frequencies of at least 1 that sum to 2**SCALE."""
    symbols, counts = np.unique(ids, return_counts=True)
    total = 1 << SCALE
    if len(symbols) > total:
        raise ValueError("more distinct ids than the table's scale")
    freqs = np.maximum(1, counts * total // counts.sum()).astype(np.int64)
    while (over := int(freqs.sum()) - total) != 0:
        order = np.argsort(-freqs, kind="stable")
        if over < 0:
            freqs[order[0]] -= over
        else:
            take = np.minimum(freqs[order] - 1, max(1, over // max(1, int((freqs > 1).sum()))))
            take = np.where(np.cumsum(take) <= over, take, 0)
            freqs[order] -= take
    return symbols.astype(np.uint32), freqs.astype(np.uint32)


def encode_segment(ids: np.ndarray) -> dict:
    """ids (not empty) to the columns of a segment."""
    symbols, freqs = frequency_table(ids)
    blocks = -(-len(ids) // BLOCK)
    fill = symbols[np.argmax(freqs)]
    padded = np.full(blocks * BLOCK, fill, np.uint32)
    padded[: len(ids)] = ids
    place = np.searchsorted(symbols, padded).reshape(blocks, STEPS, LANES)
    f64, c64 = freqs.astype(np.uint64), np.concatenate(([0], np.cumsum(freqs)[:-1])).astype(np.uint64)
    x = np.full((blocks, LANES), _LOW, np.uint64)
    sent = np.zeros((blocks, STEPS, LANES), np.uint32)
    goes = np.zeros((blocks, STEPS, LANES), bool)
    for step in range(STEPS - 1, -1, -1):
        p = place[:, step]
        f = f64[p]
        full = x >= f << np.uint64(63 - SCALE)
        goes[:, step], sent[:, step] = full, x & _MASK32
        x = np.where(full, x >> _32, x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + c64[p]
    begins = np.concatenate(([0], np.cumsum(goes.sum(axis=(1, 2)))[:-1])).astype("<u4")
    checkpoints = b"".join(b.tobytes() + s.tobytes() for b, s in zip(begins, x.astype("<u8")))
    raw = padded.astype("<u4").reshape(blocks, BLOCK)
    return {
        "symbols": symbols.astype("<u4").tobytes(), "freqs": freqs.astype("<u4").tobytes(), "words": sent[goes].astype("<u4").tobytes(),
        "checkpoints": checkpoints, "checksums": np.array([zlib.crc32(r.tobytes()) for r in raw], "<u4").tobytes(), "n_ids": len(ids),
    }


def decode_blocks(segment: dict, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (all, if not given), filling included; raises if a checksum doesn't hold."""
    kind = np.dtype([("at", "<u4"), ("x", "<u8", (LANES,))])
    marks = np.frombuffer(segment["checkpoints"], kind)[first:last]
    symbols, freqs = (np.frombuffer(segment[k], "<u4") for k in ("symbols", "freqs"))
    words = np.append(np.frombuffer(segment["words"], "<u4"), np.zeros(LANES, "<u4"))
    slots = np.repeat(np.arange(len(symbols), dtype=np.uint32), freqs)
    f64, c64 = freqs.astype(np.uint64), np.concatenate(([0], np.cumsum(freqs.astype(np.int64))[:-1])).astype(np.uint64)
    x, at = marks["x"].astype(np.uint64), marks["at"].astype(np.int64)
    out = np.empty((len(marks), STEPS, LANES), np.uint32)
    low = np.uint64((1 << SCALE) - 1)
    for step in range(STEPS):
        slot = x & low
        s = slots[slot]
        out[:, step] = symbols[s]
        x = f64[s] * (x >> np.uint64(SCALE)) + slot - c64[s]
        need = x < _LOW
        rank = np.cumsum(need, axis=1)
        place = np.minimum(at[:, None] + rank - 1, len(words) - 1)
        x = np.where(need, x << _32 | words[np.maximum(place, 0)], x)
        at = at + rank[:, -1]
    flat = out.reshape(len(marks), BLOCK)
    for got, kept in zip(flat, np.frombuffer(segment["checksums"], "<u4")[first:last]):
        if zlib.crc32(got.astype("<u4").tobytes()) != int(kept):
            raise ValueError("a block's checksum doesn't hold")
    return flat.reshape(-1)


class LibraryEncoder:
    """Ids by the tokenizers library; the results of single words are kept in a table of bounded size."""

    def __init__(self, path: str):
        self.cutter = TextCutter(path)
        self.tokenizer = self.cutter.tokenizer
        self.model = self.tokenizer.model
        letters = byte_letters()
        self.as_letters = str.maketrans({chr(i): "".join(letters[b] for b in chr(i).encode()) for i in range(256)})
        self.words = _Memo(self._word, MEMO_WORDS)

    def _ids(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(word.translate(self.as_letters))], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if len(self.cutter.parts(text)) > 1 or not self.cutter.latin(text):
            return self._ids(text)
        return b"".join(map(self.words.__getitem__, self.cutter.latin_words(text)))


@kept_in_worker
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


_FILE = (
    "part int, seq int, own long, doc_ids binary, doc_nulls binary, doc_sizes binary, symbols binary, freqs binary, words binary, "
    "checkpoints binary, checksums binary, n_ids long"
)


def write_token_file(docs: DataFrame, tokenizer_path: str, path: str, end_id: int | None = None) -> None:
    """Write the ids of docs' texts, each with end_id behind it, in ascending doc_id order."""
    spark = docs.sparkSession
    arrow_batches(spark)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        e, part = library_encoder(tokenizer_path), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        held, ids, size, seq, own = [], [], 0, 0, 0

        def segment():
            data = np.frombuffer(b"".join(ids), "<u4")
            made = encode_segment(data) if len(data) else {"symbols": b"", "freqs": b"", "words": b"", "checkpoints": b"", "checksums": b"", "n_ids": 0}
            row = {
                "part": part, "seq": seq, "own": own, "doc_ids": np.array([i or 0 for i in held], "<i8").tobytes(),
                "doc_nulls": np.array([i is None for i in held], "u1").tobytes(), "doc_sizes": np.array([len(x) // 4 for x in ids], "<u4").tobytes(),
            } | made
            types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 8, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(i)
                ids.append(e.encode(text) + end)
                size += len(ids[-1]) // 4
                if size >= SEGMENT_IDS:
                    yield segment()
                    held, ids, size, seq, own = [], [], 0, seq + 1, own + size
        if held:
            yield segment()

    placed = id_text(docs).repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(run, _FILE).write.option("compression", "none").parquet(path)


def read_token_file(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of a token file, from the file: doc_id, start, n_tokens, ids_crc32; with_ids adds ids (binary)."""
    arrow_batches(spark)
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each written partition
    offsets, before = {}, 0  # ids before each partition: one number for each, however large they are
    for r in sizes:
        offsets[r["part"]] = before
        before += r["n"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["doc_sizes"], "<u4").astype(np.int64)
                ends = np.cumsum(counts)
                data = decode_blocks(row)[: row["n_ids"]].astype("<u4").tobytes() if row["n_ids"] else b""
                docs = [None if z else int(i) for i, z in zip(np.frombuffer(row["doc_ids"], "<i8"), row["doc_nulls"])]
                each = [data[4 * (e - c) : 4 * e] for c, e in zip(counts, ends)]
                out = [
                    pa.array(docs, pa.int64()), pa.array(ends - counts + row["before"], pa.int64()), pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(x) for x in each], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*out, pa.array(each, pa.binary())] if with_ids else out, names + ["ids"] * with_ids)

    base = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]) if offsets else F.create_map(F.lit(0), F.lit(0))
    placed = stored.withColumn("before", F.element_at(base, F.col("part")) + F.col("own"))
    extra = ", ids binary" if with_ids else ""
    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, ids_crc32 long{extra}")


def store_and_read(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write a token file of docs into the shared folder; per document, what is read back from it."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/ecovista/tokens-{uuid.uuid4().hex}"
    write_token_file(docs, tokenizer_path, path, end_id)
    return read_token_file(spark, path)
