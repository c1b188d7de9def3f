"""Byte-pair encoding as a streaming transducer, and decoding as an incremental state machine.

Merging by rank can be done from left to right.  If every token has one merge that makes it, a token
sequence is the result of merging exactly when each neighbouring pair is what merging that pair's own
symbols gives back.  So for each prefix one last token fits, and it is found from those of shorter prefixes.
How far a later symbol can reach back is bounded by the merge list: `sufficient_lookahead` gives the
longest chain of merges that compete for a symbol, in symbols.  A token that ends further back than that
is stable and is emitted; only a window of the symbols behind it is kept, however long a word is.

A text is cut into words as the vocabulary file says, and words' results are kept in a table of bounded
size, as the transducer starts anew at each word.  Texts within Latin-1 take a direct way through
normalising and cutting; others go through the tokenizer file's own normaliser and cutter.

Defined results: a null or empty text has no ids and decodes to the empty text; strings of special tokens
within a text become their ids; null doc_ids, repeated rows and other columns don't matter (one row for each
input row); an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct

from pyspark.sql import DataFrame

from .common import arrow_batches, id_text, kept_in_worker

#: Words whose results a worker keeps; beyond it the table is started anew.
MEMO_WORDS = 400_000
#: Longer words are never kept.
MEMO_LETTERS = 64

_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
_DIGITS = "0-9²³¹¼½¾"
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
#: What the vocabulary file's cutting pattern means for Latin-1 texts.
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeList:
    """A vocabulary with a ranked merge list and a suffix that marks the last symbol of a word."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            whole = self.vocab[a + b]
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, whole)
            if whole in self.parts:
                raise ValueError("a token is made by two merges; the transducer needs one for each")
            self.parts[whole] = (self.vocab[a], self.vocab[b])
        end = len(self.suffix)
        self.inner = {s: i for s, i in self.vocab.items() if not s.endswith(self.suffix) or s == self.suffix}
        self.final = {s[:-end]: i for s, i in self.vocab.items() if s.endswith(self.suffix) and len(s) > end}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.known_fits: dict[tuple[int, int], bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self._whole: dict[int, bool] = {}
        self.lookahead = sufficient_lookahead(merges, self.suffix)

    def symbols(self, token: int) -> list[int]:
        if token in self.parts:
            a, b = self.parts[token]
            return self.symbols(a) + self.symbols(b)
        return [token]

    def merge(self, symbols: list[int]) -> list[int]:
        """Merging by rank, as it is defined; for single tokens only."""
        while True:
            best = min(((self.pairs[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in self.pairs), default=None)
            if best is None:
                return symbols
            i = best[1]
            symbols = symbols[:i] + [self.pairs[symbols[i], symbols[i + 1]][1]] + symbols[i + 2 :]

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at this side of token while it is made, each with the rank of the merge that takes it."""
        known = self._edges[side].get(token)
        if known is None:
            known, t, taken = [], token, float("inf")
            while True:
                known.append((t, taken))
                if t not in self.parts:
                    break
                taken = self.pairs[self.parts[t]][0]
                t = self.parts[t][side]
            self._edges[side][token] = known
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether merging what a and b are made of gives a and b: no merge across their boundary comes first.

        Of two merges of one rank the left one comes first, so one across wins against one within b only.
        """
        known = self.known_fits.get((a, b))
        if known is None:
            if len(self.known_fits) > 2 * MEMO_WORDS:
                self.known_fits.clear()
            pairs = self.pairs
            known = True
            for x, taken_x in self._edge(a, 1):
                for y, taken_y in self._edge(b, 0):
                    across = pairs.get((x, y))
                    if across is not None and across[0] < taken_x and across[0] <= taken_y:
                        known = False
                        break
                if not known:
                    break
            self.known_fits[a, b] = known
        return known

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own symbols gives it."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merge(self.symbols(token)) == [token]
        return known


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str) -> int:
    """Symbols behind a boundary that can still change whether the merge across it happens.

    A merge (u, v) is undone only if the symbols at the right edge of v's territory are taken by a merge of
    lower rank, (v', w) with v' on the right edge of v, or v' = v; that one in turn by one within w's edge,
    of lower rank still.  reach[t] is the longest such chain that starts with a merge whose left part is t.
    """
    parts = {a + b: (a, b) for a, b in merges}
    length = lambda t: len(t) - (len(suffix) if suffix and t.endswith(suffix) else 0)
    reach: dict[str, int] = {}
    longest = 0
    for a, b in merges:
        edge, beyond = b, 0
        while True:
            beyond = max(beyond, reach.get(edge, 0))
            if edge not in parts:
                break
            edge = parts[edge][1]
        chain = length(b) + beyond
        reach[a] = max(reach.get(a, 0), chain)
        longest = max(longest, chain)
    return longest + max(length(a + b) for a, b in merges)


class Transducer:
    """Takes the symbols of one word in pieces; gives tokens as soon as they are stable."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.keep = merges.lookahead + merges.longest
        self.reset()

    def reset(self) -> None:
        self.text, self.base = "", 0  # symbols from position base on
        self.last: list[int] = [-1]  # last[i]: last token of the prefix that ends at base + i
        self.size: list[int] = [0]
        self.before = -1  # the token emitted last

    def _extend(self, letters: str, table: dict[str, int]) -> None:
        """The last token of each longer prefix: the one that fits the last token of the prefix before it."""
        text, last, size, before = self.text, self.last, self.size, self.before
        longest, known, fits = self.m.longest, self.m.known_fits, self.m.fits
        i = len(text)
        self.text = text = text + letters
        get = table.get
        for i in range(i + 1, len(text) + 1):
            for n in range(i if i < longest else longest, 0, -1):
                t = get(text[i - n : i])
                if t is not None:
                    prev = last[i - n] if i > n else before
                    if prev >= 0:
                        ok = known.get((prev, t))
                        if ok is None:
                            ok = fits(prev, t)
                    else:
                        ok = i == n and self.m.reachable(t)
                    if ok:
                        last.append(t)
                        size.append(n)
                        break
            else:
                last.append(-1)
                size.append(0)

    def feed(self, letters: str) -> list[int]:
        """letters go on the word; more must follow (hold back the last one for finish)."""
        if len(self.text) + len(letters) < 2 * self.keep:
            self._extend(letters, self.m.inner)
            return []
        out: list[int] = []
        for at in range(0, len(letters), self.keep):
            self._extend(letters[at : at + self.keep], self.m.inner)
            if len(self.text) >= 2 * self.keep:
                out += self._stable()
        return out

    def _chain(self, i: int) -> list[tuple[int, int]]:
        chain = []
        while i > 0:
            chain.append((self.last[i], i))
            i -= self.size[i]
        return chain[::-1]

    def _stable(self) -> list[int]:
        edge = len(self.text) - self.m.lookahead
        done = [(t, i) for t, i in self._chain(len(self.text)) if i <= edge]
        if not done:
            return []
        cut = done[-1][1]
        self.text = self.text[cut:]
        self.last, self.size = [-1, *self.last[cut + 1 :]], [0, *self.size[cut + 1 :]]
        self.before = done[-1][0]
        # Tokens that would begin before the cut are of prefixes that no result passes through.
        for i, n in enumerate(self.size):
            if n > i:
                self.last[i], self.size[i] = -1, 0
        return [t for t, _ in done]

    def finish(self, letter: str) -> list[int]:
        """The word's last letter; the rest of its tokens."""
        self._extend(letter, self.m.final)
        out = [t for t, _ in self._chain(len(self.text))]
        self.reset()
        return out

    def word(self, letters: str) -> list[int]:
        return self.feed(letters[:-1]) + self.finish(letters[-1])


class IncrementalDecoder:
    """Ids in, text out: bytes of ids go through a UTF-8 state machine that holds back unfinished letters.

    pieces=True gives the vocabulary's strings with a blank between two, as the tokenizers library does for
    a file without a decoder; pieces=False gives the text itself, with a blank for each end of a word.
    """

    def __init__(self, merges: MergeList, pieces: bool = True):
        self.pieces, self.end = pieces, merges.suffix
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.bytes: dict[int, bytes] = {}
        self.strings, self.special, self.byte = merges.strings, set(merges.special.values()), byte
        self.reset()

    def reset(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        self.first = True

    def token_bytes(self, i: int) -> bytes:
        known = self.bytes.get(i)
        if known is None:
            s = self.strings[i]
            if self.pieces or i in self.special:
                known = s.encode()
            else:
                word = s.endswith(self.end)
                known = bytes(self.byte[c] for c in (s[: -len(self.end)] if word else s)) + b" " * word
            self.bytes[i] = known
        return known

    def feed(self, ids) -> str:
        data = (b" " if self.pieces else b"").join(map(self.token_bytes, ids))
        if self.pieces and not self.first and data:
            data = b" " + data
        self.first = self.first and not data
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


class _Memo(dict):
    """Results of make by word; started anew once it has `most`."""

    def __init__(self, make, most: int = MEMO_WORDS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= MEMO_LETTERS:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


class TextCutter:
    """Cuts texts into the words on which merging starts anew; words come as they are written, or in byte letters."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.specials = set(special)
        self.marks = [s[:2] for s in special]

    def parts(self, text: str):
        """(special?, part) of a text."""
        if self.special is None or not any(m in text for m in self.marks):
            return [(False, text)]
        return [(p in self.specials, p) for p in self.special.split(text) if p]

    @staticmethod
    def latin(text: str) -> bool:
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    @staticmethod
    def latin_words(text: str) -> list[str]:
        return _LATIN.findall(text.lower())

    def other_words(self, text: str) -> list[str]:
        """Words in byte letters, by the file's own normaliser and cutter."""
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]


class Encoder:
    """Texts to ids and back to decoded bytes, word by word."""

    def __init__(self, path: str):
        self.merges = MergeList(path)
        self.cutter = TextCutter(path)
        self.letters = byte_letters()
        self.transducer = Transducer(self.merges)
        self.decoder = IncrementalDecoder(self.merges)
        self.by_text = _Memo(lambda w: self._results("".join(self.letters[b] for b in w.encode())))
        self.by_letters = _Memo(self._results)

    def _results(self, letters: str) -> tuple[bytes, bytes]:
        return self._pack(self.transducer.word(letters))

    def _pack(self, ids: list[int]) -> tuple[bytes, bytes]:
        self.decoder.reset()
        return struct.pack(f"<{len(ids)}I", *ids), (self.decoder.feed(ids) + self.decoder.finish()).encode()

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers; the decoded text in UTF-8."""
        ids, decoded = [], []
        for special, part in self.cutter.parts(text):
            if special:
                found = [self._pack([self.merges.special[part]])]
            elif self.cutter.latin(part):
                found = list(map(self.by_text.__getitem__, self.cutter.latin_words(part)))
            else:
                found = list(map(self.by_letters.__getitem__, self.cutter.other_words(part)))
            if found:
                a, b = zip(*found)
                ids.append(b"".join(a))
                decoded.append(b" ".join(b))
        return b"".join(ids), b" ".join(decoded)


@kept_in_worker
def encoder(path: str) -> Encoder:
    """One encoder for a worker process."""
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids (binary) and decoded (string)."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        e = encoder(path)
        for batch in batches:
            n, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids, decoded = e.encode(text)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    all_text.append(decoded.decode())
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out += [pa.array(all_ids, pa.binary()), pa.array(all_text, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    extra = ", ids binary, decoded string" if with_ids else ""
    return id_text(docs).mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
