"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The pass goes over the text's characters and keeps, for each boundary, the piece that ends the best segmentation up to
there, and a pointer to where that piece begins. Only boundaries within the longest piece's length can still begin a
piece; when the pointer paths of all of them have met, the ids up to where they meet are committed and forgotten, so
memory is bounded however long the text is. Where no piece can span a place (before a space mark that ends a word, and
around a line end that no piece has), all paths meet at once; the words between such places are remembered.

What makes a segmentation the best depends on the model. In a unigram model it is the sum of the pieces' scores. In a BPE
model, scores rank merges and do not add up: there the best segmentation is the one that the merges make, and a piece may
follow another only if merging the two together leaves them as they are. One piece at each boundary satisfies that, so
the pass is the same. Both give the ids of the sentencepiece library, which the tests compare.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import list_array, sized_parts, text_or_empty

SPACE = "▁"
UNIGRAM, BPE = 1, 2
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6
#: Characters after which the pass looks for a boundary where all paths meet.
STRIDE = 256
ONE = (1,)
#: Words and pairs of pieces that a worker remembers, and bytes of text encoded at a time.
WORDS_KEPT, PAIRS_KEPT, PART_BYTES = 600_000, 500_000, 2_000_000
#: A longer word is not remembered, so that the memory for words is bounded in bytes too.
WORD_CHARS = 64


def wire(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size, kind = (4, "<f") if key & 7 == 5 else (8, "<d")
            value, at = struct.unpack_from(kind, data, at)[0], at + size
        yield key >> 3, value


class Pieces:
    """A SentencePiece model, and its encoder and decoder."""

    def __init__(self, data: bytes) -> None:
        names, self.scores, self.kinds, self.bytes_of = [], [], [], {}
        kind_of_model, fallback, prefix, charsmap, collapse = UNIGRAM, False, True, b"", True
        for field, value in wire(data):
            if field == 1:
                piece = dict(wire(value))
                names.append(piece.get(1, b"").decode())
                self.scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, 1))
            elif field == 2:
                trainer = dict(wire(value))
                kind_of_model, fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif field == 3:
                normal = dict(wire(value))
                charsmap, prefix, collapse = normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1))
        if kind_of_model not in (UNIGRAM, BPE) or charsmap or collapse or USER_DEFINED in self.kinds:
            raise ValueError("only unigram and BPE models without normalisation or user-defined pieces are supported")
        self.names, self.prefix = names, prefix
        self.ids = {p: i for i, (p, k) in enumerate(zip(names, self.kinds, strict=True)) if k == 1}
        self.longest = max(map(len, self.ids), default=1)
        #: Lengths, longest first, of the pieces that end with these three (or two) characters; 1 always.
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            ends.setdefault(p[-3:], {1}).add(len(p))
        for end, found in ends.items():
            if len(end) == 3 and end[1:] in self.ids:
                found.add(2)
        self.lengths = {end: tuple(sorted(found, reverse=True)) for end, found in ends.items() if len(end) > 1}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        if fallback:
            self.bytes_of = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(names, self.kinds, strict=True)) if k == BYTE}
        self.raw = [b"" if k in (CONTROL,) else bytes([int(p[1:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.encode() for p, k in zip(names, self.kinds, strict=True)]
        self.cut_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.cut_lines = self.cut_spaces and not any("\n" in p for p in self.ids)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.best = self.best_bpe if kind_of_model == BPE else self.best_unigram
        self.least = min((s for s, k in zip(self.scores, self.kinds, strict=True) if k == 1), default=0.0) - 10

    def merged(self, text: str) -> list[str]:
        """The pieces that merges make of a short text: again and again the pair whose piece scores highest, the leftmost
        of equals, becomes one."""
        parts = list(text)
        while True:
            ranked = [(-self.scores[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not ranked:
                return parts
            k = min(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def may_follow(self, before: str, piece: str) -> bool:
        """Whether merging the two pieces together leaves them as they are; an empty one before asks for the piece alone."""
        known = self.pairs.get((before, piece))
        if known is None:
            if len(self.pairs) > PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return known

    def best_bpe(self, text: str, first: int, end: int, pieces: list[str], begins: list[int], totals: list[float]) -> None:
        """Extends the piece and pointer of each boundary to that one; boundary i stands at i - first in the lists."""
        ids, lengths, pairs = self.ids, self.lengths.get, self.pairs.get
        for i in range(first + len(pieces), end + 1):
            for n in lengths(text[i - 3 : i] if i > 2 else text[:i]) or lengths(text[i - 2 : i] if i > 1 else "", ONE):
                if (j := i - n) < first:
                    continue
                piece = text[j:i]
                if n == 1 or piece in ids:
                    ok = pairs((before := pieces[j - first], piece))
                    if ok or ok is None and self.may_follow(before, piece):
                        pieces.append(piece)
                        begins.append(j)
                        break

    def best_unigram(self, text: str, first: int, end: int, pieces: list[str], begins: list[int], totals: list[float]) -> None:
        ids = self.ids
        for i in range(first + len(pieces), end + 1):
            best = None
            for j in range(max(first, i - self.longest), i):
                piece = text[j:i]
                k = ids.get(piece)
                if k is None and j < i - 1:
                    continue
                total = totals[j - first] + (self.least if k is None else self.scores[k])
                if best is None or total > best[0]:
                    best = total, piece, j
            totals.append(best[0])
            pieces.append(best[1])
            begins.append(best[2])

    def segments(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text (with space marks), committed as soon as they are certain."""
        pieces, begins, totals, first = [""], [0], [0.0], 0
        for end in (*range(STRIDE, len(text), STRIDE), len(text)):
            self.best(text, first, end, pieces, begins, totals)
            live = {end} if end == len(text) else set(range(max(first, end - self.longest + 1), end + 1))
            while len(live) > 1:
                far = max(live)
                live.remove(far)
                live.add(begins[far - first])
            i = meet = live.pop()
            path = []
            while i > first:
                path.append(pieces[i - first])
                i = begins[i - first]
            yield path[::-1]
            del pieces[: meet - first], begins[: meet - first], totals[: meet - first]
            first = meet

    def segment_ids(self, text: str) -> bytes:
        out, ids = [], self.ids.get
        for path in self.segments(text):
            for piece in path:
                if (i := ids(piece)) is not None:
                    out.append(i)
                elif self.bytes_of:
                    out.extend(self.bytes_of[b] for b in piece.encode("utf-8", "surrogatepass"))
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
        return array("i", out).tobytes()

    def word_ids(self, word: str, text: str) -> bytes:
        """The ids of the text that this word stands for, remembered."""
        if (code := self.older.get(word)) is None:
            code = self.segment_ids(text)
        if len(word) <= WORD_CHARS:
            self.words[word] = code
        return code

    def encode(self, text: str) -> bytes:
        """The text's ids as i32 in the machine's order."""
        if not text:
            return b""
        if len(self.words) > WORDS_KEPT:
            self.words, self.older = {}, self.words
        if self.cut_lines and self.prefix and SPACE not in text:
            words = text.replace("\n", " \n").split(" ")
            if "" not in words:
                codes = list(map(self.words.get, words))
                if None in codes:
                    for i, code in enumerate(codes):
                        if code is None:
                            w = words[i]
                            codes[i] = self.words.get(w) or self.word_ids(w, w if w[0] == "\n" else SPACE + w)
                return b"".join(codes)
        marked = ((SPACE if self.prefix else "") + text).replace(" ", SPACE)
        if not self.cut_spaces or not self.bytes_of:  # runs of unknown characters are one id, also across cuts
            return self.segment_ids(marked)
        return b"".join(self.words.get(SPACE + w) or self.word_ids(SPACE + w, w) for w in CUTS.findall(marked))

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of these ids; bytes that are not UTF-8 become replacement characters."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


CUTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@cache
def loaded(path: str) -> Pieces:
    """The model of a file, once for all tasks of a worker."""
    with open(path, "rb") as file:
        return Pieces(file.read())


def encoded(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns of every row, with ids, n_ids, ids_crc32 (of the ids as u32, little-endian) and round_trip:
    whether decoding the ids gives the text again.

    A null text counts as empty and has no ids. The text's own space marks (U+2581) come back as spaces, as in the
    library. Repeated rows each keep their row; a very long text is encoded piece by piece; an empty table gives an empty
    result. Columns that are not kept are not read, and kept ones may have any name but those of the result.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    kept = [f"kept_{i}" for i in range(len(keep))]
    source = docs.select(text_or_empty(text).alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    schema = ", ".join([*[f"{k} {kinds[c]}" for c, k in zip(keep, kept, strict=True)], "ids array<int>", "n_ids long", "ids_crc32 long", "round_trip boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for batch in batches:
            for first, last in sized_parts(batch.column(0), PART_BYTES):
                part = batch.slice(first, last - first)
                texts = part.column(0).to_pylist()
                codes = [pieces.encode(t) for t in texts]
                counts = np.fromiter((len(c) // 4 for c in codes), np.int64, len(codes))
                ids = list_array(np.frombuffer(b"".join(codes), np.int32), counts)
                same = [pieces.decode(array("i", c)) == t for c, t in zip(codes, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], ids, pa.array(counts), pa.array([zlib.crc32(c) for c in codes], pa.int64()), pa.array(same, pa.bool_())], [*kept, "ids", "n_ids", "ids_crc32", "round_trip"])

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "ids", "n_ids", "ids_crc32", "round_trip")


def decoded(rows: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The kept columns of every row, with the text of its ids; null ids give null."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = [f"kept_{i}" for i in range(len(keep))]
    source = rows.select(F.col(ids).cast("array<int>").alias("ids"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    schema = ", ".join([*[f"{k} {kinds[c]}" for c, k in zip(keep, kept, strict=True)], "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Callable[[list[int]], str] = loaded(model).decode
        for batch in batches:
            texts = [None if r is None else pieces(r) for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*kept, "text"])

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "text")
