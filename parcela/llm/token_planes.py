"""Token ids as bit planes: tokenising, files of compressed planes with a chunk index, and reading them back.

A file holds the ids of consecutive documents, cut into blocks of a fixed number of ids (the last block of a file may be
shorter). Each block is transposed into byte planes (the n-th bytes of all ids together) or into bit planes, and each
plane is compressed by itself with zstandard; planes of zeros shrink to a few bytes.

Layout, integers little-endian: magic, u32 block ids, u32 plane bits (8 or 1); then the planes of each block; then the
chunk index, a row for each block and plane: u64 offset, u32 compressed bytes, u32 ids in the block; then u64 offset of
the index, u32 blocks and the magic again. A reader seeks to the index at the end, and reads only the blocks it needs.

Documents are dealt to files by ranges of their ids, so that files in order hold the documents in ascending order. The
table of contents, a Parquet table, names for each document its file, its first id there and its count; rows of tasks
that failed or ran twice never reach it, so files that only they wrote are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.llm.common import range_part, sized_parts, text_or_empty
from parcela.sources.shared import scratch

MAGIC = b"PLN1"
BLOCK_IDS = 1 << 16
#: The most ids in one file; a range of documents with more goes on in another file.
FILE_IDS = 1 << 25
INDEX_ROW = struct.Struct("<QII")
TAIL = struct.Struct("<QI4s")
END_ID = 1
#: Distinct words whose ids a worker remembers, and bytes of text that it splits at a time.
WORDS_KEPT, PART_BYTES = 600_000, 2_000_000
#: A longer word is encoded whenever it comes, so that the memory for words is bounded in bytes too.
WORD_CHARS = 64
#: A word of letters and one of these is two words to a tokenizer that cuts words from signs.
MARKS = ".,;:!?"

#: Python's split() cuts at these, the tokenizer does not.
NOT_SPACE = re.compile("[\x1c-\x1f]")


def to_planes(ids: np.ndarray, plane_bits: int) -> list[bytes]:
    """The planes of a block of u32 ids, lowest first."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if plane_bits == 8:
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file of ids; ids may come in pieces of any size."""

    def __init__(self, out, block_ids: int = BLOCK_IDS, plane_bits: int = 8) -> None:
        self.out, self.block_ids, self.plane_bits = out, block_ids, plane_bits
        self.at, self.index, self.held, self.n_held, self.n = 0, [], [], 0, 0
        self.compress = zstandard.ZstdCompressor(level=3).compress
        self.put(struct.pack("<4sII", MAGIC, block_ids, plane_bits))

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def block(self, ids: np.ndarray) -> None:
        for plane in to_planes(ids, self.plane_bits):
            packed = self.compress(plane)
            self.index.append(INDEX_ROW.pack(self.at, len(packed), len(ids)))
            self.put(packed)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= self.block_ids:
            every = np.concatenate(self.held)
            whole = len(every) // self.block_ids * self.block_ids
            for first in range(0, whole, self.block_ids):
                self.block(every[first : first + self.block_ids])
            self.held, self.n_held = [every[whole:].copy()], len(every) - whole

    def close(self) -> None:
        if self.n_held:
            self.block(np.concatenate(self.held))
        at, blocks = self.at, len(self.index) // (4 if self.plane_bits == 8 else 32)
        self.put(b"".join(self.index) + TAIL.pack(at, blocks, MAGIC))
        self.out.close()


class PlaneReader:
    """Ranges of ids of one file; the last block read stays, so ascending ranges read each block once."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        magic, self.block_ids, plane_bits = struct.unpack("<4sII", self.bytes_at(0, 12))
        at, blocks, tail = TAIL.unpack(self.bytes_at(size - TAIL.size, TAIL.size))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError("not a file of planes, or cut off")
        self.planes = 4 if plane_bits == 8 else 32
        self.index = list(INDEX_ROW.iter_unpack(self.bytes_at(at, blocks * self.planes * INDEX_ROW.size)))
        self.last, self.decompress = (-1, np.empty(0, "<u4")), zstandard.ZstdDecompressor().decompress

    def bytes_at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            rows = self.index[k * self.planes : (k + 1) * self.planes]
            data = self.bytes_at(rows[0][0], rows[-1][0] + rows[-1][1] - rows[0][0])
            planes = [self.decompress(data[at - rows[0][0] : at - rows[0][0] + n]) for at, n, _ in rows]
            self.last = k, from_planes(planes, rows[0][2])
        return self.last[1]

    def ids(self, first: int, n: int) -> Iterator[np.ndarray]:
        """The ids from first on, a piece for each block."""
        while n > 0:
            piece = self.block(first // self.block_ids)[first % self.block_ids :][:n]
            yield piece
            first, n = first + len(piece), n - len(piece)


class WordEncoder:
    """The tokenizers library's ids of whole texts, for tokenizers whose pieces never cross white space.

    The texts are cut at white space, the library encodes the distinct words, and their ids are put together again; ids of
    words met lately are remembered. Texts with characters that only Python takes for white space are encoded as they are.
    The result equals encoding the whole texts, which the tests check.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer, self.recent, self.older = Tokenizer.from_file(vocabulary), {}, {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(pieces.values()) + 1, bool)
        for piece, i in pieces.items():
            self.ends[i] = bool(suffix) and piece.endswith(suffix)
        self.marks = {m: self.codes([m])[0] for m in MARKS} if suffix else {}

    def codes(self, words: list[str]) -> list[bytes]:
        """The ids of each of these words."""
        return [array("I", code.ids).tobytes() for code in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def letter_codes(self, words: list[str]) -> list[bytes]:
        """The ids of each of these words of letters alone, which are one word to the tokenizer, so that one id of each
        ends a word: encoded as one text, and cut there."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self.codes(words)
        data, cuts = ids.tobytes(), [0, *(ends * 4).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, words: set[str]) -> None:
        """Puts the ids of these words among the recent ones."""
        recent, older, plain, odd = self.recent, self.older, [], []
        for word in words:
            if (code := older.get(word)) is not None:
                recent[word] = code
            elif self.marks and word.isalpha() and (word.isascii() or word.lower().isalpha()):
                plain.append(word)
            else:
                odd.append(word)
        for some, encode in ((odd, self.codes), (plain, self.letter_codes)):
            for first in range(0, len(some), 500):
                recent.update(zip(some[first : first + 500], encode(some[first : first + 500]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as u32, little-endian."""
        if len(self.recent) > WORDS_KEPT:
            self.recent, self.older = {}, self.recent
        recall, marks, rows, missing = self.recent.get, self.marks, [], []
        for text in texts:
            if NOT_SPACE.search(text):
                rows.append([array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()])
                continue
            words = text.split()
            codes = list(map(recall, words))
            rows.append(codes)
            if None in codes:
                for i, code in enumerate(codes):
                    if code is None:
                        word = words[i]
                        if (mark := marks.get(word[-1])) and (core := word[:-1]).isalpha():
                            word = core  # remembered without its mark
                            code = recall(core)
                        else:
                            mark = b""
                        if code is None:
                            missing.append((codes, i, word, mark))
                        else:
                            codes[i] = code + mark
        self.learn({word for _, _, word, _ in missing if len(word) <= WORD_CHARS})
        for codes, i, word, mark in missing:
            codes[i] = (recall(word) or self.codes([word])[0]) + mark
        return [b"".join(codes) for codes in rows]


@cache
def encoder(vocabulary: str) -> WordEncoder:
    """One for all tasks of a worker."""
    return WordEncoder(vocabulary)


def tokenised(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """key and ids (binary, u32 little-endian, with the end id) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = b"" if end_id is None else array("I", [end_id]).tobytes()
        for batch in batches:
            for first, last in sized_parts(batch.column(1), PART_BYTES):
                part = batch.slice(first, last - first)
                rows = [ids + end for ids in encoder(vocabulary).encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["key", "ids"])

    return docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text")).mapInArrow(run, "key long, ids binary")


CONTENTS = "key long, part int, file string, file_at int, first long, n long"


def write_planes(rows: DataFrame, part: Column, path: str, block_ids: int = BLOCK_IDS, plane_bits: int = 8, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes rows(key, ids) as files of planes below the path, in ascending order of key; returns the table of contents.

    Null keys come first; rows with one key lie side by side, those with fewer ids first. part numbers ranges of keys in
    order (see range_part()); a task holds one block of ids and one row in memory.
    """
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(path)
        system.create_dir(base, recursive=True)
        writer, name, file_at, of = None, "", -1, None
        for batch in batches:
            out = []
            for key, part, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(ids.as_buffer(), "<u4")
                if writer is None or part != of or writer.n and writer.n + len(ids) > file_ids:
                    if writer:
                        writer.close()
                    file_at, of = file_at + 1 if part == of else 0, part
                    name = f"part-{part:05d}-{file_at:03d}-{uuid.uuid4().hex}.planes"
                    writer = PlaneWriter(system.open_output_stream(f"{base}/{name}"), block_ids, plane_bits)
                out.append((key, part, name, file_at, writer.n, len(ids)))
                writer.add(ids)
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "part", "file", "file_at", "first", "n"), r, strict=True)) for r in out], SCHEMA)
        if writer:
            writer.close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("part", part).repartitionById(parts, "part").sortWithinPartitions("part", "key", F.length("ids"), "ids")
    contents = ordered.select("key", "part", "ids").mapInArrow(run, CONTENTS)
    contents.write.parquet(f"{path}/contents")
    return spark.read.schema(CONTENTS).parquet(f"{path}/contents")


SCHEMA = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("file", pa.string()), ("file_at", pa.int32()), ("first", pa.int64()), ("n", pa.int64())])


def with_starts(contents: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before: those of files before, summed over one row for each file, and first."""
    files = contents.groupBy("part", "file_at", "file").agg(F.sum("n").alias("ids"))
    line = Window.partitionBy(F.lit(0)).orderBy("part", "file_at").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("file", F.coalesce(F.sum("ids").over(line), F.lit(0)).alias("before"))
    return contents.join(before, "file").withColumn("start", F.col("before") + F.col("first")).drop("before")


def read_planes(contents: DataFrame, path: str) -> DataFrame:
    """For each row of contents(key, part, file, first, n, start), read from the files: key, start, n_tokens and ids_crc32.

    Rows are dealt by the part that their file belongs to and read in order, so each block is read and decompressed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(path)
        reader, open_name = None, None
        for batch in batches:
            crcs, counts = [], []
            for name, first, n in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "n")), strict=True):
                if name != open_name:
                    size = system.get_file_info(f"{base}/{name}").size
                    reader, open_name = PlaneReader(system.open_input_file(f"{base}/{name}"), size), name
                crc, count = 0, 0
                for piece in reader.ids(first, n):
                    crc, count = zlib.crc32(piece.tobytes(), crc), count + len(piece)
                crcs.append(crc)
                counts.append(count)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("start"), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    parts = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the rows are small, what they lead to isn't
    rows = contents.select("key", "start", "file", "first", "n", F.pmod("part", F.lit(parts)).cast("int").alias("to"))
    rows = rows.repartitionById(parts, "to").sortWithinPartitions("file", "first")
    return rows.mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", path: str | None = None, **layout) -> DataFrame:
    """Tokenises all rows, writes the files, and reads every document back: key, start, n_tokens and ids_crc32.

    A null text counts as empty, and an empty one has the end id alone. Rows without a key come first; rows that share one
    lie side by side, and each keeps its own ids. A very long text is one row, encoded by itself. An empty table gives an
    empty result. Only the two named columns are read, so other columns' names don't matter.
    """
    spark = docs.sparkSession
    path, parts = path or scratch(spark, "planes"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    contents = write_planes(tokenised(docs, vocabulary, key, text), range_part(docs.select(F.col(key).alias("key")), "key", parts), path, **layout)
    return read_planes(with_starts(contents), path)
