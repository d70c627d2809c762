"""Document fingerprints by locally consistent parsing.

A text is a string of names, at first its code points. Each round cuts the string into phrases where deterministic coin
tossing puts landmarks, and names every phrase by a digest of its content; the names are the next round's string, until
one name is left. Runs of one name are phrases of their own. Whether a place is a landmark depends on a few names around
it alone, so equal substrings get the same phrases inside, wherever they stand.

Coin tossing: a name's label is twice the place of the lowest bit in which it differs from the name before it, plus that
bit. Labels of neighbours differ, and four rounds of this leave six labels at most. Local maxima of the labels, and local
minima that no maximum neighbours, are landmarks, so phrases stay short.

A fingerprint has the number of code points, the root's name, and the SKETCH smallest of the names of all phrases of
levels LEVELS. The likeness of two texts is the Jaccard index of these names, estimated from the smallest names of their
union; it is exact for texts with few phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.llm.common import range_part, text_or_empty

#: Rounds of coin tossing on each level; after them labels are below 6.
TOSSES = 4
#: Levels whose phrases are sampled (level 2 has phrases of some 5 to 10 code points), and names in a fingerprint.
LEVELS, SKETCH = (2, 3, 4), 64
#: Hexadecimal digits of a name.
DIGITS = 12
#: Code points that are parsed together.
PART_CHARS = 1_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)
DE_BRUIJN = np.uint64(0x03F79D71B4CB0A89)
BIT_PLACE = np.zeros(64, np.uint8)
for _i in range(64):
    BIT_PLACE[(((1 << _i) * int(DE_BRUIJN)) & (1 << 64) - 1) >> 58] = _i
#: The place of the lowest set bit of 16 bits (16 for none).
LOW16 = np.full(1 << 16, 16, np.uint8)
for _i in reversed(range(16)):
    LOW16[1 << _i :: 1 << (_i + 1)] = _i


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit names that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def first_labels(names: np.ndarray, differs: np.ndarray) -> np.ndarray:
    """The labels of one toss; 0 where the name equals the one before it or begins a text."""
    other = names[1:] ^ names[:-1]
    if names.dtype == np.uint32:
        low = LOW16[other & np.uint32(0xFFFF)]
        if (high := low == 16).any():
            low = np.where(high, 16 + LOW16[other >> np.uint32(16)], low).astype(np.uint8)
    else:
        low = BIT_PLACE[((other & (~other + np.uint64(1))) * DE_BRUIJN) >> np.uint64(58)]
    out = np.zeros(len(names), np.uint8)
    out[1:] = 2 * low + ((names[1:] >> low.astype(names.dtype)) & names.dtype.type(1)).astype(np.uint8)
    out[~differs] = 0
    return out


def phrase_starts(names: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a phrase begins at each place. begins: where texts begin."""
    n = len(names)
    first = np.zeros(n, bool)
    first[begins] = True
    differs = np.ones(n, bool)
    differs[1:] = names[1:] != names[:-1]
    differs |= first
    after = np.ones(n, bool)
    after[:-1] = differs[1:]
    labels = first_labels(names, differs & ~first)
    for _ in range(TOSSES - 1):
        other = labels[1:] ^ labels[:-1]
        low = LOW16[other]
        low[other == 0] = 0
        new = np.zeros(n, np.uint8)
        new[1:] = 2 * low + ((labels[1:] >> low) & 1)
        new[first] = 0
        labels = new
    single = differs & after  # not in a run
    wide = np.zeros(n + 2, np.uint8)
    wide[1:-1] = np.where(single, labels + 1, 0)
    last = np.append(first[1:], True)
    left, mid, right = wide[:-2].copy(), wide[1:-1], wide[2:].copy()
    left[first], right[last] = 0, 0  # other texts don't count
    top = (mid > left) & (mid >= right) & single
    near = np.zeros(n, bool)
    near[1:] = top[:-1] & ~first[1:]
    near[:-1] |= top[1:] & ~last[:-1]
    bottom = (mid < left) & (mid < right) & single & ~near
    starts = first | top | bottom
    run = differs & ~after
    starts |= run
    starts[1:] |= single[1:] & ~single[:-1]
    return starts


def next_names(names: np.ndarray, starts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases' names and places: a digest of the names in each phrase and their number."""
    at = np.flatnonzero(starts)
    sizes = np.diff(np.append(at, len(names)))
    place = np.arange(len(names), dtype=np.uint64) - np.repeat(at.astype(np.uint64), sizes)
    parts = mixed(names.astype(np.uint64) + (place + np.uint64(1)) * ODD)
    return mixed(np.add.reduceat(parts, at) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(level)), at


def parsed(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct names of every text's phrases of LEVELS, sorted, and every text's root."""
    filled = [i for i, t in enumerate(texts) if t]
    roots = np.zeros(len(texts), np.uint64)
    found: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    if not filled:
        return found, roots
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(texts[i]) for i in filled])[:-1]])
    names, own, kept, level = codes, np.array(filled), [], 0
    while len(own):
        level += 1
        starts = phrase_starts(names, begins)
        names, at = next_names(names, starts, level)
        begins = np.searchsorted(at, begins)
        sizes = np.diff(np.append(begins, len(names)))
        if level in LEVELS:
            kept.append((np.repeat(own, sizes), names))
        done = sizes == 1
        if done.any():
            roots[own[done]] = names[begins[done]] + np.uint64(level)
            if level < max(LEVELS):  # a short text's phrase stands for it on the levels above too
                kept += [(own[done], mixed(names[begins[done]] + np.uint64(k))) for k in LEVELS if k > level]
            keep = np.repeat(~done, sizes)
            names, own = names[keep], own[~done]
            begins = np.concatenate([[0], np.cumsum(sizes[~done])[:-1]]) if len(own) else np.zeros(0, int)
    of, names = (np.concatenate(x) for x in zip(*kept, strict=True))
    names = names >> np.uint64(64 - 4 * DIGITS)
    order = np.lexsort((names, of))
    of, names = of[order], names[order]
    fresh = np.append(True, (of[1:] != of[:-1]) | (names[1:] != names[:-1]))
    of, names = of[fresh], names[fresh]
    for i, part in zip(filled, np.split(names, np.searchsorted(of, filled[1:])), strict=True):
        found[i] = part
    return found, roots


def fingerprints(texts: list[str]) -> list[str]:
    """number of code points:root:names, the smallest ones in ascending order, each of DIGITS digits."""
    out: list[str] = []
    first, size = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or size and size + len(texts[i]) > PART_CHARS:
            names, roots = parsed(texts[first:i])
            for text, own, root in zip(texts[first:i], names, roots.tolist(), strict=True):
                out.append(f"{len(text)}:{root:016x}:" + "".join(f"{x:0{DIGITS}x}" for x in own[:SKETCH].tolist()))
            first, size = i, 0
        if i < len(texts):
            size += len(texts[i])
    return out


def likeness(one: str, other: str) -> float:
    """From 0 to 1: the Jaccard index of the phrase names of two fingerprints' texts, estimated; 1 for two empty texts."""
    if one == other:
        return 1.0
    a, b = (f.rpartition(":")[2] for f in (one, other))
    a, b = ({f[i : i + DIGITS] for i in range(0, len(f), DIGITS)} for f in (a, b))
    if not a or not b:
        return 0.0
    union = sorted(a | b)[:SKETCH]
    return sum(x in a and x in b for x in union) / len(union)


def edited(text: str, following: str) -> str:
    """The text, its last quarter replaced by as many code points (or all) of the text that follows."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def sequenced(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """part, key, text and copy of every row, dealt by ranges of the key and sorted, so that each part holds the rows
    that follow one another, and after its last row (copy = true) the first one of the next part.

    Bounds of the ranges come from the keys alone. The copies are one row for each part: those with the smallest key of a
    part that has any, the last part's being the very first row. Null keys come first; rows with one key are sorted by text.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    part = range_part(rows.select("key"), "key", parts)
    firsts = sorted((p, None if null else k) for p, k, null in rows.groupBy(part.alias("part")).agg(F.min("key"), F.max(F.col("key").isNull())).collect())
    before = [firsts[-1], *firsts[:-1]] if firsts else []
    told = spark.createDataFrame([(k, p) for (_, k), (p, _) in zip(firsts, before, strict=True)], "first long, sent int")
    rows = rows.join(F.broadcast(told), F.col("key").eqNullSafe(F.col("first")), "left")  # a row for each part
    own = F.struct(part.alias("part"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("sent").alias("part"), F.lit(True).alias("copy"))
    dealt = rows.withColumn("to", F.explode(F.when(F.col("sent").isNull(), F.array(own)).otherwise(F.array(own, copy)))).select("to.part", "to.copy", "key", "text")
    return dealt.repartitionById(parts, "part").sortWithinPartitions("part", "copy", "key", "text")


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row its fingerprint, that of its edited text, and their likeness, and that to the next row's, in RESULT.

    A null text counts as empty. A table of one row is followed by itself; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, key, text and fingerprint of the row whose next one isn't known yet

        def told(pairs: list[tuple]) -> pa.RecordBatch:
            changed = [edited(a[2], b[2]) for a, b in pairs]
            prints = fingerprints(changed)
            rows = [
                (a[1], len(a[2]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), a[3], p, likeness(a[3], p), likeness(a[3], b[3]))
                for (a, b), e, p in zip(pairs, changed, prints, strict=True)
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in RESULT.split(", ")])

        for batch in batches:
            parts, copies, keys, texts = (batch.column(i).to_pylist() for i in range(4))
            pairs = []
            for row in zip(parts, keys, texts, fingerprints(texts), copies, strict=True):
                if held and held[0] == row[0]:
                    pairs.append((held, row))
                held = None if row[4] else row
            yield told(pairs)

    return sequenced(docs, key, text).select("part", "copy", "key", "text").mapInArrow(run, RESULT)
