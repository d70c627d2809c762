"""Near duplicates by Order MinHash, with candidates verified by banded alignment.

Order MinHash samples, under each of SKETCHES hash functions, the MINIMA smallest k-mers of a text and keeps them in text
order, so two texts agree on a sketch if they share these k-mers in that order, which follows their edit similarity. Here
a k-mer is a run of KMER words; a k-mer that comes again counts as another one (its occurrence is part of what is hashed).

Exact copies are one node. Nodes that agree on a sketch share a bucket. In a bucket every node is compared with one of
them of about its length, the hub, never with all: copies of one text thus cost one comparison each. Lengths are cut into
cells twice, so that any two that may be alike share a cell.

Two nodes of different classes that share a bucket and a cell, neither being its hub, are untested (a passage that unlike
texts share makes many such nodes). All untested nodes are sketched again, by MINIMA words each among the rarer half of a
text's words. Those that share a new sketch elect a hub of their own, whatever bucket they came from; cells of PAIRED nodes
at most compare all their pairs of different classes instead. New sketches travel packed, many to a row, and only pairs to
compare come out as rows. This goes on with other hash functions until a round finds no link; a node takes part in the
next round if it shared a new sketch and a larger cell with a node of another class, neither being its hub. Words of a
passage that many texts hold are common among them, so alike texts meet on what is theirs alone.

The links' connected components are the classes. A pair is a link if its alignment over words, by Levenshtein's distance,
leaves a similarity of at least SIMILARITY of the longer text. The alignment is a band of the matrix as wide as the
distance allowed, in bit vectors.

A key that more than a thousandth of the rows have (a thousand keys at most) is hot: its rows stay where they are and what
they join is sent to them, or, where that holds texts, rows are dealt by the key and a salt, to as many copies of the texts.

What is small costs no shuffles: FEW_LINKS links at most are joined to classes by the driver, and untested texts whose words
have FEW_BYTES at most are sent to the tasks that compare them. More than that is joined by key, with the same result.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm.common import Steps, list_array, sized_parts, text_or_empty

KMER, MINIMA, SKETCHES = 5, 2, 48
SIMILARITY = 0.8
PART_BYTES = 1_500_000
#: Sketches of rare words in a further round, the share of a text's words that count as rare, and bins in which words are
#: counted to tell them, as a power of two.
WORD_SKETCHES, RARE, COUNT_BITS = 36, 0.5, 18
#: Cells of new sketches with at most so many nodes compare all pairs; new sketches that are grouped in one part.
PAIRED, PART_NAMES = 8, 100_000
#: A new sketch of a node, as it travels: its name, the node's class (hashed), words and digest.
NAMED = np.dtype([("name", "<u8"), ("label", "<i8"), ("n", "<i4"), ("node", "V16")])
#: A key is hot if more rows have it than this, and than this share of all; its rows go to so many tasks.
HOT_ROWS, HOT_SHARE, SALTS = 1000, 0.001, 64
#: Links that the driver joins to classes (some 10 MB there), bytes of untested words that each executor holds, and pairs
#: that a task compares then.
FEW_LINKS, FEW_BYTES, FEW_PAIRS = 50_000, 32 << 20, 1000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Multipliers of the words of a k-mer.
TURNS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(KMER)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def functions(n: int) -> np.ndarray:
    """Odd multipliers of n hash functions."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


@cache
def kinds() -> np.ndarray:
    """By code point: 0 between words, 1 in a word, 2 a word of its own (scripts that are written without spaces)."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum() or i > 127 and unicodedata.category(c)[0] == "M":
            out[i] = 1
    for low, high in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
        out[low : high + 1] *= 2
    return out


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@cache
def usual_powers(base: int) -> np.ndarray:
    return powers(base, 1 << 21)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-case words of all texts as 32-bit hashes, one after the other, and each text's number of words."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    kind = kinds()[codes]
    before = np.append(0, kind[:-1])
    starts = np.flatnonzero((kind > 0) & ((before != 1) | (kind == 2)))
    after = np.append(kind[1:], 0)
    ends = np.flatnonzero((kind > 0) & ((after != 1) | (kind == 2))) + 1
    n = len(codes)
    up, down = (usual_powers(b)[:n] if n <= 1 << 21 else powers(b, n) for b in (BASE, INVERSE))
    sums = np.append(np.uint64(0), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up))
    hashes = (mixed((sums[ends] - sums[starts]) * down[starts]) >> np.uint64(32)).astype(np.uint32)
    bounds = np.cumsum([len(t) + 1 for t in lower])
    return hashes, np.diff(np.append(0, np.searchsorted(starts, bounds)))


def kmers(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of texts that have words, and each text's number of them. A text with fewer words has one."""
    ends = np.repeat(np.cumsum(counts), counts)
    place = np.arange(len(hashes))
    total = np.zeros(len(hashes), np.uint64)
    padded = np.append(mixed(hashes.astype(np.uint64)), np.zeros(KMER, np.uint64))
    for k in range(KMER):
        total += np.where(place + k < ends, padded[k : k + len(hashes)] * TURNS[k], np.uint64(0))
    begins = ends - np.repeat(counts, counts)
    valid = (place + KMER <= ends) | (place == begins)
    return mixed(total[valid]), np.maximum(counts - KMER + 1, 1)


def sketches(hashes: np.ndarray, counts: np.ndarray, n_sketches: int = SKETCHES) -> np.ndarray:
    """The sketches of every text, MINIMA k-mers each, in one row. Texts without words have rows of zeros."""
    out = np.zeros((len(counts), n_sketches, MINIMA), np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    mers, sizes = kmers(hashes, counts[filled])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    of = np.repeat(np.arange(len(filled)), sizes)
    own = mers ^ mixed(of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    again = np.append(False, own[order][1:] == own[order][:-1])
    occurrence = np.zeros(len(order), np.uint64)
    if again.any():
        occurrence[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    labelled = mixed(mers + occurrence * np.uint64(BASE))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)

    def smallest(values: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(values == np.repeat(np.minimum.reduceat(values, begins), sizes))
        return at if len(at) == len(begins) else at[np.unique(of[at], return_index=True)[1]]

    for s, odd in enumerate(functions(n_sketches)):
        values = labelled * odd
        values ^= values >> np.uint64(32)
        places = []
        for _ in range(MINIMA):
            places.append(smallest(values))
            values[places[-1]] = top
        for k, row in enumerate(np.sort(np.stack(places), axis=0)):
            out[filled, s, k] = mers[row]
    return out


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Levenshtein's distance of two sequences if it is at most `most`, else something above.

    The columns of the matrix are bit vectors of the 2 * most + 1 cells around the diagonal; the last cell of the band is
    followed down to the last row, then that row to its end.
    """
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full, last = (1 << 2 * most + 1) - 1, 2 * most
    plus, minus, distance, hopeless = full ^ ((1 << most) - 1), 0, min(most, m), 2 * most + n - m
    for j, x in enumerate(b, 1):
        match, shift = masks.get(x, 0), j - most - 1
        match = (match >> shift if shift >= 0 else match << -shift) & full
        same = (((match & plus) + plus) ^ plus | match | minus) & full
        right, left = (minus | ~(same | plus)) & full, same & plus
        if j + most <= m:
            distance += not same >> last
            if distance > hopeless:
                return most + 1
        elif (cell := m - j + most) >= 0:
            distance += (right >> cell & 1) - (left >> cell & 1)
        below = same >> 1
        plus, minus = (left | ~(below | right)) & full, below & right
    return distance


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """1 - distance / longer length of two word sequences if that is at least `least`, else 0."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = int(longer * (1 - least) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return 0.0
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
    tail = int(differ[0]) if len(differ) else short - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) and len(b):
        both, side = np.concatenate([a, b]), np.repeat([1, -1], [len(a), len(b)])
        order = np.argsort(both, kind="stable")
        both, side = both[order], side[order]
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        surplus = np.add.reduceat(side, at)
        if max(surplus[surplus > 0].sum(), -surplus[surplus < 0].sum()) > most:
            return 0.0  # words without a counterpart
        a, b = a.tolist(), b.tolist()
        band = min(most, max(8, 2 * abs(len(a) - len(b))))
        while (distance := banded_distance(a, b, band)) > band and band < most:
            band = min(most, 4 * band)
    else:
        distance = max(len(a), len(b))
    return 1 - distance / longer if distance <= most else 0.0


SKETCHED = "key long, node binary, n int, buckets array<long>"


def buckets(hashes: np.ndarray, counts: np.ndarray, n_sketches: int = SKETCHES) -> np.ndarray:
    """A name for each sketch of every text: equal for texts that agree on it."""
    mers = sketches(hashes, counts, n_sketches)
    names = np.broadcast_to(np.arange(1, n_sketches + 1, dtype=np.uint64) * np.uint64(BASE), mers.shape[:2])
    for k in range(MINIMA):
        names = mixed(names + mers[:, :, k])
    return names.view(np.int64)


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text", n_sketches: int = SKETCHES) -> DataFrame:
    """key, node (digest of the text), n (words) and buckets (none for a text without words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in sized_parts(batch.column(1), PART_BYTES):
                part = batch.slice(first, last - first)
                texts = part.column(1).to_pylist()
                hashes, counts = words(texts)
                nodes = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
                some = counts > 0
                named = list_array(buckets(hashes, counts, n_sketches)[some].ravel(), some * n_sketches)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.binary()), pa.array(counts, pa.int32()), named], ["key", "node", "n", "buckets"])

    return docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text")).mapInArrow(run, SKETCHED)


def word_rows(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """node and words (binary, u32) of the wanted nodes' texts; wanted(node, key) has the key of one row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in sized_parts(batch.column(0), PART_BYTES):
                texts = batch.column(0).slice(first, last - first).to_pylist()
                hashes, counts = words(texts)
                rows = [x.tobytes() for x in np.split(hashes, np.cumsum(counts)[:-1])]
                nodes = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(rows, pa.binary())], ["node", "words"])

    wanted = wanted.select(F.col("key").alias("wanted"))
    texts = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text")).join(wanted, F.col("key").eqNullSafe(F.col("wanted")), "left_semi")
    return texts.select("text").mapInArrow(run, "node binary, words binary").groupBy("node").agg(F.first("words").alias("words"))


def hot_keys(counts: DataFrame, key: str, n: int) -> list:
    """The hot ones among the keys of counts(key, rows), of n rows in all: fewer than 1 / HOT_SHARE."""
    return [r[0] for r in counts.where(F.col("rows") > max(HOT_ROWS, int(n * HOT_SHARE))).select(key).collect()]


def hot_keys_of(rows: DataFrame, key: str) -> list:
    return hot_keys(rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")), key, rows.count())


def salted_join(rows: DataFrame, other: DataFrame, key: str, hot: list, by: str, how: str = "inner") -> DataFrame:
    """rows joined to other(key, ..), which has one row for each key; a hot key's rows are dealt by their column `by` too."""
    if not hot:
        return rows.join(other, key, how)
    salt = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)).alias("salt")
    salts = F.explode(F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    return rows.select("*", salt).join(other.select("*", salts), [key, "salt"], how).drop("salt")


def short_join(rows: DataFrame, other: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """rows joined to other(key, ..), which has one short row for each key; a hot key's rows are not dealt at all."""
    if not hot:
        return rows.join(other, key, how)
    crowd = F.col(key).isin(hot)
    return rows.where(~crowd).join(other.where(~crowd), key, how).union(rows.where(crowd).join(F.broadcast(other.where(crowd)), key, how))


def aligned(pairs: DataFrame, texts: DataFrame, least: float, few: bool = False) -> DataFrame:
    """The pairs(node, hub), in a written table, whose similarity is at least so much. few: the texts are sent to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = ([np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(c)] for c in ("one", "other"))
            alike = pa.array([similarity(a, b, least) > 0 for a, b in zip(one, other, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(alike), batch.column("hub").filter(alike)], ["node", "hub"])

    ones = texts.select("node", F.col("words").alias("one"))
    others = texts.select(F.col("node").alias("hub"), F.col("words").alias("other"))
    if few:
        dealt = pairs.repartition(pairs.count() // FEW_PAIRS + 1)
        joined = dealt.join(F.broadcast(ones), "node").join(F.broadcast(others), "hub")
    else:
        ones = salted_join(pairs, ones, "node", hot_keys_of(pairs, "node"), "hub")
        joined = salted_join(ones, others, "hub", hot_keys_of(pairs, "hub"), "node")
    return joined.select("node", "hub", "one", "other").mapInArrow(run, "node binary, hub binary")


def condensed(links: DataFrame) -> DataFrame:
    """Links that join the same nodes, with one for each node and one for each pair of hubs that share a node: a node's
    hubs, no more than PAIRED times the sketches of all rounds, are joined to the smallest of them."""
    each = links.groupBy("node").agg(F.min("hub").alias("low"), F.collect_set("hub").alias("hubs"))
    hubs = each.select(F.explode("hubs").alias("node"), F.col("low").alias("hub")).where("node != hub").distinct()
    return each.select("node", F.col("low").alias("hub")).union(hubs)


def rooted(pairs: Iterable[tuple[bytes, bytes]]) -> dict[bytes, bytes]:
    """The smallest node of the connected component of every node of the pairs."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (above := root.setdefault(x, x)) != x:
            root[x] = x = root[above]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def local_table(spark: SparkSession, **columns: Iterable[bytes]) -> DataFrame:
    return spark.createDataFrame(pa.table({k: pa.array(list(v), pa.binary()) for k, v in columns.items()}))


def columns_of(df: DataFrame) -> list[list[bytes]]:
    """The columns of a small table, on the driver."""
    return [c.to_pylist() for c in df.toArrow().columns]


def components(links: DataFrame, steps: Steps) -> DataFrame:
    """node and label of every node of links(node, hub), a written table: the smallest node of its connected component.

    The driver joins FEW_LINKS at most. With more of them, every round takes the smallest label among a node and its
    neighbours, then that label's own label, so the rounds needed grow with the logarithm of a component's width. Each
    round is a written table.
    """
    if links.count() <= FEW_LINKS:
        root = rooted(zip(*columns_of(links.select("node", "hub")), strict=True))
        return steps.write(local_table(links.sparkSession, node=root.keys(), label=root.values()))
    links = steps.write(condensed(links))
    both = steps.write(links.select("node", F.col("hub").alias("other")).union(links.select(F.col("hub"), F.col("node"))))
    n, crowds = both.count(), hot_keys_of(both, "other")
    labels, hot = steps.write(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label"))), None
    while True:
        if hot is None:
            hot = hot_keys_of(labels, "label")
        theirs = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
        near = short_join(both, theirs, "other", crowds).groupBy("node").agg(F.min("theirs").alias("theirs"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = short_join(labels, jump, "label", hot, "left")
        lower = F.least("label", "theirs", F.coalesce("further", "label"))
        new = steps.write(jumped.join(near, "node").select("node", F.col("label").alias("was"), lower.alias("label")))
        at = steps.n
        labels = new.select("node", "label")
        facts = new.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("was") != F.col("label")).alias("moved"))
        most = max(HOT_ROWS, int(n * HOT_SHARE))
        facts = facts.agg(F.max("moved").alias("moved"), F.collect_list(F.when(F.col("rows") > most, F.col("label"))).alias("hot")).first()
        if not facts["moved"]:
            return labels
        hot = list(facts["hot"])


def batch_words(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts as 64-bit hashes, sorted within each text, where a word that comes again counts as another one;
    each word's text, and each text's number of words."""
    sizes = np.array([len(r) for r in rows], np.int64)
    of = np.repeat(np.arange(len(rows)), sizes)
    hashes = mixed(np.concatenate([*rows, np.zeros(0, np.uint32)]).astype(np.uint64))
    hashes = hashes[np.lexsort((hashes, of))]
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]))[: len(hashes)]
    at = np.arange(len(hashes))
    occurrence = at - np.maximum.accumulate(np.where(again, 0, at)) if len(at) else at
    return mixed(hashes + occurrence.astype(np.uint64) * np.uint64(BASE)), of, sizes


def bins_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def word_counts(texts: DataFrame) -> np.ndarray:
    """How many words of texts(node, words) are in each bin; 2 ** COUNT_BITS rows at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            tokens, _, _ = batch_words([np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(0)])
            held += np.bincount(bins_of(tokens), minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["bin", "held"])

    found = texts.select("words").mapInArrow(run, "bin long, held long").groupBy("bin").agg(F.sum("held").alias("held")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.int64)
    out[found.column("bin").to_numpy()] = found.column("held").to_numpy()
    return out


def word_sketches(texts: DataFrame, counts: np.ndarray, turn: int) -> DataFrame:
    """node, n and sketches (WORD_SKETCHES names, of the MINIMA smallest rare words under each hash function of this round)
    of texts(node, n, words). The rarer half of a text's words, by the counts of their bins, are its rare ones."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    odds = functions(WORD_SKETCHES * (turn + 1))[WORD_SKETCHES * turn :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, of, sizes = batch_words([np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(2)])
            order = np.lexsort((tokens, counts[bins_of(tokens)], of))
            rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rare = np.ceil(sizes * RARE).astype(np.int64)
            tokens = tokens[order[rank < np.repeat(rare, sizes)]]
            some = rare > 0
            begins = (np.cumsum(rare) - rare)[some]
            names = np.zeros((len(begins), WORD_SKETCHES), np.uint64)
            for k, odd in enumerate(odds if len(begins) else ()):
                values, name = mixed(tokens * odd), np.uint64(k)
                for _ in range(MINIMA):
                    least = np.minimum.reduceat(values, begins)
                    name = mixed(name + least)
                    values[values == np.repeat(least, rare[some])] = top
                names[:, k] = name
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_array(names.view(np.int64).ravel(), some * WORD_SKETCHES)], ["node", "n", "sketches"])

    return texts.select("node", "n", "words").mapInArrow(run, "node binary, n int, sketches array<long>")


def length_cells(least: float) -> Column:
    """Two cells of a length n (column n); lengths of which one is at least that part of the other have one in common."""
    x = F.log(F.col("n").cast("double")) / -np.log(least)
    return F.array(*[F.struct(F.lit(k).alias("grid"), F.floor((x + k) / 2).alias("cell")) for k in (0, 1)])


def alike_lengths(least: float) -> Column:
    return F.least("n", "hub_n") >= F.greatest("n", "hub_n") * F.lit(least) - F.lit(1e-6)


def to_compare(held: np.ndarray, least: float, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Of NAMED rows, each name whole: pairs of nodes to compare (rows of two), and the nodes that stay untested.

    Nodes of one name and cell of lengths are compared if their classes differ and their lengths may be alike: all with
    each other where they are PAIRED at most, else with the hub, the first in this turn's order.
    """
    digests, codes = np.unique(np.ascontiguousarray(held["node"]).view([("a", ">u8"), ("b", ">u8")]), return_inverse=True)
    first = mixed(digests["b"].astype(np.uint64) + np.uint64(turn * BASE % (1 << 64)))[codes]
    n, label = held["n"].astype(float), held["label"]
    pairs, left = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
    for grid in (0, 1):
        cell = np.floor((np.log(n) / -np.log(least) + grid) / 2)
        order = np.lexsort((first, cell, held["name"]))
        name, at = held["name"][order], cell[order]
        starts = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (at[1:] != at[:-1]))[: len(order)])
        sizes = np.diff(np.append(starts, len(order)))
        begin, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        place = np.arange(len(order))
        met = [np.stack([begin, place], axis=1)[(size > PAIRED) & (place > begin)]]
        for k in range(1, PAIRED):
            low = place[(size <= PAIRED) & (place + k < begin + size)]
            met.append(np.stack([low, low + k], axis=1))
        one, other = order[np.concatenate(met)].T
        alike = (label[one] != label[other]) & (np.minimum(n[one], n[other]) >= np.maximum(n[one], n[other]) * least - 1e-6)
        pairs.append(np.sort(np.stack([codes[one], codes[other]], axis=1)[alike], axis=1))
        large = starts[sizes > PAIRED]
        if len(large):
            members = place[(size > PAIRED) & (place > begin)]
            cuts = np.flatnonzero(np.append(True, begin[members][1:] != begin[members][:-1]))
            theirs = label[order[members]]
            mixed_up = np.minimum.reduceat(theirs, cuts) != np.maximum.reduceat(theirs, cuts)
            left.append(codes[order[members[np.repeat(mixed_up, np.diff(np.append(cuts, len(members))))]]])
    return digests[np.unique(np.concatenate(pairs), axis=0)], digests[np.unique(np.concatenate(left))]


def met_again(named: DataFrame, least: float, turn: int) -> DataFrame:
    """node and hub of the pairs that share a new sketch and are to be compared, and the untested nodes (hub null), of a
    written table(node, n, label, sketches). A pair or node may come once from each part of the sketches."""
    parts = max(1, named.count() * WORD_SKETCHES // PART_NAMES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            names = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            held = np.empty(len(names), NAMED)
            held["name"], held["label"] = names, batch.column(2).to_numpy()[of]
            held["n"], held["node"] = batch.column(1).to_numpy()[of], np.frombuffer(b"".join(batch.column(0).to_pylist()), "V16")[of]
            part = (names % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(k, held[order[a:b]].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["part", "held"])

    def settle(rows: pa.Table) -> pa.Table:
        pairs, left = to_compare(np.frombuffer(b"".join(rows.column("held").to_pylist()), NAMED), least, turn)
        digest = lambda x: [v.tobytes() for v in x]
        return pa.table({"node": pa.array(digest(pairs[:, 0]) + digest(left), pa.binary()), "hub": pa.array(digest(pairs[:, 1]) + [None] * len(left), pa.binary())})

    dealt = named.select("node", "n", F.xxhash64("label").alias("label"), "sketches").mapInArrow(deal, "part long, held binary")
    return dealt.groupBy("part").applyInArrow(settle, "node binary, hub binary")


def in_cells(members: DataFrame, least: float, *extra: str) -> DataFrame:
    """cell (of a bucket and a length), node, n and the extra columns of members(bucket, node, n, ..), once for each cell."""
    near = members.select("bucket", "node", "n", *extra, F.explode(length_cells(least)).alias("at"))
    return near.select(F.xxhash64("bucket", "at").alias("cell"), "node", "n", *extra)


def hub_order() -> Column:
    return F.xxhash64("node", F.lit(0)).alias("order")


def with_hubs(members: DataFrame, least: float, steps: Steps) -> DataFrame:
    """node, n, hub and hub_n of members(bucket, node, n) that share a bucket with others of about their length: the hub is
    the one of each cell that hub_order() puts first."""
    near = in_cells(members, least)
    hubs = near.groupBy("cell").agg(F.min(F.struct(hub_order(), "node", "n")).alias("hub"), F.count(F.lit(1)).alias("rows"), F.min("node").alias("low"), F.max("node").alias("high"))
    hubs = steps.write(hubs.where("low != high").select("cell", F.col("hub.n").alias("hub_n"), F.col("hub.node").alias("hub"), "rows"))
    total = hubs.agg(F.sum("rows")).first()[0] or 0
    return short_join(near, hubs.drop("rows"), "cell", hot_keys(hubs, "cell", total)).where("node != hub").where(alike_lengths(least))


def merged(labels: DataFrame, found: DataFrame, steps: Steps) -> DataFrame:
    """The labels (smallest nodes of the components) once the links found(node, hub) are added: only classes are joined."""
    if found.count() <= FEW_LINKS:
        return merged_few(labels, found, steps)
    new = found.select("node").union(found.select(F.col("hub"))).distinct().join(labels, "node", "left_anti")
    labels = steps.write(labels.union(new.select("node", F.col("node").alias("label"))))
    hubs = labels.select(F.col("node").alias("hub"), F.col("label").alias("other"))
    edges = found.join(labels, "node").join(hubs, "hub").where("label != other").select(F.col("label").alias("node"), F.col("other").alias("hub"))
    above = components(steps.write(edges), steps).select(F.col("node").alias("label"), F.col("label").alias("top"))
    moved = short_join(labels, above, "label", hot_keys_of(labels, "label"), "left")
    return steps.write(moved.select("node", F.coalesce("top", "label").alias("label")))


def merged_few(labels: DataFrame, found: DataFrame, steps: Steps) -> DataFrame:
    """As merged(), of links that the driver holds."""
    spark, (ones, others) = labels.sparkSession, columns_of(found.select("node", "hub"))
    ends = {*ones, *others}
    label = dict(zip(*columns_of(labels.join(F.broadcast(local_table(spark, node=ends)), "node", "left_semi").select("node", "label")), strict=True))
    top = rooted((label.get(a, a), label.get(b, b)) for a, b in zip(ones, others, strict=True))
    new = [x for x in ends if x not in label]
    above = F.broadcast(local_table(spark, label=top.keys(), top=top.values()))
    moved = labels.union(local_table(spark, node=new, label=new)).join(above, "label", "left")
    return steps.write(moved.select("node", F.coalesce("top", "label").alias("label")))


def opened(members: DataFrame, labels: DataFrame, hot: list, least: float, steps: Steps) -> DataFrame:
    """node and n of the members that share a cell with one of another class that they were not compared with: all but the
    hub were compared with the hub alone, so two others have to differ. That is so with three classes, or with two if the
    hub isn't alone in its own. hot: the hot buckets."""
    each = steps.write(members.join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("label", "node").alias("label")))
    first = steps.n
    several = each.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    each = steps.write(short_join(each, several.select("bucket"), "bucket", hot))
    steps.drop(first)
    near = in_cells(each, least, "label")
    classes = near.groupBy("cell", "label").agg(F.min(F.struct(hub_order(), "node")).alias("first"), F.count(F.lit(1)).alias("rows"))
    facts = classes.groupBy("cell").agg(F.min(F.struct("first", "rows")).alias("hub"), F.count(F.lit(1)).alias("classes"), F.sum("rows").alias("rows"))
    open_cells = steps.write(facts.where("classes > 2 OR classes = 2 AND hub.rows > 1").select("cell", "rows", F.col("hub.first.node").alias("hub")))
    total = open_cells.agg(F.sum("rows")).first()[0] or 0
    met = short_join(near, open_cells.drop("rows"), "cell", hot_keys(open_cells, "cell", total))
    out = steps.write(met.where("node != hub").select("node", "n").distinct())
    steps.drop(first + 1)
    return out


def with_nodes(docs: DataFrame, text: str = "text", node: str = "node") -> DataFrame:
    """docs with the digest of each row's text, as near_duplicates() has it. A null text counts as empty."""
    names = [*docs.columns, node]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{node}` binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, n_sketches: int = SKETCHES, keep: tuple[str, ...] = ("key", "class_id", "links")) -> DataFrame:
    """For every row key, class_id (the smallest key among all rows whose texts belong together) and links (verified
    links of its text to other texts).

    keep: columns of the result, also node (the text's digest) and label (a node that names the class; unlike class_id it
    tells classes apart that share a key or have none). Other columns of docs are not read, so their names don't matter.

    Rows with equal texts always belong together; a null text counts as empty. Texts without any word are like their
    exact copies only. Rows without a key have the class of their text's other rows, or a null class if no row of the
    class has a key. Repeated rows each keep their row; an empty table gives an empty result.
    """
    steps = Steps(docs.sparkSession, "near")
    every = steps.write(sketched(docs, key, text, n_sketches))
    rows = steps.write(every.select("key", "node"))
    keys = rows.groupBy("node").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("rows"))
    nodes = steps.write(every.groupBy("node").agg(F.first("n").alias("n"), F.first("buckets").alias("buckets")))
    steps.drop(1)
    at = steps.n
    members = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    crowded = steps.write(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    hot = hot_keys(crowded, "bucket", nodes.count() * n_sketches)
    members = steps.write(short_join(members, crowded.select("bucket"), "bucket", hot))
    steps.drop(at)
    wanted = members.select("node").distinct().join(keys, "node")
    texts = steps.write(word_rows(docs, steps.write(wanted), key, text))
    tested = steps.write(with_hubs(members, least, steps).select("node", "hub").distinct())
    links = steps.write(aligned(tested, texts, least))
    labels = components(links, steps)
    left = opened(members, labels, hot, least, steps)
    held, turn = steps.write(texts.join(left, "node").select("node", "n", "words")), 0
    counts, taking = word_counts(held), held
    ends = [F.least("node", "hub").alias("low"), F.greatest("node", "hub").alias("high")]  # a hub may have been a node before
    while True:
        each = word_sketches(taking, counts, turn).join(labels, "node", "left")
        each = steps.write(each.select("node", "n", F.coalesce("label", "node").alias("label"), "sketches"))
        at = steps.n
        met = steps.write(met_again(each, least, turn + 1))
        again = steps.n
        every = met.select(*ends, F.lit(False).alias("old")).union(tested.select(*ends, F.lit(True)))  # low = high: no hub
        once = steps.write(every.groupBy("low", "high").agg(F.max("old").alias("old")).where("not old").select("low", "high"))
        still = once.where("low = high").select(F.col("low").alias("node"))
        pairs = once.where("low != high").select(F.col("low").alias("node"), F.col("high").alias("hub"))
        few = 4 * (each.agg(F.sum("n")).first()[0] or 0) <= FEW_BYTES
        found = steps.write(aligned(pairs, taking, least, few))
        if found.count() == 0:
            break
        links, tested, turn = links.union(found), tested.union(pairs), turn + 1
        labels = merged(labels, found, steps)
        steps.drop(at)
        steps.drop(again)
        taking = held.join(F.broadcast(still) if still.count() <= FEW_LINKS else still, "node", "left_semi")
    ends = links.select("node").union(links.select("hub")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    labels = steps.write(labels.join(ends, "node").join(keys, "node"))
    named = labels.groupBy("label").agg(F.min("key").alias("class_id"))
    linked = short_join(labels.select("node", "label", "links"), named, "label", hot_keys_of(labels, "label"))
    own = F.when(F.col("label").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id")
    classes = keys.join(linked, "node", "left").select("node", "rows", F.coalesce("label", "node").alias("label"), own, F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    classes = steps.write(classes)
    copied = hot_keys(classes, "node", rows.count())
    return steps.result(short_join(rows, classes.drop("rows"), "node", copied).select(*keep), "classes")
