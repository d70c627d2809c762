"""Approximate nearest neighbours by inner product: a graph by NN-descent, searched greedily.

Vectors get an extra component that makes all equally long, so that the largest inner product with a vector is the
nearest of them; the graph is built by these distances, searches and scores use the vectors as they are. Distances don't
change if the mean is taken from all vectors and the extra component counts from the greatest length down, which keeps
small differences where a few vectors are far longer than the others. Nodes are distinct vectors, numbered in the order of
a random projection's signs, and dealt to blocks of consecutive numbers.

The graph begins with the nearest ones among few nodes that lie together in the order of other projections. A round of
NN-descent compares, block by block, what lies around every node (its neighbours and those it is a neighbour of) with each
other, unless both lay there in the round before, and sends what is nearer than a node's farthest neighbour to that node's
block. Rounds end when few neighbours change. Vectors and graph are files of the shared folder, one for each block; only
ids and scores are shuffled.

A search starts at a query's own node and goes on from the nearest nodes found so far, as long as one among the BEAM
nearest has not been looked at. The ENTRIES longest vectors, which the graph has far from others, are then compared too,
and it goes on from those that are near. A worker holds columns of the index in memory up to HELD_BYTES, and reads rows
from the files beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcela.llm.common import Steps

#: Neighbours of a node, nodes that are compared for the first graph, and orders in which they lie together.
DEGREE, CHUNK, ORDERS = 32, 300, 4
#: Rounds at most, and the share of neighbours that must change for another one.
ROUNDS, CHANGED = 6, 0.10
BLOCK = 2048
#: Nodes that a search keeps, and those it looks at in a step.
BEAM, STEP = 256, 64
#: The longest vectors, which every search compares.
ENTRIES = 256
#: Bytes of the index's columns that a Python worker holds in memory, and pairs found that it collects before it sorts out.
HELD_BYTES, FOUND = 320_000_000, 4_000_000
SEED = 20240101
NEVER = np.float32(-np.inf)


def planes(dims: int, order: int, n: int) -> np.ndarray:
    """Random directions of one order: enough signs for chunks of n nodes, and one to sort by within them."""
    bits = max(1, int(np.ceil(np.log2(max(2, n / CHUNK)))))
    return np.random.default_rng([SEED, order, dims]).standard_normal((dims, min(bits, 40) + 1))


def placed(vectors: DataFrame, dims: int, kind: type, order: int, n: int, middle: np.ndarray) -> DataFrame:
    """vectors(.., vec) with side and along: the signs of the projections, and the last projection."""
    directions = planes(dims, order, n)
    weights = 1 << np.arange(directions.shape[1] - 1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_matrix(batch.column("vec"), dims, kind) - middle
            p = x @ directions
            side = (p[:, :-1] > 0) @ weights
            gray = side ^ (side >> 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gray), pa.array(p[:, -1])], [*batch.schema.names, "side", "along"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{kinds}, side long, along double")


def as_matrix(column: pa.Array | pa.ChunkedArray, dims: int, kind: type) -> np.ndarray:
    """The vectors of a binary column, as 64-bit floats."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims).astype(np.float64)


def nearest(similar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the k largest of each row, in no order."""
    k = min(k, similar.shape[1])
    at = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    return at, np.take_along_axis(similar, at, axis=1)


def packed_rows(key: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """One tuple for each value of key: the value, and the bytes of the columns' rows that have it."""
    order = np.argsort(key, kind="stable")
    key, columns = key[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    ends = np.append(cuts[1:], len(key))[: len(cuts)]
    return [(int(key[a]), *[np.ascontiguousarray(c[a:b]).tobytes() for c in columns]) for a, b in zip(cuts, ends, strict=True)]


def arrow(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    """The numbers of all rows of a binary column."""
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


PAIRS = pa.schema([("block", pa.int64()), ("nodes", pa.binary()), ("others", pa.binary()), ("scores", pa.binary())])
PAIRS_SQL = "block long, nodes binary, others binary, scores binary"


def best_pairs(node: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best others of every node, each once, by node; which of equally good ones doesn't depend on their order."""
    if not len(node):
        return np.zeros(0, np.int64)
    high, bits = node.astype(np.uint64) << np.uint64(32), score.view(np.uint32)
    down = np.where(bits >> 31, bits, ~bits & np.uint32(0x7FFFFFFF))  # larger scores have smaller codes
    pair = high | other.astype(np.uint64)
    order = np.argsort(pair)
    starts = np.flatnonzero(np.append(True, pair[order][1:] != pair[order][:-1]))
    if len(starts) < len(order):  # of a pair that comes again, the place of its best score
        best = np.minimum.reduceat(down[order], starts)
        good = np.flatnonzero(down[order] == np.repeat(best, np.diff(np.append(starts, len(order)))))
        order = order[good[np.append(True, pair[order[good[1:]]] != pair[order[good[:-1]]])]]
    order = order[np.argsort(high[order] | down[order])]
    starts = np.flatnonzero(np.append(True, node[order][1:] != node[order][:-1]))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


@dataclass(frozen=True)
class Frame:
    """What the graph's distances are made from: the greatest length, the mean and the unit of length."""

    longest: float
    middle: np.ndarray
    unit: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """The vectors around the mean, with what their extra component lacks of the greatest length, as 32-bit floats."""
        squares = np.einsum("ij,ij->i", x, x)
        lack = squares / (self.longest + np.sqrt(np.maximum(self.longest**2 - squares, 0)))
        return (np.hstack([x - self.middle, lack[:, None]]) / self.unit).astype(np.float32)


def nearness(z: np.ndarray) -> np.ndarray:
    """Half the squared distances of all pairs of lifted vectors, negative; z may have groups before its last two axes."""
    half = np.einsum("...ij,...ij->...i", z, z) / 2
    return z @ z.swapaxes(-1, -2) - half[..., :, None] - half[..., None, :]


def chunk_pairs(dims: int, kind: type, frame: Frame) -> callable:
    """Reads nodes (ord, vec) in order, and yields the nearest ones among those that lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            similar = nearness(frame.lifted(x))
            np.fill_diagonal(similar, NEVER)
            at, score = nearest(similar, DEGREE)
            node, other, score = np.repeat(ids, at.shape[1]).astype(np.int32), ids[at].ravel().astype(np.int32), score.ravel()
            real = score > NEVER
            rows = packed_rows(node[real] // BLOCK, node[real], other[real], score[real])
            return arrow(rows, PAIRS).combine_chunks().to_batches() if rows else []

        ids, x = np.zeros(0, np.int64), np.zeros((0, dims))
        for batch in batches:
            ids = np.concatenate([ids, batch.column("ord").to_numpy()])
            x = np.concatenate([x, as_matrix(batch.column("vec"), dims, kind)])
            while len(ids) >= 2 * CHUNK:
                yield from compared(ids[:CHUNK], x[:CHUNK])
                ids, x = ids[CHUNK:], x[CHUNK:]
        if len(ids):
            yield from compared(ids, x)

    return run


def put(path: str, name: str, *parts: np.ndarray) -> None:
    """Writes a file below the path; under a name of its own first, so that it is there whole or not at all."""
    import uuid

    system, base = fs.FileSystem.from_uri(path)
    system.create_dir(f"{base}/{name.rpartition('/')[0]}", recursive=True)
    with system.open_output_stream(new := f"{base}/{uuid.uuid4().hex}.new") as out:
        for part in parts:
            out.write(np.ascontiguousarray(part).tobytes())
    system.move(new, f"{base}/{name}")


#: Whole columns that this process holds, by path and name; those of the index used last.
HELD: dict[tuple[str, str], np.ndarray] = {}


@dataclass(frozen=True)
class Store:
    """The index's files below the path: of each block of n nodes its names and vectors, and its neighbours by round.

    A column of all nodes is held in memory if it takes HELD_BYTES at most; else rows are read from the files one by one,
    or whole blocks where many rows of a block are wanted.
    """

    path: str
    n: int
    dims: int
    kind: type

    def layout(self, column: str) -> tuple[str, int, np.dtype, int]:
        """The file's name before the block, where the column begins (in bytes for each node before it), kind and width."""
        what, _, turn = column.partition("/")
        if what in ("names", "vectors"):
            return ("nodes", 0, np.dtype(np.int64), 1) if what == "names" else ("nodes", 8, np.dtype(self.kind), self.dims)
        if what == "around":
            return "around", 0, np.dtype(np.int32), 2 * DEGREE
        begin, kind, width = {"least": (0, np.float32, 1), "ids": (4, np.int32, DEGREE), "scores": (4 + 4 * DEGREE, np.float32, DEGREE), "fresh": (4 + 8 * DEGREE, np.bool_, DEGREE)}[what]
        return f"graph{turn}", begin, np.dtype(kind), width

    def size(self, block: int) -> int:
        return min(BLOCK, self.n - block * BLOCK)

    def of_block(self, column: str, block: int, rows: np.ndarray | None = None) -> np.ndarray:
        """A block's column, or these rows of it."""
        name, begin, kind, width = self.layout(column)
        n, each = self.size(block), kind.itemsize * width
        system, base = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(f"{base}/{name}/{block}") as source:
            if rows is None:
                data = source.read_at(n * each, n * begin)
            else:
                data = b"".join([source.read_at(each, n * begin + int(r) * each) for r in rows])
        return np.frombuffer(data, kind).reshape(-1, width)

    def whole(self, column: str) -> np.ndarray | None:
        """The column of all nodes, if it may be held."""
        _, _, kind, width = self.layout(column)
        if (key := (self.path, column)) not in HELD:
            need = self.n * kind.itemsize * width
            for old in list(HELD):
                if old[0] != self.path or old[1].partition("/")[0] == column.partition("/")[0]:
                    del HELD[old]
            if need + sum(x.nbytes for x in HELD.values()) > HELD_BYTES:
                return None
            out = np.empty((self.n, width), kind)
            for block in range(-(-self.n // BLOCK)):
                out[block * BLOCK : block * BLOCK + BLOCK] = self.of_block(column, block)
            HELD[key] = out
        return HELD[key]

    def rows(self, column: str, ids: np.ndarray) -> np.ndarray:
        if (held := self.whole(column)) is not None:
            return held[ids]
        _, _, kind, width = self.layout(column)
        out, order = np.empty((len(ids), width), kind), np.argsort(ids, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(ids[order] // BLOCK) > 0))[: len(ids)]
        for at in np.split(order, cuts[1:]) if len(ids) else []:
            block = int(ids[at[0]]) // BLOCK
            rows = ids[at] - block * BLOCK
            out[at] = self.of_block(column, block, rows) if 8 * len(rows) < BLOCK else self.of_block(column, block)[rows]
        return out

    def drop(self, name: str) -> None:
        system, base = fs.FileSystem.from_uri(self.path)
        system.delete_dir(f"{base}/{name}")


MERGED = "block long, changed long"


def merge(store: Store, turn: int) -> callable:
    """Writes the neighbours of a block's nodes: those of the round before (none in round 0) with the pairs found for it."""

    def run(new: pa.Table) -> pa.Table:
        block = new.column("block")[0].as_py()
        node, other, score = joined(new, "nodes", np.int32) - block * BLOCK, joined(new, "others", np.int32), joined(new, "scores", np.float32)
        n, was = store.size(block), len(node)
        if turn:
            before = store.of_block(f"ids/{turn - 1}", block)
            at, k = np.nonzero(before >= 0)
            node, other = np.concatenate([at, node]), np.concatenate([before[at, k], other])
            score = np.concatenate([store.of_block(f"scores/{turn - 1}", block)[at, k], score])
        known = len(node) - was
        order = best_pairs(node, other, score, DEGREE)
        old = np.sort(node[:known].astype(np.int64) << 32 | other[:known])
        node, other, score = node[order], other[order], score[order]
        rank = np.arange(len(node)) - np.searchsorted(node, np.arange(n))[node]
        ids, scores, fresh = np.full((n, DEGREE), -1, np.int32), np.full((n, DEGREE), NEVER, np.float32), np.zeros((n, DEGREE), bool)
        ids[node, rank], scores[node, rank] = other, score
        pair = node.astype(np.int64) << 32 | other
        fresh[node, rank] = old[np.minimum(np.searchsorted(old, pair), known - 1)] != pair if known else True
        put(store.path, f"graph{turn}/{block}", scores[:, -1], ids, scores, fresh)
        return pa.table({"block": [block], "changed": pa.array([int(fresh.sum())], pa.int64())})

    return run


LISTS = pa.schema([("block", pa.int64()), ("nodes", pa.binary()), ("others", pa.binary()), ("fresh", pa.binary())])
LISTS_SQL = "block long, nodes binary, others binary, fresh binary"


def sampled(node: np.ndarray, other: np.ndarray, fresh: np.ndarray, seed: list[int]) -> np.ndarray:
    """Places of DEGREE others of every node at most, by chance, fresh ones first."""
    return best_pairs(node, other, np.random.default_rng(seed).random(len(node)).astype(np.float32) + fresh.astype(np.float32), DEGREE)


def reversed_lists(store: Store, turn: int) -> callable:
    """For every neighbour in a block of the graph, the nodes that have it, DEGREE at most, dealt by its block; and an empty
    row for the block itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                ids, fresh = store.of_block(f"ids/{turn}", block), store.of_block(f"fresh/{turn}", block)
                at, k = np.nonzero(ids >= 0)
                order = np.lexsort((at, ids[at, k]))
                target, source, new = ids[at, k][order], (at + block * BLOCK).astype(np.int32)[order], fresh[at, k][order]
                kept = sampled(target, source, new, [SEED, block])
                rows = packed_rows(target[kept] // BLOCK, target[kept], source[kept], new[kept])
                yield from arrow([*rows, (block, b"", b"", b"")], LISTS).combine_chunks().to_batches()

    return run


def both_ways(store: Store, turn: int, back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's nodes' neighbours both ways, 2 * DEGREE for each, -1 for none, and which of them are fresh."""
    block = back.column("block")[0].as_py()
    n = store.size(block)
    around, new = np.full((n, 2 * DEGREE), -1, np.int32), np.zeros((n, 2 * DEGREE), bool)
    around[:, :DEGREE], new[:, :DEGREE] = store.of_block(f"ids/{turn}", block), store.of_block(f"fresh/{turn}", block)
    node, other, fresh = joined(back, "nodes", np.int32) - block * BLOCK, joined(back, "others", np.int32), joined(back, "fresh", np.bool_)
    order = np.lexsort((other, node))
    node, other, fresh = node[order], other[order], fresh[order]
    known = (around[node, :DEGREE] == other[:, None]).any(axis=1)
    node, other, fresh = node[~known], other[~known], fresh[~known]
    kept = sampled(node, other, fresh, [SEED, block, 1])
    node, other, fresh = node[kept], other[kept], fresh[kept]
    rank = np.arange(len(node)) - np.searchsorted(node, np.arange(n))[node]
    around[node, DEGREE + rank], new[node, DEGREE + rank] = other, fresh
    return around, new


def best_of(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The DEGREE best pairs of every node among parts of (node, other, score)."""
    node, other, score = (np.concatenate(c) for c in zip(*found, strict=True))
    kept = best_pairs(node, other, score, DEGREE)
    return node[kept], other[kept], score[kept]


def local_join(store: Store, frame: Frame, turn: int) -> callable:
    """Compares all that lie around each node of a block, unless both were there before; the pairs nearer than what their
    node has, and an empty row for the block itself."""

    def run(back: pa.Table) -> pa.Table:
        around, fresh = both_ways(store, turn, back)
        order = np.argsort(~fresh, axis=1, kind="stable")
        around, many = np.take_along_axis(around, order, axis=1), fresh.sum(axis=1)
        nodes = np.unique(around[many > 0])
        nodes = nodes[nodes >= 0].astype(np.int64)
        x, least = frame.lifted(store.rows("vectors", nodes).astype(np.float64)), store.rows(f"least/{turn}", nodes)[:, 0]
        place = np.searchsorted(nodes, np.maximum(around, 0)).clip(0, max(len(nodes) - 1, 0))
        x, least = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)]), np.append(least, np.float32(np.inf))
        place[around < 0] = len(nodes)  # gets nothing, and nobody gets it
        half = np.einsum("ij,ij->i", x, x) / 2
        half[-1] = np.inf
        by_many, found, size = np.argsort(many, kind="stable"), [], 0
        by_many = by_many[np.searchsorted(many[by_many], 1) :]
        for first in range(0, len(by_many), 64):
            at = place[by_many[first : first + 64]]
            rows = int(many[by_many[min(first + 63, len(by_many) - 1)]])
            z = x[at]
            similar = z[:, :rows] @ z.swapaxes(1, 2)
            similar -= half[at[:, :rows]][:, :, None]
            similar -= half[at][:, None, :]
            similar[:, np.arange(rows), np.arange(rows)] = NEVER
            flat = np.flatnonzero(similar > least[at[:, :rows]][:, :, None])
            k, rest = np.divmod(flat, rows * 2 * DEGREE)
            i, j = np.divmod(rest, 2 * DEGREE)
            found.append((at[k, i], at[k, j], similar.ravel()[flat]))
            later = similar[:, :, rows:]
            k, i, j = np.nonzero(later > least[at[:, rows:]][:, None, :])
            found.append((at[k, j + rows], at[k, i], later[k, i, j]))
            size += len(flat) + len(k)
            if size > FOUND + 2 * len(found[0][0]):
                found, size = [best_of(found)], 0
        rows = []
        if found:
            node, other, score = best_of(found)
            node, other = nodes[node].astype(np.int32), nodes[other].astype(np.int32)
            rows = packed_rows(node // BLOCK, node, other, score)
        return arrow([*rows, (back.column("block")[0].as_py(), b"", b"", b"")], PAIRS)

    return run


def written_around(store: Store, turn: int) -> callable:
    """Writes a block of the finished graph, both ways."""

    def run(back: pa.Table) -> pa.Table:
        block = back.column("block")[0].as_py()
        put(store.path, f"around/{block}", both_ways(store, turn, back)[0])
        return pa.table({"block": [block]})

    return run


@dataclass(frozen=True)
class Index:
    """nodes(ord, node, vec), the files of the graph, and the longest nodes with their vectors."""

    nodes: DataFrame
    store: Store
    longest: list[tuple[int, bytes]]


def usable(rows: DataFrame, key: str, vector: str, steps: Steps) -> tuple[DataFrame, list[tuple[int, type]]]:
    """key, v, copies and size of the rows that take part, rows with one key and vector counted, and all sizes, each with the
    kind of float that holds its vectors unchanged."""
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key is not null and v is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    rows = steps.write(rows.groupBy("key", "v").agg(F.count(F.lit(1)).alias("copies")).withColumn("size", F.size("v")))
    long = F.exists("v", lambda x: x != x.cast("float").cast("double"))
    return rows, sorted((r["size"], np.float64 if r["long"] else np.float32) for r in rows.groupBy("size").agg(F.max(long).alias("long")).collect())


def packed(rows: DataFrame, dims: int, kind: type) -> DataFrame:
    """key, copies and vec (binary, floats of this kind) of the rows of this many dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).flatten(), kind).reshape(-1, dims) + kind(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([v.tobytes() for v in x], pa.binary())], ["key", "copies", "vec"])

    return rows.where(F.col("size") == dims).select("key", "copies", "v").mapInArrow(run, "key long, copies long, vec binary")


def numbered(rows: DataFrame, parts: int, steps: Steps) -> DataFrame:
    """rows(node, vec, side, along) with ord, dense from 0, in the order of side and along."""
    placed_rows = steps.write(rows.repartitionByRange(parts, "side", "along").sortWithinPartitions("side", "along", "node").select("node", "vec", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    counts = placed_rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = counts.select("part", (F.coalesce(F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    here = placed_rows.withColumn("part", part).join(F.broadcast(before), "part")  # a row for each partition
    return here.select((F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("ord"), "node", "vec")


def build(vectors: DataFrame, dims: int, kind: type, steps: Steps) -> Index:
    """The graph over vectors(node, vec), all different."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = vectors.count()
    if n >= 1 << 31:
        raise ValueError("nodes are numbered by 32 bits")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_matrix(batch.column("vec"), dims, kind)
            squares = np.einsum("ij,ij->i", x, x)
            yield pa.RecordBatch.from_arrays([pa.array([x.sum(axis=0).tolist()], pa.list_(pa.float64())), pa.array([float(squares.max(initial=0))]), pa.array([float(squares.sum())])], ["total", "longest", "squares"])

    facts = vectors.select("vec").mapInArrow(sums, "total array<double>, longest double, squares double")
    facts = facts.agg(F.max("longest").alias("longest"), F.sum("squares").alias("squares"), *[F.sum(F.get("total", F.lit(i))).alias(f"d{i}") for i in range(dims)]).first()
    middle, most = np.array([facts[f"d{i}"] for i in range(dims)]) / n, float(np.sqrt(facts["longest"]))
    frame = Frame(most, middle, max(float(np.sqrt(facts["squares"] / n)), most / 1e15))

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_matrix(batch.column("vec"), dims, kind)
            squares = np.einsum("ij,ij->i", x, x)
            at = pa.array(np.argsort(-squares, kind="stable")[:ENTRIES])
            yield pa.RecordBatch.from_arrays([batch.column("ord").take(at), batch.column("vec").take(at), pa.array(squares).take(at)], ["ord", "vec", "square"])

    nodes = steps.write(numbered(placed(vectors, dims, kind, 0, n, middle), parts, steps))
    steps.drop(steps.n - 1)
    dealt = lambda rows, *by: (rows.coalesce(1) if n <= 2 * CHUNK else rows.repartitionByRange(min(parts, n // (2 * CHUNK)), *by)).sortWithinPartitions(*by)
    pairs = dealt(nodes.select("ord", "vec"), "ord").mapInArrow(chunk_pairs(dims, kind, frame), PAIRS_SQL)
    for order in range(1, ORDERS if n > CHUNK else 1):
        sides = dealt(placed(nodes.select("ord", "vec"), dims, kind, order, n, middle), "side", "along")
        pairs = pairs.union(sides.select("ord", "vec").mapInArrow(chunk_pairs(dims, kind, frame), PAIRS_SQL))
    store = Store(f"{steps.path}/index", n, dims, kind)
    steps.write(nodes.groupBy(F.floor(F.col("ord") / BLOCK).alias("block")).applyInArrow(block_files(store.path), "block long"))
    blocks = -(-n // BLOCK)
    heads = spark.range(0, blocks, 1, min(parts, blocks)).withColumnRenamed("id", "block")
    by_block = lambda rows: rows.repartition(min(parts, blocks), "block").groupBy("block")
    empty = heads.select("block", *[F.lit(b"").alias(f.name) for f in PAIRS][1:])
    merged = lambda pairs, turn: by_block(pairs).applyInArrow(merge(store, turn), MERGED).agg(F.sum("changed")).first()[0]
    merged(pairs.union(empty), 0)
    turn, still = 0, n > CHUNK
    while still and turn < ROUNDS:
        back = heads.mapInArrow(reversed_lists(store, turn), LISTS_SQL)
        found = by_block(back).applyInArrow(local_join(store, frame, turn), PAIRS_SQL)
        still = merged(found, turn + 1) >= CHANGED * n * DEGREE
        store.drop(f"graph{turn}")
        turn += 1
    steps.write(by_block(heads.mapInArrow(reversed_lists(store, turn), LISTS_SQL)).applyInArrow(written_around(store, turn), "block long"))
    store.drop(f"graph{turn}")
    ends = nodes.select("ord", "vec").mapInArrow(longest, "ord long, vec binary, square double").orderBy(F.col("square").desc(), "ord").limit(ENTRIES).collect()
    return Index(nodes, store, [(r["ord"], bytes(r["vec"])) for r in ends])


def block_files(path: str) -> callable:
    def run(rows: pa.Table) -> pa.Table:
        """Writes a block's names and vectors in the order of their numbers."""
        order = np.argsort(rows.column("ord").to_numpy())
        vectors = rows.column("vec").to_pylist()
        block = int(rows.column("ord")[0].as_py()) // BLOCK
        put(path, f"nodes/{block}", rows.column("node").to_numpy()[order], np.frombuffer(b"".join([vectors[i] for i in order]), np.uint8))
        return pa.table({"block": pa.array([block], pa.int64())})

    return run


def greedy(store: Store, start: int, query: np.ndarray, beam: int, most: int, entries: tuple[np.ndarray, np.ndarray], seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest nodes found from a start, most of them at most, with their inner products; the nearest first, of equally
    near ones that with the smaller name. entries: the longest nodes and their vectors. seen: false for every node, before
    and after."""
    ids, looked, late = np.array([start], np.int32), np.zeros(1, bool), True
    scores, met = store.rows("vectors", ids) @ query, [ids]
    seen[start] = True
    while True:
        front = np.flatnonzero(~looked)[:STEP]
        if len(front):
            looked[front] = True
            new = store.rows("around", ids[front]).ravel()
            new = new[new >= 0]
            new = np.unique(new[~seen[new]])
            near = store.rows("vectors", new) @ query
        elif late:
            fresh, late = ~seen[entries[0]], False
            new, near = entries[0][fresh], entries[1][fresh] @ query
        else:
            break
        if len(new):
            seen[new] = True
            met.append(new)
            if len(ids) == beam:  # scores are in order
                good = near >= scores[-1]
                new, near = new[good], near[good]
            ids, scores = np.concatenate([ids, new]), np.concatenate([scores, near])
            looked = np.concatenate([looked, np.zeros(len(new), bool)])
            if len(ids) > 2 * beam:
                good = np.flatnonzero(scores >= np.partition(scores, -beam)[-beam])
                ids, scores, looked = ids[good], scores[good], looked[good]
            order = np.lexsort((ids, -scores))[:beam]
            ids, scores, looked = ids[order], scores[order], looked[order]
    seen[np.concatenate(met)] = False
    scores = (store.rows("vectors", ids) * query).sum(axis=1)
    order = np.lexsort((store.rows("names", ids)[:, 0], -scores))[:most]
    return ids[order], scores[order]


def search(index: Index, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """query_id, start (its node), ord and score of the k + 1 nearest nodes found for queries(query_id, ord, vec)."""
    store = index.store
    longest = np.array([o for o, _ in index.longest], np.int32), np.frombuffer(b"".join(v for _, v in index.longest), store.kind).reshape(-1, store.dims).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(store.n, bool)
        for batch in batches:
            columns: tuple[list, list, list, list] = ([], [], [], [])
            for query, start, vec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, scores = greedy(store, start, np.frombuffer(vec, store.kind).astype(np.float64), beam, k + 1, longest, seen)
                for column, values in zip(columns, (np.full(len(ids), query), np.full(len(ids), start), ids.astype(np.int64), scores), strict=True):
                    column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["query_id", "start", "ord", "score"])

    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = queries.select("query_id", "ord", "vec").repartitionByRange(parts, "ord", "query_id").sortWithinPartitions("ord")
    return ordered.mapInArrow(run, "query_id long, start long, ord long, score double")


def nearest_neighbours(rows: DataFrame, k: int, is_query, key: str = "vec_id", vector: str = "embedding", beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), the key, score and query_node of the k nearest rows found for each query row, itself left
    out. is_query: a Column over key.

    Rows take part if their key isn't null and their vector isn't null or zero and holds no null and no infinite value.
    Rows have an inner product with those of as many dimensions only, so each number of dimensions is searched by itself.
    Rows with equal vectors are one node of the graph; of each the k + 1 smallest keys can be among the results. Rows that
    repeat a key with another vector are queries and candidates of their own (query_node tells such queries apart); rows
    that repeat both are one query, and as many candidates as there are rows. Ties go to smaller keys. Fewer rows than k
    give all of them; a table without usable rows gives an empty result. Other columns are not read.
    """
    spark = rows.sparkSession
    steps = Steps(spark, "neighbours")
    vectors, sizes = usable(rows, key, vector, steps)
    if not sizes:
        return spark.createDataFrame([], f"query_id long, rank int, `{key}` long, score double, query_node long")
    every = [neighbours_of(packed(vectors, dims, kind), dims, kind, k, is_query, beam, Steps(spark, "neighbours", steps.path)) for dims, kind in sizes]
    ranked = reduce(DataFrame.unionByName, every)
    return steps.result(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score", "query_node"), "nearest")


def neighbours_of(vectors: DataFrame, dims: int, kind: type, k: int, is_query, beam: int, steps: Steps) -> DataFrame:
    """nearest_neighbours() of vectors(key, copies, vec), all of one number of dimensions."""
    vectors = steps.write(vectors)
    nodes = vectors.groupBy("vec").agg(F.min("key").alias("node"))
    index = build(nodes, dims, kind, steps)
    own = steps.write(vectors.join(index.nodes.select("ord", "vec"), "vec").select("key", "copies", "ord", "vec"))
    queries = own.where(is_query(F.col("key"))).select(F.col("key").alias("query_id"), "ord", "vec")
    found = search(index, queries, k, beam)
    copies = own.select("ord", "key", "copies", F.pmod(F.xxhash64("key"), F.lit(64)).alias("salt"))
    first = lambda rows, *by: rows.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("at") <= k + 1)
    copies = first(first(copies, "ord", "salt").drop("at"), "ord").select("ord", "key", "copies")
    others = F.col("copies") - F.when((F.col("key") == F.col("query_id")) & (F.col("ord") == F.col("start")), 1).otherwise(0)
    each = found.join(copies, "ord").withColumn("others", F.least(others, F.lit(k + 1)).cast("int")).where("others > 0")
    each = each.select("query_id", "start", "score", "key", F.explode(F.sequence(F.lit(1), F.col("others"))).alias("copy"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "start").orderBy(F.col("score").desc(), "key", "copy")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "key", "score", F.col("start").alias("query_node"))
