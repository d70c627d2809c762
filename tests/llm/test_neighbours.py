import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from parcela.llm import neighbours as m

SQL = "vec_id long, embedding array<double>, key string, ord long"


def table(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], "clash", 1) for k, v in rows], SQL).repartition(3)


def brute(rows, k, every):
    out = {}
    for q, v in rows:
        if q % every == 0:
            scores = sorted((-float(np.dot(v, w)), j) for j, w in rows if j != q)[:k]
            out[q] = [j for _, j in scores]
    return out


def found(spark, rows, k, every):
    got = {}
    for r in m.nearest_neighbours(table(spark, rows), k, lambda key: key % every == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [v for _, v, _ in sorted(x)] for q, x in got.items()}


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 6) + 0.5) for i in range(120)]
    assert found(spark, rows, 5, 10) == brute(rows, 5, 10)


def test_fewer_rows_than_asked(spark):
    rows = [(i, v) for i, v in enumerate([(1, 0), (0, 1), (1, 1)])]
    assert found(spark, rows, 20, 1) == brute(rows, 20, 1)
    assert found(spark, rows[:1], 20, 1) == {}


def test_copies_and_ties(spark):
    """Half of all rows are one vector; its smallest keys come first."""
    rng = np.random.default_rng(2)
    rows = [(i, (1.0, 2.0, 3.0)) if i % 2 else (i, rng.standard_normal(3)) for i in range(300)]
    assert found(spark, rows, 7, 25) == brute(rows, 7, 25)


def test_rows_that_take_no_part(spark):
    rows = [(0, (1, 0)), (1, None), (2, (0, 0)), (3, (1, None)), (4, (1, float("nan"))), (5, (float("inf"), 1)), (6, (2, 1)), (7, (1, 2, 3)), (8, ()), (9, (-1, 1)), (None, (1, 1)), (6, (2, 1))]
    assert found(spark, rows, 5, 3) == {0: [6, 6, 9], 6: [6, 0, 9], 9: [0, 6, 6]}
    assert found(spark, [], 5, 3) == {} and found(spark, [(0, None)], 5, 3) == {}


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2500, 24)) + 3 * rng.standard_normal((10, 24))[rng.integers(0, 10, 2500)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= rng.uniform(0.5, 2, (2500, 1)) if scaled else 1
    rows = list(enumerate(x))
    want, got = brute(rows, 20, 20), found(spark, rows, 20, 20)
    assert sum(len(set(want[q]) & set(got[q])) for q in want) / (20 * len(want)) >= 0.95


def test_graph_search_finds_what_the_graph_lacks(spark):
    """A narrow beam finds less, so results come from the search and not from a scan."""
    rng = np.random.default_rng(5)
    rows = list(enumerate(rng.standard_normal((2500, 48))))
    want = brute(rows, 20, 100)
    recall = {}
    for beam in (21, 256):
        got = {}
        for r in m.nearest_neighbours(table(spark, rows), 20, lambda key: key % 100 == 0, beam=beam).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        recall[beam] = sum(len(set(want[q]) & got[q]) for q in want) / (20 * len(want))
    assert recall[21] < recall[256] and recall[256] > 0.9


def test_rows_that_share_an_id(spark):
    """Other vectors of a key stay candidates, and so do vectors of other dimensions among themselves."""
    rows = [(0, (1, 0)), (1, (2, 0)), (1, (3, 1)), (2, (1, 1)), (5, (1, 1, 1)), (0, (2, 2, 2))]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in m.nearest_neighbours(table(spark, rows), 5, lambda key: key % 5 == 0).collect())
    assert got == [(0, 1, 1, 3.0), (0, 1, 5, 6.0), (0, 2, 1, 2.0), (0, 3, 2, 1.0), (5, 1, 0, 6.0)]


def test_recall_beside_a_few_very_long_vectors(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((2500, 24)) + 2 * rng.standard_normal((20, 24))[rng.integers(0, 20, 2500)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[[7, 700, 1900]] *= np.array([[2e3], [1e5], [3e7]])
    rows = list(enumerate(x))
    want, got = brute(rows, 20, 20), found(spark, rows, 20, 20)
    assert sum(len(set(want[q]) & set(got[q])) for q in want) / (20 * len(want)) >= 0.95


def small_index(path, n=2500, dims=8):
    """The files of two blocks, and the nearest among those that lie together in two orders."""
    store = m.Store(f"file://{path}", n, dims, np.float32)
    x = np.random.default_rng(6).standard_normal((n, dims)).astype(np.float32)
    for block in range(2):
        here = slice(block * m.BLOCK, block * m.BLOCK + store.size(block))
        m.put(store.path, f"nodes/{block}", np.arange(n)[here] * 3, x[here])
    frame = m.Frame(float(np.linalg.norm(x.astype(float), axis=1).max()), x.mean(axis=0, dtype=float), 1.0)
    orders = [np.arange(n), np.random.default_rng(8).permutation(n)]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids), pa.array([v.tobytes() for v in x[ids]])], ["ord", "vec"]) for ids in orders]
    pairs = pa.Table.from_batches([found for b in batches for found in m.chunk_pairs(dims, np.float32, frame)(iter([b]))])
    return store, x, frame, pairs


def test_only_fresh_neighbours_are_compared(tmp_path):
    """A pair that lay around a node before is not compared there again."""
    store, x, frame, pairs = small_index(tmp_path)
    block = lambda t, b: t.filter(pc.equal(t["block"], b))
    heads = lambda: iter([pa.RecordBatch.from_arrays([pa.array([0, 1])], ["block"])])
    assert sum(m.merge(store, 0)(block(pairs, b))["changed"][0].as_py() for b in (0, 1)) == 2500 * m.DEGREE
    back = pa.Table.from_batches(m.reversed_lists(store, 0)(heads()))
    found = pa.concat_tables([m.local_join(store, frame, 0)(block(back, b)) for b in (0, 1)])
    assert len(m.joined(found, "nodes", np.int32)) > 2500
    changed = sum(m.merge(store, 1)(block(found, b))["changed"][0].as_py() for b in (0, 1))
    before, after = (np.concatenate([store.of_block(f"ids/{k}", b) for b in (0, 1)]) for k in (0, 1))
    assert changed == sum(len(set(b) - set(a)) for a, b in zip(before, after, strict=True)) > 0
    nothing = pa.Table.from_pylist([{"block": b, "nodes": b"", "others": b"", "scores": b""} for b in (0, 1)], m.PAIRS)
    assert [m.merge(store, 2)(block(nothing, b))["changed"][0].as_py() for b in (0, 1)] == [0, 0]
    back = pa.Table.from_batches(m.reversed_lists(store, 2)(heads()))
    again = [m.local_join(store, frame, 2)(block(back, b)) for b in (0, 1)]
    assert all(len(m.joined(t, "nodes", np.int32)) == 0 and t.num_rows == 1 for t in again)


def test_rows_of_the_index_held_or_not(tmp_path, monkeypatch):
    store, x, _, _ = small_index(tmp_path)
    for ids in (np.array([2400, 3, 2047, 2048, 3]), np.arange(2499, 0, -1), np.zeros(0, np.int64)):
        for most in (0, m.HELD_BYTES):
            monkeypatch.setattr(m, "HELD_BYTES", most)
            m.HELD.clear()
            assert np.array_equal(store.rows("vectors", ids), x[ids])
            assert np.array_equal(store.rows("names", ids)[:, 0], ids * 3)
    m.HELD.clear()


def test_best_pairs_with_repeated_ones():
    rng = np.random.default_rng(7)
    node, other = rng.integers(0, 20, 3000), rng.integers(0, 30, 3000)
    score = rng.integers(-9, 9, 3000).astype(np.float32)
    best = {}
    for a, b, s in zip(node, other, score, strict=True):
        best[a, b] = max(best.get((a, b), -99), s)
    kept = m.best_pairs(node, other, score, 5)
    for a in range(20):
        own = [i for i in kept if node[i] == a]
        assert len({other[i] for i in own}) == len(own) == 5
        assert [score[i] for i in own] == sorted((s for (x, _), s in best.items() if x == a), reverse=True)[:5]
