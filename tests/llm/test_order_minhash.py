import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcela.llm import order_minhash as o
from parcela.llm.common import Steps
from tests_llm_helpers import all_pairs_classes


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


small = st.lists(st.integers(0, 3), max_size=14)


@settings(max_examples=500, deadline=None)
@given(small, small, st.integers(0, 9))
def test_banded_distance(a, b, most):
    want, got = levenshtein(a, b), o.banded_distance(a, b, most)
    assert got == want if want <= most else got > most


@settings(max_examples=300, deadline=None)
@given(small, small)
def test_similarity(a, b):
    longer = max(len(a), len(b))
    want = 1 - levenshtein(a, b) / longer if longer else 1.0
    got = o.similarity(np.array(a, np.uint32), np.array(b, np.uint32))
    assert got == (pytest.approx(want) if want >= 0.8 - 1e-9 else 0)


def test_sketches_dont_depend_on_neighbours_in_a_batch():
    texts = ["", "a", "one two three four five six", "b " * 50, "!!", "x y z " * 9, "日本語のテキスト"]
    hashes, counts = o.words(texts)
    assert counts.tolist() == [0, 1, 6, 50, 0, 27, 8]
    every = o.sketches(hashes, counts)
    for i, t in enumerate(texts):
        assert np.array_equal(o.sketches(*o.words([t]))[0], every[i])
    assert not np.array_equal(every[2], o.sketches(*o.words(["six five four three two one"]))[0])


def test_order_matters():
    rng = random.Random(1)
    w = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    a, b = (o.sketches(*o.words([" ".join(x)]))[0] for x in (w, w[100:] + w[:100]))
    kept = (a == b).all(axis=1).mean()
    assert 0.2 < kept < 0.8  # a MinHash without order would keep nearly all


def prose(rng, n):
    return [f"w{int(rng.paretovariate(0.6))}" for _ in range(n)]


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + rng.randint(0, 1)] = [f"e{rng.randint(0, 9999)}"] * rng.randint(0, 2)
    return w


def planted(seed=3):
    rng = random.Random(seed)
    passage, rows, truth, n = prose(rng, 60), [], {}, 0
    for g in range(25):
        base = prose(rng, rng.randint(30, 400))
        copies = [base] * rng.randint(1, 3) + [edited(rng, base, max(1, len(base) // 25)) for _ in range(rng.randint(0, 4))]
        for c in copies:
            rows.append((n, " ".join(c)))
            truth.setdefault(g, []).append(n)
            n += 1
    for _ in range(60):  # unlike texts around one passage
        rows.append((n, " ".join(prose(rng, rng.randint(40, 90)) + passage + prose(rng, rng.randint(40, 90)))))
        truth[f"p{n}"] = [n]
        n += 1
    return rows, {i: min(g) for g in truth.values() for i in g}


def test_planted_copies(documents):
    rows, want = planted()
    rng = random.Random(0)
    rng.shuffle(rows)
    got = {r.key: r.class_id for r in o.near_duplicates(documents([(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == want


def test_copies_that_share_only_a_passage_of_unlike_texts(documents):
    """The copies have the largest digests, so they are never hubs of the buckets of the passage."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(90)]
    own = lambda n: [f"o{rng.getrandbits(40)}" for _ in range(n)]
    digest = lambda t: hashlib.blake2b(t.encode(), digest_size=16).digest()
    rows = [(i, " ".join(own(12) + passage + own(12))) for i in range(80)]
    last = max(digest(t) for _, t in rows)
    while len(rows) < 84:
        text = " ".join(own(5) + passage + own(5))
        if digest(text) > last:
            rows.append((len(rows), text))
    got = {r.key: r.class_id for r in o.near_duplicates(documents([(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == all_pairs_classes(dict(rows)) == {i: min(i, 80) for i, _ in rows}


def test_matches_all_pairs(documents):
    rng = random.Random(8)
    rows = [(i, " ".join(edited(rng, prose(random.Random(i % 40), 80), rng.randint(0, 5)))) for i in range(160)]
    w = {i: o.words([t])[0] for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, _ in rows:
        for j in range(i):
            if o.similarity(w[i], w[j]) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.key: r.class_id for r in o.near_duplicates(documents([(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == {i: find(i) for i in root}


def test_long_chains_are_one_class(documents):
    w = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(w)))
        w = w[4:] + [f"n{i}{k}" for k in range(4)]
    got = {r.class_id for r in o.near_duplicates(documents([(i, t, "en", "a") for i, t in rows])).collect()}
    assert got == {0}


def test_odd_rows(documents, odd_documents):
    got = sorted(((r.key, r.class_id) for r in o.near_duplicates(odd_documents).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 1), (None, None), (3, 3), (4, 4), (5, 4), (6, 6), (6, 6), (7, 7), (8, 8), (9, 9)], key=repr)
    assert o.near_duplicates(documents([])).collect() == []


def test_new_sketches_meet(spark):
    """Small cells compare all pairs of different classes, large ones theirs with one hub; the rest stays untested. The
    sketches make no row each."""
    digest = lambda i: hashlib.blake2b(str(i).encode(), digest_size=16).digest()
    small, large = range(5), range(100, 100 + 3 * o.PAIRED)
    rows = [(digest(i), 50, digest(i % 4), [7, 1000 + i]) for i in small] + [(digest(i), 50, digest(i % 2), [9, 5000 + i]) for i in large]
    rows += [(digest(900), 20, digest(900), [7]), (digest(901), 50, digest(901), [])]
    named = spark.createDataFrame(rows, "node binary, n int, label binary, sketches array<long>").repartition(3)
    label = {r[0]: r[2] for r in rows}
    met = o.met_again(named, o.SIMILARITY, 1).collect()
    pairs = [(bytes(r.node), bytes(r.hub)) for r in met if r.hub]
    assert {frozenset(p) for p in pairs if p[0] in {digest(i) for i in small}} == {frozenset((digest(i), digest(j))) for i in small for j in small if i % 4 != j % 4}
    others = [set(p) for p in pairs if p[0] in {digest(i) for i in large}]
    (hub,) = set.intersection(*others)
    assert len(others) == 1.5 * o.PAIRED and all(label[a] != label[b] for a, b in pairs)
    assert {bytes(r.node) for r in met if not r.hub} == {digest(i) for i in large} - {hub}
    assert len(met) < sum(len(r[3]) for r in rows)


def test_packed_sketches_match_brute_force():
    rng = np.random.default_rng(3)
    n = 3000
    held = np.empty(n, o.NAMED)
    held["name"], held["label"], held["n"] = rng.integers(0, 150, n), rng.integers(0, 5, n), rng.integers(20, 60, n)
    held["node"] = np.frombuffer(b"".join(hashlib.blake2b(bytes([k % 250, k // 250]), digest_size=16).digest() for k in range(n)), "V16")
    cells = {}
    for x in held:
        for grid in (0, 1):
            cells.setdefault((x["name"], grid, int(np.floor((np.log(float(x["n"])) / -np.log(0.8) + grid) / 2))), []).append(x)
    pairs, left = o.to_compare(held, 0.8, 2)
    got = {frozenset((a.tobytes(), b.tobytes())) for a, b in pairs}
    alike = lambda a, b: a["label"] != b["label"] and min(a["n"], b["n"]) >= 0.8 * max(a["n"], b["n"]) - 1e-6
    apart = lambda xs: {frozenset((a["node"].tobytes(), b["node"].tobytes())) for a in xs for b in xs if alike(a, b)}
    assert set().union(*[apart(xs) for xs in cells.values() if len(xs) <= o.PAIRED]) <= got <= set().union(*map(apart, cells.values()))
    stays = {v.tobytes() for v in left}
    for xs in (xs for xs in cells.values() if len(xs) > o.PAIRED):
        inside = [x for x in xs if x["node"].tobytes() in stays]
        assert len({x["label"] for x in xs}) < 3 or len(inside) >= len(xs) - 1


def digest_of(i):
    return hashlib.blake2b(str(i).encode(), digest_size=16).digest()


def test_few_links_are_joined_without_shuffles(spark):
    """Classes are joined by the driver; the labels stay where they are. A job has several stages if it shuffles: only the
    count of the links does."""
    steps = Steps(spark, "test")
    low = sorted(digest_of(i) for i in range(9))
    labels = steps.write(spark.createDataFrame([(low[i], low[i // 2 * 2]) for i in range(6)], "node binary, label binary"))
    found = steps.write(spark.createDataFrame([(low[5], low[1]), (low[8], low[3]), (low[7], low[6])], "node binary, hub binary"))
    context = spark.sparkContext
    context.setJobGroup("few links", "")
    try:
        got = o.merged(labels, found, steps)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    jobs = tracker.getJobIdsForGroup("few links")
    assert sum(len(tracker.getJobInfo(j).stageIds) > 1 for j in jobs) == 1
    want = {low[0]: 0, low[1]: 0, low[4]: 0, low[5]: 0, low[2]: 2, low[3]: 2, low[8]: 2, low[6]: 6, low[7]: 6}
    assert {bytes(r.node): low.index(bytes(r.label)) for r in got.collect()} == want


def test_many_links_and_texts_give_the_same(documents, monkeypatch):
    rows, want = planted(4)
    docs = documents([(i, t, "en", "a") for i, t in rows])
    few = sorted((r.key, r.class_id, r.links) for r in o.near_duplicates(docs).collect())
    monkeypatch.setattr(o, "FEW_LINKS", 0)
    monkeypatch.setattr(o, "FEW_BYTES", 0)
    monkeypatch.setattr(o, "HOT_ROWS", 3)
    many = sorted((r.key, r.class_id, r.links) for r in o.near_duplicates(docs).collect())
    assert few == many and {k: c for k, c, _ in few} == want


def test_open_cells_match_brute_force(spark):
    """Untested are the members of a cell other than its hub, if two of them differ in their class."""
    rng = random.Random(6)
    members = sorted({(rng.randrange(40), rng.randrange(90)) for _ in range(300)})
    words, label = {i: rng.randint(20, 60) for i in range(90)}, {i: i % rng.choice([2, 3, 90]) for i in range(90)}
    rows = spark.createDataFrame([(b, digest_of(i), words[i]) for b, i in members], "bucket long, node binary, n int")
    labels = spark.createDataFrame([(digest_of(i), digest_of(label[i])) for i in range(80)], "node binary, label binary")
    place = {bytes(r.node): r.order for r in rows.select("node", o.hub_order()).collect()}
    cells = {}
    for b, i in members:
        for grid in (0, 1):
            cells.setdefault((b, grid, int(np.floor((np.log(words[i]) / -np.log(0.8) + grid) / 2))), set()).add(i)
    want = set()
    for cell in cells.values():
        others = cell - {min(cell, key=lambda i: (place[digest_of(i)], digest_of(i)))}
        if len({label[i] if i < 80 else i for i in others}) > 1:
            want |= others
    for hot in ([], [0, 1, 2]):
        assert {bytes(r.node) for r in o.opened(rows, labels, hot, 0.8, Steps(spark, "test")).collect()} == {digest_of(i) for i in want}
