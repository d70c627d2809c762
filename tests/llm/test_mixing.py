import hashlib
import random
import re

from pyspark.sql import functions as F

from parcela.llm import mixing as m


def words(n):
    return " ".join(["w"] * n)


def brute(rows):
    """taken and target by row, with the water level found by sharing the excess again and again."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows]
    sources = sorted({s for _, _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, open_, rest = {}, set(sources), 1.5 * sum(size)
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * total[s]}
        for s in full or open_:
            target[s] = 2 * total[s] if full else share[s]
        rest -= sum(target[s] for s in full)
        open_ -= full or open_
    return size, total, target


def test_targets_and_taken(documents):
    rng = random.Random(2)
    rows = [(i, words(rng.randint(0, 40)), "en", rng.choice("aaaaaabcd") if i % 9 else None) for i in range(700)]
    size, total, target = brute(rows)
    got = {r.doc_id: r for r in m.mixed(documents(rows)).collect()}
    by_source = {}
    for (i, _, _, s), n in zip(rows, size, strict=True):
        r = got[i]
        assert (r.size, r.source_size) == (n, total[s]) and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 2 * n and sum(t.words for t in r.turns) == r.taken and all(0 <= t.position <= 1 for t in r.turns)
        by_source[s] = by_source.get(s, 0) + r.taken
    assert all(abs(by_source[s] - int(target[s] + 1e-9)) <= 1 for s in total)
    again = {r.doc_id: r for r in m.mixed(documents(rows[::-1])).collect()}
    assert again == got


def test_positions_follow_the_schedules(documents):
    """In any span of the run, a source delivers what its schedule integrates to there."""
    rows = [(i, words(5), "en", "abc"[i % 3]) for i in range(1500)]
    order = m.training_rows(m.mixed(documents(rows), keep=("doc_id", "source"))).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    for name, (w0, wm, w1) in {"a": (1.5, 1.0, 0.5), "b": (0.5, 1.0, 1.5), "c": (1.0, 1.5, 0.5)}.items():
        own = [r for r in order if r.source == name]
        half = sum(r.words for r in own if r.position < 0.5) / sum(r.words for r in own)
        assert abs(half - (w0 + wm) / (w0 + 2 * wm + w1)) < 0.01


def test_word_edges(spark):
    texts = ["", " a ", "a\x0bb\x0cc", "a b", " x y", None, "a\x1cb"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(m.word_count(F.col("t"))).collect()]
    assert got == [0, 1, 3, 1, 2, 0, 1]


def test_odd_rows(documents, odd_documents):
    got = m.mixed(odd_documents).collect()
    assert len(got) == 11 and all(0 <= r.taken <= 2 * r.size for r in got)
    assert m.mixed(documents([])).collect() == [] and [r.taken for r in m.mixed(documents([(1, None, None, None)])).collect()] == [0]


def test_digest_is_the_order(documents):
    """With one source, the second pass covers the documents whose digests come first."""
    rows = [(i, words(2), "en", "a") for i in range(40)]
    got = {r.doc_id: r.taken for r in m.mixed(documents(rows)).collect()}
    order = sorted(range(40), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert [got[i] for i in order] == [4] * 20 + [2] * 20
