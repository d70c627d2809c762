import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcela.llm import fingerprints as f


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab c😀é", max_size=60), max_size=6))
def test_batches_dont_matter(texts):
    every = f.fingerprints(texts)
    assert every == [f.fingerprints([t])[0] for t in texts]
    for a, p in zip(texts, every, strict=True):
        for b, q in zip(texts, every, strict=True):
            assert (p == q) == (a == b) and 0 <= f.likeness(p, q) <= 1 and f.likeness(p, q) == f.likeness(q, p)


def test_equal_substrings_share_phrases_at_any_offset():
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdefgh ijklm") for _ in range(n))
    middle = prose(4000)
    texts = [prose(k) + middle + prose(50) for k in (1, 2, 3, 7, 50)]
    names = f.parsed(texts)[0]
    for a, b in zip(names, names[1:], strict=False):
        assert len(set(a.tolist()) & set(b.tolist())) / len(a) > 0.93


def test_phrases_shrink_and_keep_runs():
    codes = f.np.frombuffer(("ab" * 300 + "x" * 500 + "hello world ").encode("utf-32-le"), f.np.uint32)
    starts = f.phrase_starts(codes, f.np.array([0]))
    assert starts.sum() <= len(codes) * 0.5 and not starts[601:1100].any()


def brute(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(t) // 4
        e = t[: len(t) - n] + after[:n]
        p, q, z = (f.fingerprints([x])[0] for x in (t, e, after))
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, f.likeness(p, q), f.likeness(p, z)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 200])
def test_matches_brute_force(documents, n):
    rng = random.Random(n)
    rows = [(i * 3 - 50, "".join(rng.choice("abc de") for _ in range(rng.randint(0, 200)))) for i in range(n)]
    got = f.fingerprinted(documents([(k, t, "en", "a") for k, t in rows])).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_odd_rows(documents, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert sorted(map(tuple, f.fingerprinted(odd_documents).collect()), key=repr) == brute(rows)
    assert f.fingerprinted(documents([])).collect() == []


def test_likeness_follows_edits():
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ijklm") for _ in range(3000))
    near = [f.likeness(*f.fingerprints([text, text[: 3000 - k] + text[:k][::-1]])) for k in (0, 300, 1500, 2999)]
    assert near[0] == 1 and near[1] > 0.6 and near == sorted(near, reverse=True) and near[3] < 0.1
