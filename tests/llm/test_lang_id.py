import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from parcela.llm import lang_id as L

WORDS = {
    "en": "the of and thing with that this for from which would there".split(),
    "de": "der die und nicht mit ein eine schön über für auch werden".split(),
    "fr": "le la les et une dans pour être avec où ça mais".split(),
    "es": "el los las y una para está con niño donde más pero".split(),
}


def texts(seed, n):
    rng = random.Random(seed)
    return [(lang, " ".join(rng.choice(w) for _ in range(rng.randint(3, 60)))) for _ in range(n) for lang, w in WORDS.items()]


def test_held_out_accuracy(documents):
    rows = [(i, t, lang if i % 5 else None, "a") for i, (lang, t) in enumerate(texts(1, 150))]
    docs = documents(rows)
    got = L.identified(docs, L.learned(docs)).select("doc_id", L.held_out("doc_id").alias("held"), "lang_pred", "score").collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    truth = {i: lang for i, (lang, _) in enumerate(texts(1, 150))}
    held = [r for r in got if r.held]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_held_out_labels_and_other_columns_dont_matter(documents):
    rows = [(i, t, lang, "a") for i, (lang, t) in enumerate(texts(2, 40))]
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, "zz") for i, t, lang, _ in rows]
    one, two = (L.learned(documents(r)) for r in (rows, other))
    assert one.languages == two.languages == ("de", "en", "es", "fr") and np.array_equal(one.weights, two.weights)


def test_families_come_first():
    model = L.Model.fit(*map(list, zip(*[(t, lang) for lang, t in texts(3, 30)], strict=True)))
    assert model.duels == (("germanic", "romance"), ("de", "en"), ("es", "fr"))
    assert model.predict(["", "123 !", "der und die nicht", "los niños y una"])[0] == ["und", "und", "de", "es"]
    assert L.family("tlh") == "=tlh"
    lone = L.Model.fit(["abc def"], ["en"])
    assert lone.predict(["x", "-"])[0] == ["en", "und"]
    assert L.Model.fit([], []).predict(["abc"])[0] == ["und"]


def test_batches_dont_matter():
    model = L.Model.fit(*map(list, zip(*[(t, lang) for lang, t in texts(4, 20)], strict=True)))
    some = [t for _, t in texts(5, 8)] + ["", "İ" * 50, "x" * 100_000, "ΑΣ ΑΣ"]
    whole = model.predict(some)
    single = [model.predict([t]) for t in some]
    assert whole[0] == [s[0][0] for s in single] and np.allclose(whole[1], [s[1][0] for s in single])


def test_odd_rows(documents, odd_documents):
    got = L.identified(odd_documents, L.learned(odd_documents)).collect()
    assert len(got) == 11 and {r.lang_pred for r in got if r.doc_id in (1, 2, 7, 8)} == {"und"}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert L.identified(documents([]), L.learned(documents([]))).collect() == []


def test_sample_is_bounded(documents):
    docs = documents([(i, f"text {i}", "en" if i % 2 else "de", "a") for i in range(400)])
    kept = []
    fit, L.Model.fit = L.Model.fit, classmethod(lambda cls, t, lang: kept.append((t, lang)) or fit(t, lang))
    try:
        L.learned(docs, per_language=20)
    finally:
        L.Model.fit = fit
    assert [kept[0][1].count(x) for x in ("en", "de")] == [20, 20]
    assert docs.where(L.held_out("doc_id")).where(F.col("text").isin(kept[0][0])).count() == 0


def test_languages_with_long_texts_only_and_ids_that_repeat(spark, documents):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    rows = [(None, " ".join(word("abcdef") for _ in range(30)), "xx", "s") for _ in range(20)]
    rows += [(i, " ".join(word("uvwxyz") for _ in range(300)), "yy", "s") for i in range(20)]
    model = L.learned(documents(rows), per_language=5, chars=1000)
    assert model.languages == ("xx", "yy")
    assert model.predict([" ".join(word("uvwxyz") for _ in range(30)), " ".join(word("abcdef") for _ in range(30))])[0] == ["yy", "xx"]
    assert L.learned(documents(rows), most=1).languages == ("xx",)
