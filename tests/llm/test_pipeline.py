import random

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as c
from parcela.llm import secret_scan
from tests_llm_helpers import all_pairs_classes


def test_stages_on_odd_rows(spark, odd_documents, tmp_path):
    docs = odd_documents.select(*c.COLUMNS)
    for k, (name, stage) in enumerate(c.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(c.STAGES) - 1:
            assert docs.columns == list(c.COLUMNS), name
    first = spark.read.parquet(str(tmp_path / "0"))
    assert sorted(r.doc_id or -1 for r in first.collect()) == [-1, 3, 4, 5, 6, 6, 9]
    second = spark.read.parquet(str(tmp_path / "1"))
    assert sorted(r.doc_id or -1 for r in second.collect()) in ([3, 4, 6, 9], [-1, 3, 4, 6, 9])
    assert all(r.round_trip for r in docs.collect())


def test_stages_on_empty_tables(spark, documents, tmp_path):
    docs = documents([], extra=False)
    for k, (_, stage) in enumerate(c.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() == 0


def test_stages_match_brute_force(spark, documents):
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 5000)}"
    bases = [[word() for _ in range(rng.randint(60, 120))] for _ in range(40)]
    rows = []
    for i in range(150):
        text = list(bases[i % 40])
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = word()
        if i % 7 == 0:
            text.insert(3, f"token=abc{i}defghi")
        rows.append((i, " ".join(text) if i % 11 else "12 34 !", "en", "ab"[i % 2]))
    docs = documents(rows, extra=False)
    kept = c.identify_languages(spark, docs, "")
    want = {i: t for i, t, *_ in rows if i % 11}
    assert {r.doc_id: r.text for r in kept.collect()} == want
    single = c.drop_near_duplicates(spark, kept, "")
    classes = all_pairs_classes(want)
    assert {r.doc_id for r in single.collect()} == set(classes.values())
    clean = c.redact_secrets(spark, single, "")
    scan = [r.scanner() for r in secret_scan.RULES]
    for r in clean.collect():
        assert not any(f(r.text) for f in scan) and r.n_chars == len(r.text)
        assert r.text == want[r.doc_id] or "[SECRET]" in r.text
    mixed = c.mix_sources(spark, clean, "").collect()
    sizes = {r.doc_id: len(r.text.split()) for r in clean.collect()}
    taken = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 2 and all(n <= 2 * sizes[k] for k, n in taken.items())


def test_rows_without_ids_and_with_shared_ids(spark, documents):
    """Every class keeps one row, whatever ids its rows have."""
    texts = [" ".join(f"t{i}w{k}" for k in range(30)) for i in range(7)]
    near = texts[0].replace("t0w7", "other")
    rows = [(None, texts[0]), (None, near), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4])]
    rows += [(5, texts[5]), (3, texts[6]), (5, texts[6]), (None, texts[6])]
    docs = documents([(i, t, "en", "a") for i, t in rows], extra=False)
    got = sorted(((r.doc_id, r.text) for r in c.drop_near_duplicates(spark, docs, "").collect()), key=repr)
    one = next(t for i, t in got if t in (texts[0], near))
    assert got == sorted([(None, one), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (5, texts[5]), (3, texts[6])], key=repr)


def shuffles(df):
    return "Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()


def test_near_dedup_leaves_texts_in_place(spark, documents, monkeypatch):
    """Only ids of dropped rows are sent, unless they are too many; the rows are the same."""
    texts = [" ".join(f"t{i // 3}w{k}" for k in range(30 + i % 3)) for i in range(30)]
    docs = documents([(i, t, "en", "a") for i, t in enumerate(texts)], extra=False)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = c.drop_near_duplicates(spark, docs, "")
        assert not shuffles(out) and sorted(r.doc_id for r in out.collect()) == list(range(0, 30, 3))
        monkeypatch.setattr(c, "SENT_IDS", 3)
        out = c.drop_near_duplicates(spark, docs, "")
        assert shuffles(out) and sorted(r.doc_id for r in out.collect()) == list(range(0, 30, 3))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_texts_that_come_twice_are_redacted(spark, documents):
    """Near-dedup leaves none, but the stage is right for them too."""
    texts = ["a token=abcdefgh b", "a token=abcdefgh b", None, "plain", "a token=abcdefgh b"]
    docs = documents([(i, t, "en", "a") for i, t in enumerate(texts)], extra=False)
    got = sorted((r.doc_id, r.text, r.n_chars) for r in c.redact_secrets(spark, docs, "").select("doc_id", F.coalesce("text", F.lit("-")).alias("text"), "n_chars").collect() if r.text != "-")
    assert got == [(i, "a [SECRET] b" if t != "plain" else t, 12 if t != "plain" else len(t)) for i, t in enumerate(texts) if t]


def test_run_is_registered(spark):
    assert __spark_entry__.queries()["pipeline"].__wrapped__ is c.run
    out = c.run(spark, "/root/testdata/sf0.001")
    assert out.where("not round_trip").count() == 0 and out.select(F.min("n_ids")).first()[0] >= 0
