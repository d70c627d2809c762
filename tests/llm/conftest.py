import pytest
from pyspark.sql import Row


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text, lang, source) rows, in three parts, with a column whose name clashes."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + ", key string, node string, ids string" * extra
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["x"] * (3 * extra)) for r in rows], schema).repartition(3)

    return make


@pytest.fixture
def odd_documents(documents):
    """Nulls in every column, empty and very long texts, ties, and repeated rows."""
    rows = [
        (1, "", "en", "a"),
        (2, None, None, None),
        (None, "no id here, token = abcdef12", "en", "a"),
        (3, "x" * 300_000, "en", "b"),
        (4, "the same text that two rows have", "en", "a"),
        (5, "the same text that two rows have", None, "b"),
        (6, "a repeated row", "de", None),
        (6, "a repeated row", "de", None),
        (7, "\n \t", "fr", "a"),
        (8, "12345 !!! 😀", "fr", "a"),
        (9, "word " * 30_000, "en", "c"),
    ]
    return documents(rows)


def as_rows(df):
    return sorted((tuple(r) if isinstance(r, Row) else r for r in df.collect()), key=repr)
