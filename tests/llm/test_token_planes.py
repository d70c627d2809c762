import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parcela.llm import token_planes as t
from parcela.llm.queries import WORDS

VOCABULARY = public_tokenizers.path(WORDS)
ODD = ["", " ", "ΑΣ. ΟΔΟΣ, İstanbul İ. don't CAN'T it's. x\x1cy <|endoftext|> a<|endoftext|>b 12,5 ﬁn. ǅ ẞ. 日本語。 한국어. ́abc naïve's", "a b c​d᠎e\u0085f", "...,,,!!! a. b, c; d: e! f?"]


class Sink(io.BytesIO):
    def close(self):
        self.whole = self.getvalue()
        super().close()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=12), st.sampled_from([1, 8]), st.integers(1, 33))
def test_files_come_back(pieces, bits, block):
    sink = Sink()
    writer = t.PlaneWriter(sink, block, bits)
    for p in pieces:
        writer.add(np.array(p, "<u4"))
    writer.close()
    reader = t.PlaneReader(io.BytesIO(sink.whole), len(sink.whole))
    first = 0
    for p in pieces:
        assert [int(x) for part in reader.ids(first, len(p)) for x in part] == p
        first += len(p)


def test_a_cut_file_is_an_error():
    sink = Sink()
    writer = t.PlaneWriter(sink)
    writer.add(np.arange(100, dtype="<u4"))
    writer.close()
    with pytest.raises(Exception):
        t.PlaneReader(io.BytesIO(sink.whole[:-3]), len(sink.whole) - 3)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_words_equal_whole_texts(texts):
    encoder, library = t.encoder(VOCABULARY), library_of()
    assert encoder.encode(texts) == [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def library_of(kept={}):  # noqa: B006
    return kept.setdefault("it", Tokenizer.from_file(VOCABULARY))


def test_odd_words():
    assert t.encoder(VOCABULARY).encode(ODD) == [np.array(library_of().encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in ODD]


def expected(rows):
    out, start = [], 0
    for key, text in rows:
        ids = [*library_of().encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("layout", [{}, {"block_ids": 7, "plane_bits": 1, "file_ids": 50}])
def test_documents_come_back(documents, layout):
    rng = random.Random(4)
    rows = [(i * 7 - 100, " ".join(rng.choice(["alpha", "Beta,", "x", "ñandú"]) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    got = t.stored(documents([(k, x, "en", "a") for k, x in rows]), VOCABULARY, **layout).collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_odd_rows(documents, odd_documents):
    got = sorted((tuple(r) for r in t.stored(odd_documents, VOCABULARY).collect()), key=lambda r: r[1])
    assert len(got) == 11 and got[0][0] is None and [r[0] for r in got[1:]] == [1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False)) and got[2][2] == 1
    assert t.stored(documents([]), VOCABULARY).collect() == []
