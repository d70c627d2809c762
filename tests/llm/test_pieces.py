import itertools
from array import array

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from parcela.llm import pieces as p
from parcela.llm.queries import PIECES

MODEL = public_tokenizers.path(PIECES)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


ODD = ["", " ", "  ", "a", " a", "\n", "\n\nx ", "Hello  world\n\tfoo é 𝒳 ", "▁x▁ ▁", "日本語のテキスト。" * 60, "x" * 3000, "aaa\x00b", "    code(  )\n", "1234567890" * 90, "🤦🏼‍♂️ ok", "<s> </s> <0x41>"]


@pytest.mark.parametrize("text", ODD)
def test_same_as_library(library, text):
    ids = list(array("i", p.loaded(MODEL).encode(text)))
    assert ids == library.encode(text) and p.loaded(MODEL).decode(ids) == library.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("etaoin shrdlu.,\n'ABé"), st.characters(codec="utf-8")), max_size=300))
def test_any_text(text):
    ids = list(array("i", p.loaded(MODEL).encode(text)))
    assert ids == sentencepiece_of().encode(text)
    if p.SPACE not in text:
        assert p.loaded(MODEL).decode(ids) == text


def sentencepiece_of(kept={}):  # noqa: B006
    return kept.setdefault("it", sentencepiece.SentencePieceProcessor(model_file=MODEL))


def model_of(vocabulary, kind=p.UNIGRAM, prefix=False):
    """A model file's bytes with these pieces and scores."""
    import struct

    field = lambda n, data: bytes((n << 3 | 2, len(data))) + data
    piece = lambda text, score, k: field(1, field(1, text.encode()) + bytes((2 << 3 | 5,)) + struct.pack("<f", score) + bytes((3 << 3, k)))
    body = piece("<unk>", 0.0, p.UNKNOWN) + b"".join(piece(t, s, 1) for t, s in vocabulary.items())
    return body + field(2, bytes((3 << 3, kind))) + field(3, bytes((3 << 3, int(prefix), 4 << 3, 0)))


VOCABULARY = {"a": -1.0, "b": -1.25, "ab": -1.5, "ba": -2.0, "aab": -2.125, "bb": -3.0, "▁": -1.0, "▁a": -1.75}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ", max_size=9), st.sampled_from([1, 2, 3, 256]))
def test_unigram_is_the_best_segmentation(text, stride):
    model, before = p.Pieces(model_of(VOCABULARY)), p.STRIDE
    p.STRIDE = stride
    try:
        got = [x for path in model.segments(text.replace(" ", p.SPACE)) for x in path]
    finally:
        p.STRIDE = before
    marked = text.replace(" ", p.SPACE)
    assert "".join(got) == marked
    best = max((sum(VOCABULARY[x] for x in cut) for cut in cuts(marked) if all(x in VOCABULARY for x in cut)), default=0.0)
    assert sum(VOCABULARY[x] for x in got) == best


def cuts(text):
    for marks in itertools.product((0, 1), repeat=max(0, len(text) - 1)):
        at = [0, *[i + 1 for i, m in enumerate(marks) if m], len(text)]
        yield [text[a:b] for a, b in zip(at, at[1:], strict=False)] if text else []


@pytest.mark.parametrize("stride", [1, 7, 64])
def test_committing_early_changes_nothing(library, stride):
    before, p.STRIDE = p.STRIDE, stride
    try:
        text = "▁" + "internationalisationstotheunexpectedlyhomogeneous" * 20
        held = []
        model = p.Pieces(open(MODEL, "rb").read())
        for path in model.segments(text):
            held.append(len(path))
        assert max(held) <= 3 * stride + 40
        assert list(array("i", model.segment_ids(text))) == library.encode(text[1:])
    finally:
        p.STRIDE = before


def test_unknown_runs_and_unsupported_models():
    model = p.Pieces(model_of(VOCABULARY))
    assert list(array("i", model.encode("axxb"))) == [1, 0, 2]
    with pytest.raises(ValueError):
        p.Pieces(model_of(VOCABULARY, kind=3))


def test_odd_rows(documents, odd_documents):
    got = p.encoded(odd_documents, MODEL).collect()
    assert len(got) == 11 and all(r.round_trip and r.n_ids == len(r.ids) for r in got)
    back = p.decoded(p.encoded(odd_documents, MODEL, keep=("doc_id", "text")).withColumnRenamed("text", "was"), MODEL, keep=("was",)).collect()
    assert all(r.text == (r.was or "") for r in back)
    assert p.encoded(documents([]), MODEL).collect() == []
