import hypothesis.strategies as st
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings

import cases
from textquarry.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH),
                             special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(PATH, PATTERN)


def ids(packed):
    return list(memoryview(bytes(packed)).cast("I"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abdehinorstu ETI\n\t0'!.é日𝕏", max_size=200))
def test_any_text_like_the_library(library, encoder, text):
    assert ids(encoder.encode(text)) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, "thetion" * 2000, "日" * 3000, "ab c\td  e", " ", "\n\n x"])
def test_long_pieces_and_spaces(library, encoder, text):
    assert ids(encoder.encode(text)) == library.encode_ordinary(text)


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_STATES", 20)
    monkeypatch.setattr(byte_bpe, "MOST_PIECES", 5)
    small = byte_bpe.Encoder(PATH, PATTERN)
    for text in (cases.LONG[:3000], "nevertheless" * 300):
        assert ids(small.encode(text)) == library.encode_ordinary(text)


@pytest.mark.parametrize("cuts", [1, 2, 3, 7])
def test_stream_decoding(cuts):
    data = "aé日𝕏".encode() * 5 + b"\xff\xe2\x28\xed\xa0\x80\xf0\x9f"
    stream = byte_bpe.Utf8Stream()
    parts = [stream.feed(data[i:i + cuts]) for i in range(0, len(data), cuts)]
    assert "".join(parts) + stream.close() == data.decode("utf-8", "replace")


def test_documents(spark, library):
    found = byte_bpe.roundtrip(cases.awkward(spark), PATH, PATTERN).collect()
    expected = sorted(((k or 0), library.encode_ordinary(t or ""), t or "") for k, t, _ in cases.TEXTS)
    assert sorted(((r["doc_id"] or 0), ids(r["ids"]), r["decoded"]) for r in found) == expected
    assert byte_bpe.roundtrip(cases.empty(spark), PATH, PATTERN).count() == 0
