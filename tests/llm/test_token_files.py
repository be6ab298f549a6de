import functools

import hypothesis.strategies as st
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from tokenizers import Tokenizer

import cases
from textquarry.llm import token_files
from textquarry.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_any_place_is_read_back(ids):
    codes = token_files.Codes(token_files.pack(np.array(ids, dtype=np.uint32)))
    assert codes.all().tolist() == ids
    assert [codes[i] for i in range(0, len(ids), 7)] == ids[::7]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcDEé İß.,'!0 \n\t日", max_size=80))
def test_words_like_the_library(text):
    library = Tokenizer.from_file(PATH)
    found = token_files.word_tokenizer(PATH)(text)
    assert found.tolist() == library.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_found_first():
    library = Tokenizer.from_file(PATH)
    text = "a <|endoftext|>b<|startoftext|> c"
    assert token_files.word_tokenizer(PATH)(text).tolist() == library.encode(
        text, add_special_tokens=False).ids


def test_known_words_are_not_split_again(monkeypatch):
    split = []
    found = token_files.ASCII_PARTS
    monkeypatch.setattr(token_files, "ASCII_PARTS", lambda text: split.append(text) or found(text))
    tokenize = token_files.word_tokenizer(PATH)
    once = tokenize("don't panic, panic, 42!").tolist()
    seen = len(split)
    assert tokenize("Don't PANIC, 42!  panic,").tolist() != once and len(split) == seen


def test_separators_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(token_files, "MOST_WORDS", 3)
    library = Tokenizer.from_file(PATH)
    tokenize = token_files.word_tokenizer(PATH)
    for text in ("a\x1cb !\x1d! é\x1f", "\x85a\u00a0b\u3000c\u2028d", "one two, three's four\x01 日本 five six é7", "one two"):
        assert tokenize(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_are_looked_up_once_for_many_texts(monkeypatch):
    class Counted(token_files._Known):
        def __getitem__(self, word):
            looked_up.append(word)
            return super().__getitem__(word)

    looked_up = []
    monkeypatch.setattr(token_files, "_Known", Counted)
    tokenizer = token_files.word_tokenizer(PATH)
    texts = ["one two one", "", "TWO\u00a0x \x1c One\n", "Stra\u00dfe \u00c9t\u00e9 \u00e9t\u00e9", "\u0130 \u03a3 one",
             "e\u0301 one", "a<|endoftext|>b", " \t", "one two " * 500]
    found = tokenizer.many(texts)
    library = Tokenizer.from_file(PATH)
    assert [ids.tolist() for ids in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    # as a word, as its part and as a part of another word
    assert looked_up.count("two") <= 3 and looked_up.count("one") <= 2


@functools.cache
def fuzzed():
    return Tokenizer.from_file(PATH), token_files.word_tokenizer(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abcDEé İßΣ.,'!0 \n\t\x0b\x0c\x1c\x85\u00a0\u2028日\u0301Ⅷ²\u212aǅ", max_size=40), max_size=8),
       st.integers(1, 60))
def test_groups_like_the_library(texts, characters):
    library, tokenizer = fuzzed()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_files, "GROUP_CHARACTERS", characters)
        groups = list(token_files._groups(texts))
    assert [t for group in groups for t in group] == texts
    assert all(len(group) == 1 or sum(map(len, group)) <= characters for group in groups)
    found = [ids.tolist() for group in groups for ids in tokenizer.many(group)]
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("tokens", [50, 1 << 20])
def test_files_in_document_order(spark, monkeypatch, tokens):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", tokens)
    library = Tokenizer.from_file(PATH)
    path = scratch_path(spark, "files")
    token_files.write_token_files(cases.awkward(spark), path, lambda: token_files.word_tokenizer(PATH), 2)
    found = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: (r["start"], r["n_tokens"]))
    keys = [r["doc_id"] for r in found]
    assert keys == sorted((k for k, _, _ in cases.TEXTS), key=lambda k: (k is not None, k or 0))
    encoded = sorted(((k or 0), library.encode(t or "", add_special_tokens=False).ids + [2])
                     for k, t, _ in cases.TEXTS)
    got = [(r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist()) for r in found]
    assert sorted(got) == encoded
    starts = np.cumsum([0] + [r["n_tokens"] for r in found])[:-1].tolist()
    assert [r["start"] for r in found] == starts
    whole = [t for _, ids in got for t in ids]
    places = [0, 3, len(whole) - 1, len(whole) // 2, len(whole) + 5, -1]
    asked = spark.createDataFrame([(p,) for p in places], "place long")
    assert {r["place"]: r["token"] for r in token_files.tokens_at(spark, path, asked, width=64).collect()} == {
        p: whole[p] for p in places if 0 <= p < len(whole)}


def test_empty_table(spark):
    path = scratch_path(spark, "files")
    token_files.write_token_files(cases.empty(spark), path, lambda: token_files.word_tokenizer(PATH), 2)
    assert token_files.read_documents(spark, path).count() == 0
