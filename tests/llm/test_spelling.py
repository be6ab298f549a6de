import random
import re
import zlib
from collections import Counter

import cases
import hypothesis.strategies as st
import pytest
from hypothesis import given, settings
from textquarry.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced symbol apart, straight from the definition."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for word, n in counts.items():
        others = sorted((-m, other) for other, m in counts.items() if near(word, other))
        fits = bool(others) and -others[0][0] >= spelling.RATIO * n
        out[word] = (others[0][1] if fits else None, n, len(others), -others[0][0] if fits else None)

    def root(word):
        return root(out[word][0]) if out[word][0] else word

    return {(w, form, root(w), n, count, form_n) for w, (form, n, count, form_n) in out.items()}


def rows(frame):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="abé", max_size=6), max_size=60))
def test_composition_accepts_each_near_pair_once(words):
    acceptor = spelling.Acceptor(sorted(words))
    found = [frozenset(p) for p in acceptor.pairs(0)]
    assert len(found) == len(set(found))
    assert set(found) == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_acceptor_is_minimal():
    acceptor = spelling.Acceptor(sorted(a + b + "ing" for a in "bcdf" for b in "ao"))
    assert len({id(e) for e in acceptor._register.values()}) <= 6
    assert sorted(acceptor.endings(0, 0)) == sorted(a + b + "ing" for a in "bcdf" for b in "ao")


@pytest.mark.parametrize("part_words", [3, 20, 10_000])
def test_parts_change_nothing(spark, part_words):
    source = random.Random(4)
    counts = {}
    for _ in range(260):
        word = "".join(source.choice("abcß") for _ in range(source.randrange(2, 6)))
        counts[source.choice(["", "pre", "preß"]) + word] = source.choice([3, 3, 4, 9, 20, 100])
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows(spelling.variants(words, part_words=part_words)) == brute(counts)
    if part_words == 3:
        dealt = spelling.parts(words, part_words)
        assert dealt.groupBy("part").count().agg({"count": "max"}).first()[0] < 60


def counted(texts):
    found = Counter()
    for key, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.UPPER.lower()))
            drawn = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if drawn % spelling.SLIP == 0:
                run = run[:drawn % len(run)] + run[drawn % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= spelling.LEAST_LENGTH and n >= spelling.LEAST_COUNT}


def test_slips_in_texts(spark):
    source = random.Random(8)
    names = ["Straßen", "élèves", "Across", "quality", "quantity", "ÀÉÎabc", "lengthy", "length", "x×y÷z"]
    texts = [(i if i % 7 else None, " ".join(source.choice(names) for _ in range(60)) + "7abcde") for i in range(120)]
    assert rows(spelling.spelling_variants(cases.plain(spark, texts))) == brute(counted(texts))


def test_awkward_documents(spark):
    texts = [(k, t) for k, t, _ in cases.TEXTS] * 3 + [(20, "long" * 6000 + " " + "long" * 6000 + "x")] * 3
    docs = cases.awkward(spark, [(k, t, None) for k, t in texts]).withColumnRenamed("node", "n")
    assert rows(spelling.spelling_variants(docs)) == brute(counted(texts))


def test_no_words(spark):
    assert spelling.spelling_variants(cases.empty(spark)).count() == 0
    assert spelling.spelling_variants(cases.plain(spark, [(1, None), (2, "12"), (3, "abcde")])).count() == 0
