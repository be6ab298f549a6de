import random
import re

import cases
import pytest
from textquarry.llm import decontaminate

UPPER = str.maketrans(decontaminate.UPPER, decontaminate.UPPER.lower())


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(texts, items, width):
    windows = {}
    for item, text in items:
        own = words(text)
        for s in range(max(1, len(own) - width + 1) if own else 0):
            windows.setdefault(tuple(own[s:s + width]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for key, text in texts:
        own, hit, found = words(text), set(), set()
        for size in sizes:
            for s in range(len(own) - size + 1):
                if tuple(own[s:s + size]) in windows:
                    hit |= set(range(s, s + size))
                    found |= windows[tuple(own[s:s + size])]
        out.append((key, len(own), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=str)


def check(spark, docs, texts, items, width):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, benchmark, width).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in found), key=str) == \
        brute(texts, items, width)
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["item_ids"]) for r in found)


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabet_with_many_repeats(spark, seed):
    source = random.Random(seed)

    def text(n):
        return " ".join(source.choice(["a", "B", "cé", "É", "d1"]) for _ in range(n))

    items = [(i, text(source.choice([0, 1, 3, 6]))) for i in range(6)] + [(2, text(5)), (None, text(4)), (7, None)]
    texts = [(i, text(source.randrange(40))) for i in range(60)] + [(3, text(20)), (None, text(20)), (9, None)]
    check(spark, cases.plain(spark, texts), texts, items, 4)


def test_awkward_documents(spark):
    texts = [(k, t) for k, t, _ in cases.TEXTS]
    items = [(1, "the QUICK brown fox jumps over the lazy dog near"), (2, "faulen Hund am ufer"), (3, "日本語 x")]
    check(spark, cases.awkward(spark), texts, items, 10)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(cases.empty(spark), none).count() == 0
    found = decontaminate.contamination(cases.awkward(spark), none).collect()
    assert len(found) == len(cases.TEXTS) and not any(r["contaminated"] for r in found)


def test_proximity(spark):
    docs = cases.plain(spark, [(1, "rare x x odd"), (2, "odd x x x x rare"), (3, "rare only"), (4, "x x common")])
    tests = decontaminate.read_tests(spark.createDataFrame([(1, "common rare odd")], "item_id long, text string"))
    index = decontaminate.build_index(docs, tests.vocabulary)
    ids = {r["row"]: r["doc_id"] for r in index.where("term < 0").collect()}
    # 'common' is the rarest, then 'odd' and 'rare' with two documents each
    near = {ids[r["row"]] for r in decontaminate.proximity(index, tests, 3).collect()}
    assert near <= {1, 4}


def brute_near(texts, items, within, share):
    found = {}
    for row, text in texts:
        own = words(text)
        for item, wanted in items:
            terms = set(words(wanted))
            for first in range(len(own)):
                for last in range(first, min(len(own), first + within + 1)):
                    if terms and len(terms & set(own[first:last + 1])) >= max(1, share * len(terms) - 1e-9):
                        key = row, item
                        found[key] = min(last - first, found.get(key, last - first))
    return found


@pytest.mark.parametrize("within,share", [(3, 2 / 3), (6, 1.0), (5, 0.5), (2, 0.1)])
def test_proximity_against_brute_force(spark, within, share):
    source = random.Random(within)

    def text(n):
        return " ".join(source.choice("abcdefgh") + source.choice(["", "", "x"]) for _ in range(n))

    items = [(i, text(i % 7)) for i in range(14)] + [(20, "rare"), (21, "common rare odd"), (22, "nowhere a b")]
    texts = [(i, text(source.randrange(30))) for i in range(40)] + [
        (50, "rare x x odd"), (51, "odd x x x x rare"), (52, "rare only"), (53, "x x common")]
    tests = decontaminate.read_tests(spark.createDataFrame(items, "item_id long, text string"))
    index = decontaminate.build_index(cases.plain(spark, texts), tests.vocabulary)
    ids = {r["row"]: r["doc_id"] for r in index.where("term < 0").collect()}
    names = {r["item"]: r["item_id"] for r in tests.items.select("item", "item_id").distinct().collect()}
    near = {(ids[r["row"]], names[r["item"]]): r["distance"]
            for r in decontaminate.proximity(index, tests, within, share).collect()}
    assert near == brute_near(texts, items, within, share)
    assert (50, 21) in near or (within, share) != (3, 2 / 3)
