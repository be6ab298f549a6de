import random
import re
from collections import Counter

import cases
import numpy as np
from textquarry.llm import near_dedup
from textquarry.operators import linking
from textquarry.operators.linking import components


def bag(text):
    words = re.findall(r"\w+", (text or "").lower())
    size = min(5, len(words))
    return Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def brute(texts):
    """Class ids over all pairs."""
    bags = [bag(t) for _, t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j]:
                both = sum((bags[i] & bags[j]).values())
                if both / (bags[i].total() + bags[j].total() - both) >= 0.8:
                    parent[root(i)] = root(j)
    classes = {}
    for i, (key, _) in enumerate(texts):
        classes.setdefault(root(i), []).append(key)
    return sorted(((key, min(classes[root(i)])) for i, (key, _) in enumerate(texts)))


def family(source, size, n):
    base = [f"w{source.randrange(5000)}" for _ in range(n)]
    out = []
    for _ in range(size):
        words = list(base)
        for at in source.sample(range(n), source.randrange(0, max(1, n // 60))):
            words[at] = f"new{source.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_families_of_copies(spark):
    source = random.Random(4)
    texts = [t for size, n in ((40, 200), (5, 80), (3, 400), (2, 30)) for t in family(source, size, n)]
    texts += ["one two three"] * 3 + ["one two", "ONE, two!"] + ["la " * 300, "la " * 290, "la " * 100]
    texts += [" ".join(f"u{i}x{j}" for j in range(50)) for i in range(20)]
    source.shuffle(texts)
    rows = list(enumerate(texts))
    found = near_dedup.near_duplicates(cases.plain(spark, rows)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in found) == brute(rows)
    sizes = Counter(r["class_id"] for r in found)
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in found)


def test_signatures_estimate_weighted_similarity():
    source = np.random.default_rng(0)
    keys = source.integers(0, 2**63, 300).astype(np.uint64)
    one, two = source.integers(1, 9, 300), source.integers(1, 9, 300)
    exact = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    agree = []
    for seed in range(60):
        other = near_dedup._mix(keys, seed)
        a, b = near_dedup.signatures([(other, one), (other, two)])
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - exact) < 0.02


def test_awkward_documents(spark):
    found = near_dedup.near_duplicates(cases.awkward(spark)).collect()
    assert len(found) == len(cases.TEXTS)
    of = {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] is not None}
    assert of[5] == of[10] == of[3] == 3 and of[17] == of[18] == 17 and of[9] == 9
    assert of[11] == 11 and of[12] == 12 and of[13] == 13 and of[15] == 15
    assert near_dedup.near_duplicates(cases.empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)]
    random.Random(0).shuffle(edges)
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["comp"] for r in found} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_shared_numbers_of_blocks():
    source = np.random.default_rng(1)

    def side(count):
        bags = [source.choice(3000, source.integers(0, 200), replace=False) ** 2 for _ in range(count)]
        bags = [np.unique(np.concatenate([b, source.integers(-40, 0, 60)])) for b in bags]
        return bags, [np.array([len(b) for b in bags]), np.concatenate(bags)]

    (a, left), (b, right) = side(90), side(70)
    expected = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert (linking.shared_numbers(left, right) == expected).all()


def test_a_large_family_of_unlinked_texts_makes_no_row_for_every_pair(spark, monkeypatch):
    source = random.Random(8)
    base = [f"w{source.randrange(5000)}" for _ in range(150)]
    texts = []
    for number in range(240):
        words = list(base)
        for at in source.sample(range(150), 4 if number % 3 else 1):
            words[at] = f"new{source.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    asked = []
    verified = linking._verified
    monkeypatch.setattr(linking, "_verified", lambda pairs, *more: asked.append(pairs.count()) or verified(pairs, *more))
    for nodes in (2048, 50):
        monkeypatch.setattr(linking, "BLOCK_NODES", nodes)
        asked.clear()
        found = near_dedup.near_duplicates(cases.plain(spark, rows)).collect()
        assert sorted((r["doc_id"], r["class_id"]) for r in found) == brute(rows)
        assert sum(asked) <= 8 * len(rows)
