import hashlib
import re
from collections import defaultdict

import cases
from textquarry.llm import exact_dedup


def brute(texts):
    groups = defaultdict(list)
    for key, text in texts:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()].append(key)
    return groups


def check(spark, texts, docs, support):
    found = exact_dedup.exact_duplicates(docs, support=support).collect()
    groups = brute(texts)
    assert len(found) == len(texts)
    for row in found:
        ids = groups[row["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert row["doc_id"] in ids and row["group_size"] == len(ids)
        assert row["keep_id"] == (min(known) if known else None)
        if row["kept"]:
            assert row["doc_id"] == row["keep_id"]
    assert sum(row["kept"] for row in found) == len(groups)


def test_awkward_documents(spark):
    check(spark, [(k, t) for k, t, _ in cases.TEXTS], cases.awkward(spark), 0.001)


def test_mass_copies_go_the_heavy_way(spark):
    texts = [(i, "copy" if i % 3 else f"text {i // 6}") for i in range(600)]
    docs = cases.plain(spark, texts).repartition(7)
    heavy = exact_dedup.heavy_hitters(exact_dedup.digests(docs), 0.2).collect()
    assert [row["group_size"] for row in heavy] == [400]
    check(spark, texts, docs, 0.2)


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(cases.empty(spark)).count() == 0
    assert exact_dedup.deduplicate(cases.empty(spark)).columns == cases.empty(spark).columns


def test_deduplicate_keeps_columns_and_documents_without_id(spark):
    texts = [(1, "a", "en"), (2, "a ", "en"), (3, "a  ", "en"), (None, "a", "en"), (4, "b", "en")]
    docs = cases.awkward(spark, texts)
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [
        (0, "a"), (1, "a"), (2, "a "), (4, "b")]
