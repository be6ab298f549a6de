import zlib
from collections import defaultdict

import cases
import pytest
from textquarry.llm import kd_shards
from textquarry.llm.common import documents


def check(found, texts, shards):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted(
        (k is None, k or 0) for k, _ in texts)
    slots, sizes = defaultdict(list), defaultdict(int)
    for row in found:
        slots[row["shard"]].append(row["slot"])
        sizes[row["shard"]] += row["size"]
    assert set(sizes) <= set(range(shards))
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    assert sorted((r["size"], r["text_crc32"]) for r in found) == sorted(
        (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in texts)
    return sizes


@pytest.mark.parametrize("shards", [1, 5])
def test_awkward_documents(spark, shards):
    texts = [(k, t) for k, t, _ in cases.TEXTS]
    check(kd_shards.kd_shards(cases.awkward(spark), shards).collect(), texts, shards)


def test_hot_source_and_equal_lengths_split_evenly(spark):
    texts = [(i, "same length") for i in range(997)]
    sizes = check(kd_shards.kd_shards(cases.plain(spark, texts), 7).collect(), texts, 7)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 3 * 19


def test_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sizes = check(kd_shards.kd_shards(docs, 6).collect(), texts, 6)
    largest = max(len((t or "").encode()) for _, t in texts) + 8
    mean = sum(sizes.values()) / 6
    assert all(abs(s - mean) <= 2 * largest for s in sizes.values())


def test_empty_table(spark):
    assert kd_shards.kd_shards(cases.empty(spark), 24).count() == 0
