from __future__ import annotations

import random

import __spark_entry__ as entry_point
from comparing import connect, differences
from textquarry.operators import tags


def test_pruned_pairs_equal_all_pairs(spark):
    source = random.Random(5)
    common = [f"c{i}" for i in range(8)]
    rows = [(i, source.sample(common, 3) + [f"r{source.randrange(2000)}" for _ in range(12)]) for i in range(400)]
    rows += [(400, None), (401, []), (402, ["c1"]), (402, ["c1", "c1", None])]
    corpus = spark.createDataFrame(rows, "query_id long, tags array<string>")
    for top_n in (0, 1, 10, 28, 60):  # 28 pairs of common tags; beyond them only ties of rare ones
        expected = [tuple(r) for r in tags.tag_cooccurrence(corpus, top_n).collect()]
        assert [tuple(r) for r in tags.frequent_pairs(corpus, top_n, (8, 20)).collect()] == expected
    made, all_pairs = (f.agg({"*": "count"}).first()[0] for f in (
        tags.head_pairs(corpus, common), tags.tag_pair_counts(corpus)))
    assert made < all_pairs / 20
    assert tags.frequent_pairs(corpus.limit(0)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    connection = connect(sf_dir)
    for name in ("frequent_pairs", "tag_cooccurrence"):
        assert differences(entry_point.queries()[name](spark, sf_dir), connection, entry_point.oracle_sql()[name]) == []
