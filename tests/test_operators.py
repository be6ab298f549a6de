from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textquarry.operators import coverage, duplicates, ledger, profiles, tags
from textquarry.operators.ordering import with_next_id, with_rank

CORPUS = ("query_id long, name string, description string, tags array<string>, owner string, "
          "query_sql string")


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "query_id long")


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def tagged(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "query_id long, tags array<string>")


def test_neighbours_and_ranks_over_uneven_ids(spark):
    values = sorted({1, 5, 6, 2**62} | set(range(10**6, 10**6 + 300)) | {-7})
    frame = ids(spark, values + [5] * 500)
    assert rows(with_next_id(frame)) == list(zip(values, values[1:])) + [(values[-1], None)]
    assert rows(with_rank(frame, buckets=7)) == [(v, i + 1) for i, v in enumerate(values)]


def test_missing_ranges(spark):
    saved = ids(spark, [1, 2, 4, 9, 50])
    assert rows(coverage.missing_ids(saved, 1, 9)) == [(3,), (5,), (6,), (7,), (8,)]
    assert rows(coverage.missing_ranges(saved, 1, 9)) == [(3, 3), (5, 8)]
    assert rows(coverage.missing_ranges(saved, 3, 11)) == [(3, 3), (5, 8), (10, 11)]
    assert rows(coverage.missing_ranges(ids(spark, []), 1, 4)) == [(1, 4)]
    assert rows(coverage.missing_ranges(ids(spark, [1, 2]), 1, 2)) == []
    assert rows(coverage.group_consecutive(ids(spark, [3, 4, 4, 5, 9]))) == [(3, 5), (9, 9)]
    assert rows(coverage.largest_ranges(coverage.missing_ranges(saved, 1, 9), 1)) == [(4, 5, 8)]


def test_gap_statistics(spark):
    row = coverage.gap_statistics(ids(spark, [1, 2, 4, 9]), 10).first().asDict()
    assert (row["median_gap"], row["average_gap"], row["max_gap"]) == (2.0, 8 / 3, 5)
    assert (row["gaps_over_1"], row["gaps_over_10"], row["coverage_percentage"]) == (2, 0, 40.0)
    one = coverage.gap_statistics(ids(spark, [7]), 10).first().asDict()
    assert one["total_ids"] == 1 and one["average_gap"] is None and one["gaps_over_1"] is None
    assert coverage.gap_statistics(ids(spark, []), 10).count() == 0


def test_coverage_may_exceed_the_range(spark):
    row = coverage.coverage_summary(ids(spark, [1, 2, 8, 9]), 1, 2).first()
    assert tuple(row) == (2, 4, 0, 200.0)


def test_histogram_of_equal_gaps(spark):
    found = coverage.gap_histogram(ids(spark, [0, 3, 6]), bins=4).orderBy("bin").collect()
    assert [(r["lower"], r["frequency"]) for r in found] == [(2.5, 0), (2.75, 0), (3.0, 2), (3.25, 0)]


def test_plans_cover_the_ranges(spark):
    plan = rows(coverage.batch_plan(spark, 1, 1001, 500))
    assert plan == [(1, 500, "1-500.parquet"), (501, 1000, "501-1000.parquet"),
                    (1001, 1001, "1001-1001.parquet")]
    ranges = spark.createDataFrame([(5, 5), (10, 6009)], "start_id long, end_id long")
    batches = rows(coverage.retry_plan(ranges, 2).select("batch_start", "batch_end"))
    assert len(batches) == 3001 and batches[0] == (5, 5) and batches[-1] == (6008, 6009)
    assert tuple(coverage.retry_totals(ranges).first()) == (2, 6001)


def test_tags(spark):
    frame = tagged(spark, [[" A", "a", ""], [], None, ["b", "a", "b"]])
    counts = [tuple(r) for r in tags.tag_counts(frame).collect()]
    assert counts == [("a", 3), ("b", 2)]
    stats = tags.tag_statistics(frame).first().asDict()
    assert stats == {"total_queries": 4, "unique_tags": 2, "total_tag_assignments": 6,
                     "queries_with_tags": 2, "queries_without_tags": 2, "avg_tags_per_query": 1.5,
                     "min_tags_per_query": 0, "max_tags_per_query": 3, "percentage_with_tags": 50.0}
    empty = tags.tag_statistics(frame.where("false")).first()
    assert set(empty.asDict().values()) == {0}


def test_tag_pairs_tie_goes_to_the_first_seen(spark):
    frame = tagged(spark, [["z", "y"], ["b", "a", "b"], ["a", "b", ""]])
    pairs = [tuple(r) for r in tags.tag_cooccurrence(frame, 3).collect()]
    assert pairs == [("a", "b", 2), ("y", "z", 1), ("", "a", 1)]


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame([
        (5, "e", "", ["t"], "o1", "SELECT 1 -- x"), (1, "a", "", ["t"], "o2", "select  1"),
        (2, "b", "", [], None, "select 1"), (3, "c", "", [], "o1", None), (4, "d", "", [], "o3", ""),
        (6, "f", "", [], "o1", "select 'q'"), (7, "g", "", [], "o1", "select 'r'"),
        (8, "h", "", [], "o1", "select 2")], CORPUS)


def test_duplicates(spark, corpus):
    found = duplicates.find_duplicates(corpus)
    assert {r["query_id"] for r in found.collect()} == {1, 2, 3, 4, 5}
    hashed = duplicates.hashed(corpus)
    groups = {r["count"]: r for r in duplicates.duplicate_groups(hashed).collect()}
    assert groups[3]["sample_names"] == ["a", "b", "e"] and groups[3]["n_owners"] == 2
    assert groups[2]["sample_names"] == ["c", "d"]
    top = duplicates.top_duplicate_groups(hashed, 1).first()
    assert (top["count"], top["sample_owners"]) == (3, ["o1", "o2"])
    assert tuple(duplicates.duplicate_summary(hashed).first()) == (8, 5, 62.5, 2)
    assert duplicates.find_duplicates(corpus.where("query_id > 5")).columns[-2:] == [
        "normalized_text", "hash"]


@pytest.mark.parametrize("mode, kept", [
    ("exact", {1, 3, 6, 7, 8}), ("hash", {1, 3, 6, 7, 8}), ("structure", {1, 3, 6, 8})])
def test_remove_duplicates(corpus, mode, kept):
    left = duplicates.remove_duplicates(corpus.unionByName(corpus), mode)
    assert sorted(r["query_id"] for r in left.collect()) == sorted(kept)
    assert left.columns == corpus.columns


def test_remove_duplicates_mode(corpus):
    with pytest.raises(ValueError):
        duplicates.remove_duplicates(corpus, "near")


def test_ledger(spark):
    log = spark.createDataFrame([
        (1, 0, 200), (2, 0, 503), (2, 1, None), (2, 2, 200), (2, 3, 200), (3, 0, 404),
        (4, 0, 500), (4, 1, 500), (4, 2, 500), (4, 3, 500), (5, 0, 418), (6, 0, 429)],
        "query_id long, attempt int, status int")
    outcomes = rows(ledger.attempt_outcomes(log).where("query_id = 2").select("attempt", "outcome"))
    assert outcomes == [(0, "retry"), (1, "retry"), (2, "success")]
    assert rows(ledger.id_outcomes(log)) == [
        (1, "success", 1), (2, "success", 3), (3, "not_found", 1), (4, "failed", 4),
        (5, "failed", 1)]
    assert tuple(ledger.fetch_ledger(log, base_processed=5).first()) == (10, 2, 3, 2, 3, 10, 1.0)


def test_keywords(spark):
    frame = spark.createDataFrame([
        (1, "the and", 0), (2, "  ", 1), (3, None, 1), (4, "zeta beta beta a1", 2),
        (5, "zeta alpha", 2), (6, "noise words", -1)],
        "query_id long, query_sql string, cluster int")
    found = {r["cluster"]: r["keywords"]
             for r in profiles.cluster_keywords(frame, "sql", top_n=3).collect()}
    assert found == {0: [], 2: ["a1", "beta", "zeta"]}


def test_profile_keeps_empty_and_repeated_tags(spark):
    frame = spark.createDataFrame([
        (2, "bb", ["x", "x", ""]), (1, "a", [""]), (3, "ccc", ["y"])],
        "query_id long, name string, tags array<string>").withColumn("cluster", F.lit(-1))
    row = profiles.cluster_profile(frame).first()
    assert tuple(row) == (-1, 3, ["", "x", "y"], ["a", "bb", "ccc"], 2.0)
    assert profiles.cluster_summary(profiles.cluster_profile(frame)).first()["top_tags"] == ", x, y"


def test_repeated_texts_are_neither_shuffled_nor_hashed_twice(spark):
    from textquarry.operators import duplicates

    rows = [(i, f"n{i % 40}", None, ["t"], f"o{i % 3}", "") for i in range(60)]
    hashed = duplicates.hashed(spark.createDataFrame(
        rows, "query_id long, name string, description string, tags array<string>, owner string, query_sql string"), "semantic")
    found, owners = duplicates.duplicates_of(hashed), duplicates.group_owners(hashed)
    plans = [frame._jdf.queryExecution().executedPlan().toString() for frame in (found, owners)]
    assert "SortMergeJoin" not in plans[0] and "Exchange hashpartitioning" not in plans[0]
    assert "sha1" not in plans[1]
    assert {r["query_id"] for r in found.collect()} == {*range(20), *range(40, 60)}
    assert owners.count() == 40


def test_every_run_of_spaces_becomes_one_blank(spark):
    from textquarry.functions import text

    spaces = "\t\n\x0b\x0c\r \x1c\x1f\x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    kept = "!~\x7f\x80\x84\x86\x9f\xa1\u167f\u1681\u1fff\u200b\u2027\u2060\u2fff\u3001\uffff\U0001f600\x00\x1b"
    rows = [f"a{x}b{x}{y}c {x}d{x} {y}e f" for x in spaces for y in spaces] + [f"a{x} {x}  {x}b" for x in kept]
    frame = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in frame.select(text.collapse_spaces(F.col("t"))).collect()]
    assert got == ["a b c d e f"] * len(spaces) ** 2 + [f"a{x} {x} {x}b" for x in kept]


def test_a_text_is_split_once_for_its_shingles(spark):
    from textquarry.operators.near import shingles

    frame = spark.createDataFrame([("a b c d e f",), ("a b",), ("",)], "t string").select(shingles(F.col("t")).alias("s"))
    # an array and its size, not once more for each shingle
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    expected = spark.sql("SELECT array(xxhash64('a b c d e'), xxhash64('b c d e f')), array(xxhash64('a b'))").first()
    assert [r["s"] for r in frame.collect()] == [*expected, []]
