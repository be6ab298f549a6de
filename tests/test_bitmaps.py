from __future__ import annotations

import random

import pytest

from textquarry.operators import bitmaps, coverage
from textquarry.plans import tables

EDGE = bitmaps.BUCKET


def ids_frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "query_id long").repartition(4)


def runs_of(ids):
    found = []
    for i in sorted(ids):
        if found and found[-1][1] == i - 1:
            found[-1][1] = i
        else:
            found.append([i, i])
    return sorted(map(tuple, found))


def pairs(frame):
    return sorted((r["start_id"], r["end_id"]) for r in frame.collect())


def cases():
    source = random.Random(2)
    scattered = {source.randrange(5 * EDGE) for _ in range(900)}
    across = set(range(EDGE - 3, 3 * EDGE + 2)) | {4 * EDGE - 1, 4 * EDGE, 5 * EDGE}
    return {
        "scattered": (scattered, 0, 5 * EDGE),
        "across edges": (across, 1, 6 * EDGE),
        "whole buckets": (set(range(EDGE, 2 * EDGE)), 10, 4 * EDGE - 1),
        "negative": ({-EDGE - 1, -EDGE, -1, 0, 1}, -2 * EDGE, 5),
        "single ids at edges": ({0, EDGE - 1, 2 * EDGE - 1, 2 * EDGE, 3 * EDGE}, 0, 3 * EDGE),
        "outside the range": ({3, 900_000}, 5, 70_000),
        "none": (set(), 7, 40_000),
    }


@pytest.mark.parametrize("name", cases())
def test_runs_and_missing_ids(spark, name):
    ids, start, end = cases()[name]
    frame = ids_frame(spark, list(ids) * 2 + [None])
    found = bitmaps.id_bitmaps(frame)
    assert bitmaps.count_ids(found).first()["ids"] == len(ids)
    assert pairs(bitmaps.set_runs(found)) == runs_of(ids)
    missing = [i for i in range(start, end + 1) if i not in ids]
    listed = [r["query_id"] for r in bitmaps.unset_ids(found, start, end).collect()]
    assert listed == missing
    assert pairs(bitmaps.unset_runs(found, start, end)) == runs_of(missing)


def test_wide_range_makes_no_empty_bitmaps(spark):
    found = bitmaps.id_bitmaps(ids_frame(spark, [5, 10**14]))
    assert pairs(bitmaps.unset_runs(found, 1, 2 * 10**14)) == [(1, 4), (6, 10**14 - 1), (10**14 + 1, 2 * 10**14)]


def test_stored_sets_grow_by_merging(spark, tmp_path):
    source = random.Random(3)
    batches = [[source.randrange(100_000) for _ in range(500)] for _ in range(3)]
    bitmaps.write_bitmaps(bitmaps.id_bitmaps(ids_frame(spark, batches[0])), str(tmp_path / "0"))
    for n, batch in enumerate(batches[1:]):
        stored = bitmaps.read_bitmaps(spark, str(tmp_path / str(n)))
        merged = bitmaps.merge_bitmaps(stored.unionByName(bitmaps.id_bitmaps(ids_frame(spark, batch))))
        bitmaps.write_bitmaps(merged, str(tmp_path / str(n + 1)))
    whole = {i for batch in batches for i in batch}
    assert pairs(bitmaps.set_runs(bitmaps.read_bitmaps(spark, str(tmp_path / "2")))) == runs_of(whole)


def test_shuffle_carries_bitmaps(spark, sf_dir):
    ids = tables.line_ids(spark, sf_dir)
    plan = bitmaps.id_bitmaps(ids)._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning(bucket")
    assert "partial_bitmap_construct_agg" in plan[exchange:] and "query_id" not in plan[:exchange]


def test_coverage_reads_bitmaps(spark, sf_dir):
    saved = coverage.saved_ids(tables.line_ids(spark, sf_dir))
    ids = {r["query_id"] for r in saved.collect()}
    start, end = min(ids), max(ids) + 10
    missing = [i for i in range(start, end + 1) if i not in ids]
    assert [r["query_id"] for r in coverage.missing_ids(saved, start, end).collect()] == missing
    assert pairs(coverage.missing_ranges(saved, start, end)) == runs_of(missing)
    assert pairs(coverage.group_consecutive(saved)) == runs_of(ids)
