"""Shape of the physical plans: what is read, what is shuffled, what is never done."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_point
from textquarry.operators import coverage, duplicates, ledger, profiles
from textquarry.plans import tables

QUERIES = entry_point.queries()
LAZY = sorted(set(QUERIES) - {"density_clusters", "cluster_corpus", "kmeans_labels", "place_points", "score_corpus"})


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_in_any_query(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_id_queries_read_the_id_column_only(spark, sf_dir):
    plan = plan_of(coverage.saved_ids(tables.line_ids(spark, sf_dir)))
    assert re.findall(r"ReadSchema: (.*)", plan) == ["struct<l_orderkey:bigint>"]


def test_resume_filter_reaches_the_scan(spark, sf_dir):
    plan = plan_of(ledger.incremental_rows(tables.corpus(spark, sf_dir), 10))
    assert "GreaterThan(doc_id,10)" in plan


def test_first_n_per_group_is_cut_before_the_shuffle(spark, sf_dir):
    for frame in (profiles.cluster_sample_names(tables.clustered(spark, sf_dir)),
                  profiles.cluster_top_tags(tables.clustered(spark, sf_dir)),
                  duplicates.duplicate_groups(duplicates.hashed(tables.corpus(spark, sf_dir)))):
        assert "WindowGroupLimit" in plan_of(frame)


def test_duplicate_count_shuffles_hashes_only(spark, sf_dir):
    plan = plan_of(duplicates.duplicate_summary(duplicates.hashed(tables.corpus(spark, sf_dir))))
    exchanges = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning", plan)
    assert exchanges and all(re.fullmatch(r"hash#\d+, count#\d+L?", e) for e in exchanges)


@pytest.mark.parametrize("name", ["id_gaps", "coverage_timeline", "missing_ranges"])
def test_only_the_bucket_table_meets_in_one_task(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    singles = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: SinglePartition", plan)
    assert singles and all(s.startswith("bucket#") for s in singles)
