from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_point
from comparing import connect, differences
from textquarry.operators import duplicates
from textquarry.operators.arrivals import DigestTable, batch_digests, merged_digests, summary, take_in
from textquarry.plans import tables
from textquarry.session import scratch_path

BUCKETS = 4


def corpus(spark, rows):
    return spark.createDataFrame(rows, "query_id long, query_sql string")


def known_rows(spark, table):
    return sorted((r["hash"], r["copies"], r["first_id"]) for r in table.read(spark).collect())


def test_batches_give_what_one_batch_gives(spark):
    folder = scratch_path(spark, "digests")
    batches = [[(5, "select 1"), (7, "select  1"), (8, "select 2"), (9, None)],
               [(3, "select 1"), (None, "select 3"), (4, "")],
               [],
               [(8, "select 2"), (8, "select 2"), (1, "select 3"), (None, "select 4")]]
    one = DigestTable(f"{folder}/one", BUCKETS)
    take_in(corpus(spark, [r for b in batches for r in b]), one)
    known, marked = None, []
    for n, batch in enumerate(batches):
        version = DigestTable(f"{folder}/{n}", BUCKETS)
        marked.append(take_in(corpus(spark, batch), version, known).drop("hash").collect())
        known = version
    assert known_rows(spark, known) == known_rows(spark, one)
    rows = duplicates.hashed(corpus(spark, [r for b in batches for r in b]))
    assert summary(known.read(spark)).collect() == duplicates.duplicate_summary(rows).collect()
    # select 1: known twice from the first batch, and now with a lower id
    assert [tuple(r) for r in marked[1] if r["query_id"] == 3] == [(3, 3, 2, 3)]
    assert sorted(tuple(r) for r in marked[3] if r["query_id"] == 8) == [(8, 3, 1, 8)] * 2
    assert [tuple(r) for r in marked[3] if r["query_id"] is None] == [(None, 1, 0, None)]
    assert [len(m) for m in marked] == [len(b) for b in batches]
    # a batch taken in again adds nothing
    take_in(corpus(spark, batches[3]), known, DigestTable(f"{folder}/2", BUCKETS))
    assert known_rows(spark, known) == known_rows(spark, one)
    with pytest.raises(ValueError, match="new path"):
        take_in(corpus(spark, batches[0]), known, known)


def test_stored_digests_are_not_shuffled(spark, sf_dir):
    folder = scratch_path(spark, "digests")
    rows = duplicates.hashed(tables.sql_texts(spark, sf_dir))
    stored = DigestTable(f"{folder}/a", BUCKETS)
    stored.write(batch_digests(rows).repartition(BUCKETS, "hash"))
    merged = merged_digests(stored.read(spark), batch_digests(rows.select("query_id", "hash")), BUCKETS)
    plan = merged._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sent = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    # digests counted in the tasks, and then the batch's distinct hashes: never the stored ones
    assert len(sent) == 2 and all("first_id" not in columns or "new_id" in columns for columns in sent)
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan


def test_query_equals_sql(spark, sf_dir):
    query, sql = entry_point.queries()["duplicates_arriving"], entry_point.oracle_sql()["duplicates_arriving"]
    assert differences(query(spark, sf_dir), connect(sf_dir), sql) == []
