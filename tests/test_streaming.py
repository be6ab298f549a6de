from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry_point
from comparing import connect, differences
from textquarry.sources import corpus as source
from textquarry.streaming.incremental import ingest_drifting_files, ingested


def test_drifting_files_stream_in(spark, tmp_path):
    arrived, target, log = (str(tmp_path / n) for n in ("arrived", "target", "log"))
    (tmp_path / "arrived").mkdir()

    def deliver(name, records):
        pq.write_table(pa.Table.from_pylist(records), f"{arrived}/{name}.parquet")

    def rows(frame):
        return sorted((tuple(r) for r in frame.select(*source.CORPUS_TYPES).collect()), key=str)

    def run():
        # a file a batch, so that one batch has a file that cannot be read and nothing else
        ingest_drifting_files(spark, arrived, target, log, files_per_batch=1).awaitTermination()

    deliver("1", [{"query_id": 1, "name": " A  b", "description": None, "tags": [], "owner": "o", "query_sql": "q"}])
    (tmp_path / "arrived" / "bad.parquet").write_bytes(b"not parquet")
    run()
    deliver("2", [{"query_id": 2, "name": None, "description": "D", "tags": [" X", None], "owner": None, "query_sql": None}])
    deliver("3", [{"query_id": 3, "name": "c"}])
    deliver("4", [{"name": "no id"}])
    run()
    expected = rows(source.load_corpus(spark, arrived))
    assert len(expected) == 3 and rows(ingested(spark, target)) == expected
    run()  # nothing new
    # the last batch played again
    last = max((tmp_path / "log" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert rows(ingested(spark, target)) == expected


def test_query_equals_sql(spark, sf_dir):
    query, sql = (part["incremental_stream_drifting"] for part in (entry_point.queries(), entry_point.oracle_sql()))
    assert differences(query(spark, sf_dir), connect(sf_dir), sql) == []
