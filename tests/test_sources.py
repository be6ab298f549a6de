from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from textquarry.sources import corpus as source
from textquarry.sources import cursor, sinks


@pytest.fixture(scope="module")
def drifting(tmp_path_factory):
    folder = tmp_path_factory.mktemp("drifting")
    batches = {
        "1-1": [{"query_id": 1, "name": " A  b", "description": None, "tags": [], "owner": "o",
                 "query_sql": "q"}],
        "2-2": [{"query_id": 2, "name": None, "description": "D", "tags": [" X", None],
                 "owner": None, "query_sql": None}],
        "3-3": [{"query_id": 3, "name": "c"}],
        "4-4": [{"name": "no id"}],
    }
    for name, records in batches.items():
        pq.write_table(pa.Table.from_pylist(records), folder / f"{name}.parquet", compression="zstd")
    (folder / "5-5.parquet").write_bytes(b"not parquet")
    return str(folder)


def test_drifting_files_all_load(spark, drifting):
    rows = sorted(tuple(r) for r in source.load_corpus(spark, drifting).collect())
    assert rows == [(1, "a b", "", [], "o", "q"), (2, "", "d", ["x"], None, None),
                    (3, "c", "", [], "", "")]


def test_report_names_the_bad_file(spark, drifting):
    report = source.load_report(spark, drifting)
    bad = [r["path"] for r in report.where("error IS NOT NULL").collect()]
    assert len(bad) == 1 and bad[0].endswith("5-5.parquet")
    assert report.count() == 5


def test_limit(spark, drifting):
    assert source.load_corpus(spark, drifting, limit=2).count() == 2
    assert source.load_corpus(spark, drifting, limit=0).count() == 3


def test_saved_ids_and_masked_sample(spark, drifting):
    assert sorted(r[0] for r in source.load_saved_ids(spark, drifting).collect()) == [1, 2, 3]
    sample = source.load_masked_sample(spark, drifting)
    assert sorted(r["query_id"] for r in sample.collect()) == [1, 2]
    assert source.load_masked_sample(spark, drifting, limit=0).count() == 0


def test_no_files(spark, tmp_path):
    assert source.load_corpus(spark, str(tmp_path)).count() == 0


def test_cursor_defaults_and_overlay(spark, tmp_path):
    assert tuple(cursor.load_cursor(spark, None).first()) == (0, 0, 0, None)
    file = tmp_path / "cursor.json"
    file.write_text(json.dumps({"total_processed": 7, "last_run": "2024-01-01T00:00:00"}, indent=2))
    assert tuple(cursor.load_cursor(spark, str(file)).first()) == (7, 0, 0, "2024-01-01T00:00:00")


def test_empty_results_write_nothing(spark, drifting, tmp_path):
    empty = source.load_corpus(spark, drifting).where("false")
    assert not sinks.write_corpus(empty, str(tmp_path / "a"))
    assert not sinks.write_duplicates(empty, str(tmp_path), "sql")
    assert list(tmp_path.iterdir()) == []


def test_deduplicated_never_overwrites(spark, drifting, tmp_path):
    rows = source.load_corpus(spark, drifting)
    sinks.write_deduplicated(rows, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_deduplicated(rows, str(tmp_path / "out"))


def test_tsv_layout(spark, tmp_path):
    frame = spark.createDataFrame([("a b", 2)], "tag string, count long").coalesce(1)
    sinks.write_tags_tsv(frame, str(tmp_path / "tags"))
    text = next((tmp_path / "tags").glob("part-*")).read_text()
    assert text == "TAG\tCOUNT\na b\t2\n"


def test_files_with_damaged_pages_are_skipped(spark, tmp_path):
    def rows(first):
        return pa.Table.from_pylist([{"query_id": i, "name": f"name {i * 7919}", "query_sql": f"select {i * 104729}"}
                                     for i in range(first, first + 300)])

    pq.write_table(rows(0), tmp_path / "good.parquet", row_group_size=100)
    pq.write_table(rows(300).slice(0, 0), tmp_path / "no rows.parquet")
    pq.write_table(rows(600), tmp_path / "pages.parquet", row_group_size=100)
    raw = bytearray((tmp_path / "pages.parquet").read_bytes())
    column = pq.ParquetFile(tmp_path / "pages.parquet").metadata.row_group(1).column(2)
    at = column.dictionary_page_offset or column.data_page_offset
    raw[at:at + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    (tmp_path / "pages.parquet").write_bytes(bytes(raw))
    (tmp_path / "cut.parquet").write_bytes((tmp_path / "good.parquet").read_bytes()[:900])
    (tmp_path / "empty.parquet").write_bytes(b"")

    report = source.page_report(spark, str(tmp_path)).collect()
    found = {(r["path"].rsplit("/", 1)[1], r["row_group"]): r["error"] for r in report}
    assert {key for key, error in found.items() if error} == {
        ("pages.parquet", 1), ("cut.parquet", None)}
    assert {key for key, error in found.items() if not error and key[0] != "no rows.parquet"} == {
        ("good.parquet", 0), ("good.parquet", 1), ("good.parquet", 2), ("pages.parquet", 0), ("pages.parquet", 2)}
    loaded = source.load_corpus(spark, str(tmp_path), verify=True)
    assert sorted(r["query_id"] for r in loaded.collect()) == list(range(300))
    with pytest.raises(Exception):
        source.load_corpus(spark, str(tmp_path)).collect()


def test_footer_mark_equals_scan(spark, tmp_path):
    folder = str(tmp_path / "corpus")
    (tmp_path / "corpus").mkdir()
    pq.write_table(pa.table({"query_id": pa.array([3, 71, None], pa.int64())}), f"{folder}/a.parquet")
    pq.write_table(pa.table({"query_id": pa.array([5, 12], pa.int32()), "name": ["x", "y"]}), f"{folder}/b.parquet")
    pq.write_table(pa.table({"query_id": ["80", "none"]}), f"{folder}/c.parquet")
    pq.write_table(pa.table({"name": ["no id"]}), f"{folder}/d.parquet")
    pq.write_table(pa.table({"query_id": pa.array([], pa.int64())}), f"{folder}/e.parquet")
    assert source.footer_high_water_mark(spark, folder) == 80
    assert source.footer_high_water_mark(spark, folder, stored=100) == 100
    # no statistics: the files are scanned
    pq.write_table(pa.table({"query_id": [93, 2], "tags": [["t"], []]}), f"{folder}/f.parquet", write_statistics=False)
    assert source.footer_high_water_mark(spark, folder) == 93
    plan = source.largest_id(spark, (f"{folder}/a.parquet",))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MAX(query_id)]" in plan
