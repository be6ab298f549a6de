from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from textquarry.functions import scores, text
from textquarry.functions.stopwords import ENGLISH

SQL_CASES = [
    ("a/**/b", "ab", "ab"),
    ("x --c\r\ny", "x \ny", "x y"),
    ("s = '--' AND t", "s = '", "s = '"),
    ("a#b\nc", "a#b\nc", "a c"),
    ("a /* open", "a /* open", "a /* open"),
    ("A\x85\xa0B", "A\x85\xa0B", "a b"),
    ("\x1cA\x1f", "A", "a"),
    ("a --b c\nd", "a \nd", "a d"),
    ("/* one\ntwo */ SELECT 1 -- end", "SELECT 1", "select 1"),
    ("", "", ""),
    (None, "", ""),
]


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, s string")
    rows = frame.select("id", expression(F.col("s")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["id"])]


def test_clean_and_normalize_sql(spark):
    values = [c[0] for c in SQL_CASES]
    clean = column(spark, values, lambda s: text.clean_sql(F.coalesce(s, F.lit(""))))
    assert clean == [c[1] for c in SQL_CASES]
    assert column(spark, values, text.normalize_sql) == [c[2] for c in SQL_CASES]


def test_normalize_text(spark):
    got = column(spark, ["  A \t\n B　", None, "", "\x0b"], text.normalize_text)
    assert got == ["a b", "", "", ""]


def test_mask_literals(spark):
    values = ["A = 'x  0xAB'  AND b=0xAF0", "0xabg x0xab 0xa_", None]
    assert column(spark, values, text.mask_literals) == [
        "a = '<val>' and b=<address>", "0xabg x0xab 0xa_", ""]


def test_hash(spark):
    assert column(spark, ["", "é"], text.text_hash) == [
        hashlib.sha1(s.encode()).hexdigest() for s in ("", "é")]


def test_tokens(spark):
    got = column(spark, ["Ab a ab_1, É9"], text.tokens)
    assert got == [["ab", "ab_1", "é9"]]


def test_normalize_tags(spark):
    frame = spark.createDataFrame(
        [(0, [" A", "a", "", None]), (1, []), (2, None)], "id int, tags array<string>")
    rows = frame.select("id", text.normalize_tags(F.col("tags")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in rows} == {0: ["a", "a", ""], 1: [], 2: []}


def test_three_semantic_texts(spark):
    frame = spark.createDataFrame(
        [("n", "", ["a", "", "b"], "o", None), ("", "d", [], None, "x")],
        "name string, description string, tags array<string>, owner string, query_sql string")
    row = frame.select(text.text_semantic().alias("p1"), text.dedup_text("semantic").alias("p3"),
                       text.keyword_text("semantic").alias("p5"), text.text_sql().alias("sql"))
    assert [tuple(r) for r in row.collect()] == [
        ("n o a  b", "n a b", "n a  b", ""), ("d", "d", "d", "x")]


def test_mode_is_checked_before_any_plan():
    with pytest.raises(ValueError):
        text.check_mode("both")
    assert text.check_mode("SQL") == "sql"


def test_stop_words_are_the_spark_list(spark):
    assert list(ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aB' -#/*\n\r\t0xf_\x85\xa0", max_size=30), min_size=20,
                max_size=40))
def test_normalize_sql_equals_python_regex(spark, values):
    def plain(s):
        s = re.sub(r"--.*?$", "", re.sub(r"/\*.*?\*/", "", s, flags=re.S), flags=re.M).strip()
        for pattern, flags in ((r"--.*?(\r?\n|$)", 0), (r"#.*?(\r?\n|$)", 0), (r"/\*.*?\*/", re.S)):
            s = re.sub(pattern, " ", s, flags=flags)
        return re.sub(r"\s+", " ", s.lower()).strip()

    assert column(spark, values, text.normalize_sql) == [plain(v) for v in values]


def test_scores(spark):
    row = spark.range(1).select(
        scores.percentage(F.lit(1), F.lit(0)).alias("none"),
        scores.percentage(F.lit(3), F.lit(2)).alias("over"),
        scores.separation_band(F.lit(0.5)).alias("good"),
        scores.separation_band(F.lit(0.0)).alias("poor"),
        scores.homogeneity_band(F.lit(0.71)).alias("very"),
        scores.backoff_delay(F.lit(3), 2.0).alias("delay"),
        scores.euclidean(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))
        .alias("d")).first()
    assert tuple(row) == (0.0, 150.0, "GOOD", "POOR", "VERY HOMOGENEOUS", 8.0, 5.0)
