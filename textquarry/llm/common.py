"""Shared by the corpus operators: reading a table and naming columns safely."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.session import materialise

#: Column with the key of a row: ids may repeat or be null.
ROW = "_row_key"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text, so that no further column can clash with ours."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def with_rows(docs: DataFrame) -> DataFrame:
    """The documents with a key of each row that is the same however often they are read:
    its file and place in it. What is not read from files alone is stored first."""
    key = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    try:
        return docs.select("*", key.alias(ROW))
    except AnalysisException:
        return materialise(docs, "rows").select("*", key.alias(ROW))


def without_rows(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of :func:`with_rows` whose key is not among (row)."""
    return keyed.join(gone.select(F.col("row").alias(ROW)), ROW, "left_anti").drop(ROW)


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's default, as a row is a whole text;
    a number that the user has set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


# Fixed value: the reflected polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


def sql_crc32(text: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of a text's UTF-8 bytes, which DuckDB lacks."""
    digits = f"hex(encode({text}))"

    def digit(at: str) -> str:
        return f"(strpos('0123456789ABCDEF', substr({digits}, {at}, 1)) - 1)"

    taken = f"list_transform(range(1, strlen({digits}), 2), lambda i: {digit('i')} * 16 + {digit('i + 1')})"
    # each byte is one operation that takes it in and eight that shift
    steps = f"flatten(list_transform({taken}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, s: CASE WHEN s >= 0 "
            f"THEN xor(c, s) ELSE xor(c >> 1, (c & 1) * {_POLYNOMIAL}) END), 4294967295)")
