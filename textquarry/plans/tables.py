"""Corpus-shaped views over the test tables, and the folder helpers of the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.session import scratch_path
from textquarry.sources.corpus import canonicalise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a raw labelled corpus: every row, whole texts."""
    long = F.col("n_chars") >= 500
    digits = F.length(F.col("n_chars").cast("string")).cast("string")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("query_id"),
        F.concat(F.lit(" Text  "), F.upper("lang"), F.lit(" of "),
                 F.col("n_chars").cast("string"), F.lit(" Chars ")).alias("name"),
        F.when(long, F.col("text")).alias("description"),
        F.array(F.concat(F.lit(" "), F.upper("lang")), F.concat(F.lit("Digits"), digits),
                F.when(F.col("n_chars") > 1000, F.col("lang")).otherwise("")).alias("tags"),
        F.when(~F.col("source").isin("src3", "src7"), F.col("source")).alias("owner"),
        F.col("text").alias("query_sql"),
        F.when(F.col("source") == "src0", -1)
        .otherwise(F.expr("substr(source, 4)").cast("int")).alias("cluster"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonicalise(raw_documents(spark, sf_dir))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical corpus with the label that already sits on its rows."""
    return canonicalise(raw_documents(spark, sf_dir), keep=("cluster",))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of each order as its tag list: padded, repeated, some empty."""
    name = (F.when(F.col("l_linenumber") % 7 == 0, "")
            .when(F.col("l_linenumber") % 2 == 0, F.concat(F.upper("p_name"), F.lit(" ")))
            .otherwise(F.col("p_name")))
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    # the lines of one order are few
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", name.alias("t"))))
    return lines.groupBy(F.col("l_orderkey").alias("query_id")).agg(
        F.transform(listed, lambda x: x["t"]).alias("tags"))


def sql_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as SQL texts with every comment style, quotes and hex literals."""
    key = F.col("o_orderkey")
    variant = key % 4
    comment = (
        F.when(variant == 0, F.concat(F.lit(" -- note "), key.cast("string"), F.lit("\n")))
        .when(variant == 1, " /* a\nb */ ").when(variant == 2, " # h\r\n").otherwise(" "))
    return table(spark, sf_dir, "orders").select(
        key.alias("query_id"), F.col("o_orderpriority").alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.array("o_orderpriority").alias("tags"),
        F.concat(F.lit("owner"), (F.col("o_custkey") % 10).cast("string")).alias("owner"),
        F.concat(F.lit("SELECT  * FROM t"), (F.col("o_custkey") % 50).cast("string"), comment,
                 F.lit("WHERE s = '"), F.col("o_orderstatus"), F.lit("' AND a = 0xAB"),
                 (F.col("o_custkey") % 3).cast("string")).alias("query_sql"),
        (F.col("o_custkey") % 7).cast("int").alias("cluster"))


def line_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have lines: an id set with gaps."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"))


def labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have labels: a sparser id set."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"))


def _bounds(frame: DataFrame, column: str) -> tuple[int, int]:
    low, high = frame.agg(F.min(column), F.max(column)).first()
    return int(low), int(high)


def order_range(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    return _bounds(table(spark, sf_dir, "orders"), "o_orderkey")


def document_range(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    return _bounds(table(spark, sf_dir, "documents"), "doc_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` pulled apart by label, with a second labelling beside."""
    label = F.col("label")
    shifted = F.transform("embedding", lambda x, i: x.cast("double") * F.lit(0.1)
                          + F.when(i == label, F.lit(1.0)).otherwise(F.lit(0.0)))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), label.alias("cluster"), shifted.alias("v"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("pseudo"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a fetch log: four attempts per id, null for a network error."""
    kind = F.col("event_type")
    status = (F.when(kind.isin("click", "view"), 200).when(kind == "purchase", 404)
              .when(kind == "error", 503))
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 4).alias("query_id"),
        (F.col("event_id") % 4).cast("int").alias("attempt"), status.alias("status"))


def timed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetch log with the time of each attempt."""
    times = table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 4).alias("query_id"),
        (F.col("event_id") % 4).cast("int").alias("attempt"), F.col("ts").cast("timestamp").alias("at"))
    return attempts(spark, sf_dir).join(times, ["query_id", "attempt"])


def write_drifting(spark: SparkSession, sf_dir: str) -> str:
    """The raw corpus on disk in two schemas: no ``description`` where all are null."""
    path = scratch_path(spark, "drifting")
    raw = raw_documents(spark, sf_dir).drop("cluster")
    without = F.col("description").isNull()
    raw.where(~without).write.parquet(path)
    raw.where(without).drop("description").write.mode("append").parquet(path)
    return path
