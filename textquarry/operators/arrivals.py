"""Duplicates over a corpus that arrives in batches.

What is known of earlier batches is one row per hash, in a table bucketed and sorted by
the hash. A batch is brought to these buckets and merged there, so the stored rows,
which grow with the corpus, are never shuffled. Every batch writes a new version of the
table from the one before: a batch that was broken off is simply taken in again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.scores import percentage
from textquarry.operators.duplicates import hashed
from textquarry.session import materialise

BUCKETS = 200
_SCHEMA = "hash string, copies bigint, first_id bigint"


@dataclass(frozen=True)
class DigestTable:
    """One version of the known hashes: hash, copies, first_id (the lowest id)."""

    path: str
    buckets: int = BUCKETS

    @property
    def _name(self) -> str:
        return f"digests_{hashlib.md5(self.path.encode()).hexdigest()}"

    def read(self, spark: SparkSession) -> DataFrame:
        """The table, made known to this session's catalogue where it is not yet."""
        place = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name} ({_SCHEMA}) USING parquet CLUSTERED BY (hash) "
                  f"SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return spark.table(self._name)

    def write(self, digests: DataFrame) -> None:
        (digests.select("hash", "copies", "first_id").write.mode("overwrite").format("parquet")
         .bucketBy(self.buckets, "hash").sortBy("hash").option("path", self.path).saveAsTable(self._name))


def batch_digests(rows: DataFrame) -> DataFrame:
    """(hash, copies, first_id) of rows (query_id, hash), counted before the shuffle."""
    return rows.groupBy("hash").agg(F.count("*").alias("copies"), F.min("query_id").alias("first_id"))


def merged_digests(stored: DataFrame, arrived: DataFrame, buckets: int) -> DataFrame:
    """Stored digests and those of a batch as one table. Only the batch is shuffled."""
    new = arrived.select("hash", F.col("copies").alias("here"), F.col("first_id").alias("new_id")) \
        .repartition(buckets, "hash")
    met = stored.hint("merge").join(new, "hash", "full_outer")
    copies = F.coalesce("copies", F.lit(0)) + F.coalesce("here", F.lit(0))
    return met.select("hash", copies.alias("copies"), F.least("first_id", "new_id").alias("first_id"))


def take_in(batch: DataFrame, target: DigestTable, known: DigestTable | None = None,
            mode: str = "sql") -> DataFrame:
    """Take a batch of the corpus in: write ``target`` from ``known`` and the batch.

    Returns (query_id, hash, copies, before, first_id) of every row of the batch: copies of
    its text so far, with those of the batch, copies before the batch, and the lowest id
    among all. Ids may be null or repeat; ``known`` is None for the first batch.
    """
    spark = batch.sparkSession
    if known is not None and (known.path == target.path or known.buckets != target.buckets):
        raise ValueError("a version is written to a new path, with the buckets of the one before")
    rows = materialise(hashed(batch, mode).select("query_id", "hash"), "arrived")
    digests = batch_digests(rows)
    merged = digests.repartition(target.buckets, "hash") if known is None else merged_digests(
        known.read(spark), digests, target.buckets)
    target.write(merged)
    now = target.read(spark).join(digests.select("hash", F.col("copies").alias("here")), "hash")
    now = materialise(now.withColumn("before", F.col("copies") - F.col("here")), "met").drop("here")
    return rows.join(now, "hash").select("query_id", "hash", "copies", "before", "first_id")


def summary(digests: DataFrame) -> DataFrame:
    """The duplicate summary of all batches so far, from the digests alone."""
    repeated = F.col("copies") > 1
    totals = digests.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_queries"),
        F.coalesce(F.sum(F.when(repeated, F.col("copies"))), F.lit(0)).alias("duplicate_entries"),
        F.count_if(repeated).alias("duplicate_patterns"))
    return totals.select(
        "total_queries", "duplicate_entries",
        percentage(F.col("duplicate_entries"), F.col("total_queries")).alias("duplicate_ratio"),
        "duplicate_patterns")
