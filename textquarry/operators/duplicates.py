"""Exact and structural duplicates by the hash of a normalised text.

Counting is always an aggregation on the 40-character hash, combined before the
shuffle. Rows are matched by a semi join, whose hot hashes the adaptive skew
join splits; no window ever holds all rows of one hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.scores import percentage
from textquarry.functions.text import dedup_text, structure_text, text_hash
from textquarry.session import materialise

SAMPLE_NAMES = 3
SAMPLE_OWNERS = 3
TOP_GROUPS = 10

REMOVAL_MODES = ("exact", "hash", "structure")


def hashed(corpus: DataFrame, mode: str = "sql") -> DataFrame:
    """The corpus with ``normalized_text`` and ``hash``."""
    return (corpus.withColumn("normalized_text", dedup_text(mode))
            .withColumn("hash", text_hash(F.col("normalized_text"))))


def structure_hashed(corpus: DataFrame) -> DataFrame:
    """As :func:`hashed`, for SQL whose literals are masked."""
    return (corpus.withColumn("normalized_text", structure_text())
            .withColumn("hash", text_hash(F.col("normalized_text"))))


def repeated_hashes(rows: DataFrame) -> DataFrame:
    """(hash, count) of every hash that occurs more than once."""
    return rows.groupBy("hash").agg(F.count("*").alias("count")).where("count > 1")


def duplicates_of(rows: DataFrame) -> DataFrame:
    """All rows, first copies included, whose hash is repeated.

    The repeated hashes are stored first: where they are few, Spark sees it and sends them
    to the texts, so that no text is shuffled.
    """
    repeated = materialise(repeated_hashes(rows).select("hash"), "repeated")
    return rows.join(repeated, "hash", "left_semi").select(*rows.columns)


def find_duplicates(corpus: DataFrame, mode: str = "sql") -> DataFrame:
    return duplicates_of(hashed(corpus, mode))


def structural_duplicates(corpus: DataFrame) -> DataFrame:
    return duplicates_of(structure_hashed(corpus))


def _first_per_hash(rows: DataFrame, value: str, order: str, n: int, name: str) -> DataFrame:
    """The first n values per hash; row_number() <= n is cut down before the shuffle."""
    position = F.row_number().over(Window.partitionBy("hash").orderBy(order, value))
    kept = rows.select("hash", order, value).withColumn("n", position).where(F.col("n") <= n)
    # at most n entries per hash
    listed = F.array_sort(F.collect_list(F.struct("n", value)))
    return kept.groupBy("hash").agg(F.transform(listed, lambda s: s[value]).alias(name))


def _hashes(rows: DataFrame) -> DataFrame:
    """What groups are described by, without the texts; these are read and hashed once."""
    return materialise(rows.select("hash", "query_id", "name", "owner"), "hashes")


def group_owners(rows: DataFrame) -> DataFrame:
    """Distinct owners of every repeated hash, one per row; no owner, no row."""
    rows = _hashes(rows)
    owners = rows.where(F.col("owner").isNotNull()).select("hash", "owner").distinct()
    return owners.join(repeated_hashes(rows).select("hash"), "hash", "left_semi")


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """Per repeated hash: copies, first names by id and number of owners.

    The owners themselves, which may be many, are rows of :func:`group_owners`.
    """
    rows = _hashes(rows)
    groups = repeated_hashes(rows)
    names = _first_per_hash(rows, "name", "query_id", SAMPLE_NAMES, "sample_names")
    owners = (rows.where(F.col("owner").isNotNull()).select("hash", "owner").distinct()
              .groupBy("hash").agg(F.count("*").alias("n_owners")))
    return (groups.join(names, "hash").join(owners, "hash", "left")
            .select("hash", "count", "sample_names",
                    F.coalesce("n_owners", F.lit(0)).alias("n_owners")))


def top_duplicate_groups(rows: DataFrame, n: int = TOP_GROUPS) -> DataFrame:
    """The largest groups with their first names and owners."""
    rows = _hashes(rows)
    top = repeated_hashes(rows).orderBy(F.desc("count"), "hash").limit(n)
    # n rows, so the sides below are filtered by a broadcast
    keys = F.broadcast(top.select("hash"))
    members = rows.select("hash", "query_id", "name", "owner").join(keys, "hash", "left_semi")
    names = _first_per_hash(members, "name", "query_id", SAMPLE_NAMES, "sample_names")
    owners = _first_per_hash(
        members.where(F.col("owner").isNotNull()).select("hash", "owner").distinct()
        .withColumn("by", F.col("owner")), "owner", "by", SAMPLE_OWNERS, "sample_owners")
    return (top.join(names, "hash").join(owners, "hash", "left")
            .select("hash", "count", "sample_names",
                    F.coalesce("sample_owners", F.array().cast("array<string>"))
                    .alias("sample_owners"))
            .orderBy(F.desc("count"), "hash"))


def duplicate_summary(rows: DataFrame) -> DataFrame:
    """Total rows, rows in duplicate groups, their share and the number of groups."""
    per_hash = rows.groupBy("hash").agg(F.count("*").alias("count"))
    repeated = F.col("count") > 1
    totals = per_hash.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_queries"),
        F.coalesce(F.sum(F.when(repeated, F.col("count"))), F.lit(0)).alias("duplicate_entries"),
        F.count_if(repeated).alias("duplicate_patterns"))
    return totals.select(
        "total_queries", "duplicate_entries",
        percentage(F.col("duplicate_entries"), F.col("total_queries")).alias("duplicate_ratio"),
        "duplicate_patterns")


def remove_duplicates(corpus: DataFrame, mode: str = "hash") -> DataFrame:
    """One row per group of equal normalised SQL: the one with the lowest id.

    'exact' compares the text, 'hash' its digest, 'structure' the digest of the
    text with literals masked. Taking the minimum of the whole row needs one
    pass, and a task sends one row per group on, however many copies it read.
    """
    if mode not in REMOVAL_MODES:
        raise ValueError(f"mode must be one of {REMOVAL_MODES}")
    text = structure_text() if mode == "structure" else dedup_text("sql")
    key = text if mode == "exact" else text_hash(text)
    ordered = ["query_id", *[c for c in corpus.columns if c != "query_id"]]
    return (corpus.groupBy(key.alias("key")).agg(F.min(F.struct(*ordered)).alias("row"))
            .select("row.*").select(*corpus.columns))


def duplication_by_cluster(clustered: DataFrame, mode: str = "sql") -> DataFrame:
    """Rows, duplicate rows and their share per cluster, over a clustered corpus.

    Copies are counted corpus-wide: (hash, cluster) counts are formed first, so
    the join below moves one row per hash and cluster and never the texts.
    """
    per_pair = (hashed(clustered, mode).groupBy("hash", "cluster")
                .agg(F.count("*").alias("rows")))
    per_hash = per_pair.groupBy("hash").agg(F.sum("rows").alias("copies"))
    return (
        per_pair.join(per_hash, "hash").groupBy("cluster")
        .agg(F.sum("rows").alias("total_queries"),
             F.coalesce(F.sum(F.when(F.col("copies") > 1, F.col("rows"))), F.lit(0))
             .alias("duplicate_entries"))
        .withColumn("duplicate_ratio",
                    percentage(F.col("duplicate_entries"), F.col("total_queries")))
    )
