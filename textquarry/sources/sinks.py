"""Writers. Each one is a single Spark write job; none gathers rows first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZSTD = "zstd"


def _parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("compression", ZSTD).parquet(path)


def write_corpus(corpus: DataFrame, path: str) -> bool:
    """Corpus rows as zstd Parquet; nothing is written for an empty one."""
    if corpus.isEmpty():
        return False
    _parquet(corpus, path)
    return True


def write_clustered(clustered: DataFrame, path: str) -> None:
    """The corpus with its ``cluster`` column."""
    _parquet(clustered, path)


def write_by_cluster(clustered: DataFrame, path: str, max_rows_per_file: int = 5_000_000) -> None:
    """One folder per cluster, noise included.

    Rows are shuffled by cluster; Spark joins small clusters into one task and
    splits a large one over many, by their measured sizes.
    """
    (clustered.hint("rebalance", "cluster").write.mode("overwrite")
     .option("compression", ZSTD).option("maxRecordsPerFile", max_rows_per_file)
     .partitionBy("cluster").parquet(path))


def _list_cell(column: str) -> Column:
    return F.to_json(F.col(column)).alias(column)


def write_cluster_stats(profile: DataFrame, path: str) -> None:
    """Cluster profile as CSV with a header; list cells as JSON text."""
    (profile.select("cluster_id", "size", _list_cell("top_tags"), _list_cell("sample_names"),
                    "avg_name_length")
     .write.mode("overwrite").option("header", "true").option("escape", '"').csv(path))


def write_keywords(keywords: DataFrame, path: str) -> None:
    """Keywords as JSON lines, one object {cluster id: words} per cluster."""
    entry = F.to_json(F.create_map(F.col("cluster").cast("string"), F.col("keywords")))
    keywords.select(entry.alias("value")).write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, tightness: DataFrame, path: str) -> None:
    """The metrics record as one JSON object, and the tightness per cluster."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/record")
    tightness.write.mode("overwrite").json(f"{path}/cluster_tightness")


def write_tags(tag_counts: DataFrame, path: str) -> None:
    """(tag, count) as zstd Parquet, in the order given."""
    _parquet(tag_counts.select("tag", "count"), path)


def write_tags_tsv(tag_counts: DataFrame, path: str, header: bool = True) -> None:
    """Tag counts as tab-separated text."""
    (tag_counts.select(F.col("tag").alias("TAG"), F.col("count").alias("COUNT"))
     .write.mode("overwrite").option("sep", "\t").option("header", str(header).lower())
     .option("quote", "").csv(path))


def write_cooccurrence_tsv(pairs: DataFrame, path: str) -> None:
    """Tag pairs as tab-separated text."""
    (pairs.select(F.col("tag1").alias("TAG 1"), F.col("tag2").alias("TAG 2"),
                  F.col("count").alias("COUNT"))
     .write.mode("overwrite").option("sep", "\t").option("header", "true")
     .option("quote", "").csv(path))


def write_duplicates(duplicates: DataFrame, directory: str, mode: str) -> bool:
    """Duplicate rows below ``duplicates_{mode}.parquet``; nothing when there are none."""
    if duplicates.isEmpty():
        return False
    _parquet(duplicates, f"{directory}/duplicates_{mode}.parquet")
    return True


def write_deduplicated(survivors: DataFrame, path: str) -> None:
    """Corpus without copies, to a new path: its input must not be overwritten."""
    survivors.write.mode("errorifexists").option("compression", ZSTD).parquet(path)


def write_cluster_state(points: DataFrame, path: str) -> None:
    """Vectors, reduced vectors and labels by id."""
    _parquet(points, path)
