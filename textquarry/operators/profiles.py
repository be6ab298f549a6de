"""What a cluster is about: size, top tags, sample names, keywords."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.stopwords import ENGLISH
from textquarry.functions.text import check_mode, is_blank, keyword_text, tokens

NOISE = -1
TOP_TAGS = 5
SAMPLE_NAMES = 3
KEYWORDS = 10
NAME_CUT = 60


def attach_labels(corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """The corpus with the ``cluster`` of each row, joined by id.

    An id with several labels gets the lowest, so no row is multiplied.
    """
    one = labels.groupBy("query_id").agg(F.min("cluster").alias("cluster"))
    return corpus.join(one, "query_id")


def _ranked(rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows per cluster; Spark cuts each task to n rows before the shuffle."""
    position = F.row_number().over(Window.partitionBy("cluster").orderBy(*order))
    return rows.withColumn("rank", position).where(F.col("rank") <= n)


def _as_list(ranked: DataFrame, value: str, name: str) -> DataFrame:
    # the ranking above leaves a fixed number of rows per cluster
    listed = F.array_sort(F.collect_list(F.struct("rank", value)))
    return ranked.groupBy("cluster").agg(F.transform(listed, lambda s: s[value]).alias(name))


def cluster_top_tags(clustered: DataFrame, n: int = TOP_TAGS) -> DataFrame:
    """Most used tags per cluster; repeats and empty tags count, ties as first seen."""
    uses = clustered.select("cluster", "query_id", F.posexplode("tags").alias("pos", "tag"))
    counts = uses.groupBy("cluster", "tag").agg(
        F.count("*").alias("count"), F.min(F.struct("query_id", "pos")).alias("first_seen"))
    return (_ranked(counts, [F.desc("count"), F.col("first_seen")], n)
            .select("cluster", "rank", "tag", "count"))


def cluster_sample_names(clustered: DataFrame, n: int = SAMPLE_NAMES) -> DataFrame:
    return (_ranked(clustered.select("cluster", "query_id", "name"),
                    [F.col("query_id"), F.col("name")], n)
            .select("cluster", "rank", "name"))


def cluster_profile(clustered: DataFrame) -> DataFrame:
    """Size, top tags, first names and mean name length per cluster, noise included."""
    sizes = clustered.groupBy("cluster").agg(
        F.count("*").alias("size"), F.avg(F.length("name")).alias("avg_name_length"))
    tags = _as_list(cluster_top_tags(clustered), "tag", "top_tags")
    names = _as_list(cluster_sample_names(clustered), "name", "sample_names")
    none = F.array().cast("array<string>")
    return (
        sizes.join(tags, "cluster", "left").join(names, "cluster", "left")
        .select(F.col("cluster").alias("cluster_id"), "size",
                F.coalesce("top_tags", none).alias("top_tags"),
                F.coalesce("sample_names", none).alias("sample_names"), "avg_name_length")
        .orderBy("cluster_id")
    )


def cluster_summary(profile: DataFrame) -> DataFrame:
    """A profile as it is shown to people: short names, 'None' for no tags."""
    short = F.transform("sample_names", lambda n: F.substring(n, 1, NAME_CUT))
    shown = F.when(F.size("top_tags") > 0, F.array_join("top_tags", ", ")).otherwise("None")
    return profile.select("cluster_id", "size", shown.alias("top_tags"),
                          F.array_join(short, " | ").alias("sample_names"), "avg_name_length")


def cluster_terms(clustered: DataFrame, mode: str, stop_words: Sequence[str]) -> DataFrame:
    """Term frequency per cluster, noise left out.

    Stop words are looked up once per distinct term of a cluster. They and the
    absence of any term remain as rows with a null term and frequency 0, so
    that a cluster with text is never lost.
    """
    words = (clustered.where(F.col("cluster") != NOISE)
             .select("cluster", keyword_text(mode).alias("text"))
             .select("cluster", tokens(F.col("text")).alias("words"),
                     is_blank(F.col("text")).alias("blank")))
    # no filter on the text: pushed to the scan, it would build the text twice
    none = F.array().cast("array<string>")
    listed = (F.when(F.size("words") > 0, F.col("words")).when(F.col("blank"), none)
              .otherwise(F.array(F.lit(None).cast("string"))))
    counts = (words.select("cluster", F.explode(listed).alias("term"))
              .groupBy("cluster", "term").agg(F.count("term").alias("frequency")))
    kept = F.col("term").isNotNull() & ~F.col("term").isin(*stop_words)
    return counts.select("cluster", F.when(kept, F.col("term")).alias("term"),
                         F.when(kept, F.col("frequency")).otherwise(0).alias("frequency"))


def cluster_keywords(clustered: DataFrame, mode: str, top_n: int = KEYWORDS,
                     stop_words: Sequence[str] = ENGLISH) -> DataFrame:
    """The most frequent terms per cluster, listed alphabetically.

    A cluster without any text is absent; one with only stop words gets an
    empty list.
    """
    ranked = _ranked(cluster_terms(clustered, check_mode(mode), stop_words),
                     [F.desc("frequency"), F.col("term")], top_n)
    # at most top_n terms per cluster; collect_list leaves null terms out
    return ranked.groupBy("cluster").agg(
        F.array_sort(F.collect_list("term")).alias("keywords"))
