"""Tag frequency, tag statistics and tag pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.scores import percentage
from textquarry.functions.text import sorted_distinct, strip
from textquarry.session import materialise


def tag_uses(corpus: DataFrame) -> DataFrame:
    """One row per tag of a row, blanks dropped, repeats kept."""
    return (corpus.select("query_id", F.posexplode("tags").alias("pos", "raw"))
            .select("query_id", "pos", strip(F.lower("raw")).alias("tag"))
            .where(F.col("tag") != ""))


def tag_counts(corpus: DataFrame, ordered: bool = True) -> DataFrame:
    """Uses per tag, most used first; ties in order of first appearance."""
    counts = tag_uses(corpus).groupBy("tag").agg(
        F.count("*").alias("count"), F.min(F.struct("query_id", "pos")).alias("first_seen"))
    if ordered:
        counts = counts.orderBy(F.desc("count"), "first_seen")
    return counts.select("tag", "count")


def top_tags(corpus: DataFrame, n: int) -> DataFrame:
    return tag_counts(corpus).limit(n)


def tag_statistics(corpus: DataFrame) -> DataFrame:
    """The nine tag figures as one row. Empty tags count as assignments here."""
    size = F.coalesce(F.greatest(F.size("tags"), F.lit(0)), F.lit(0))
    unique = tag_uses(corpus).agg(F.count_distinct("tag"))
    zero = F.lit(0)
    return (
        corpus.select(size.alias("n"))
        .agg(F.count("*").alias("total_queries"),
             F.coalesce(F.sum("n"), zero).alias("total_tag_assignments"),
             F.count_if(F.col("n") > 0).alias("queries_with_tags"),
             F.count_if(F.col("n") == 0).alias("queries_without_tags"),
             F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_tags_per_query"),
             F.coalesce(F.min("n"), zero).alias("min_tags_per_query"),
             F.coalesce(F.max("n"), zero).alias("max_tags_per_query"))
        .select("total_queries", unique.scalar().alias("unique_tags"), "total_tag_assignments",
                "queries_with_tags", "queries_without_tags", "avg_tags_per_query",
                "min_tags_per_query", "max_tags_per_query",
                percentage(F.col("queries_with_tags"),
                           F.col("total_queries")).alias("percentage_with_tags"))
    )


#: Frequent tags among which pairs are counted before all are.
HEADS = (64, 512)


def _tag_sets(corpus: DataFrame) -> DataFrame:
    return corpus.select("query_id", sorted_distinct(F.col("tags")).alias("tags"))


def _pair_rows(sets: DataFrame) -> DataFrame:
    """One row per pair tag1 < tag2 of a row's own sorted tags, so there is no join."""
    first = sets.where(F.size("tags") >= 2).select("query_id", "tags", F.posexplode("tags").alias("i", "tag1"))
    rest = F.slice("tags", F.col("i") + 2, F.size("tags"))
    return first.select("query_id", "tag1", F.explode(rest).alias("tag2"))


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("tag1", "tag2").agg(
        F.count("*").alias("count"), F.min("query_id").alias("first_id"))


def tag_pair_counts(corpus: DataFrame) -> DataFrame:
    """How many rows hold both tags, for every pair tag1 < tag2 that occurs.

    Pairs are counted before the one shuffle.
    """
    return _counted(_pair_rows(_tag_sets(corpus)))


def _most_frequent(pairs: DataFrame, n: int) -> DataFrame:
    return pairs.orderBy(F.desc("count"), "first_id", "tag1", "tag2").limit(n)


def tag_cooccurrence(corpus: DataFrame, top_n: int = 10) -> DataFrame:
    """Most frequent tag pairs; ties go to the pair seen first."""
    return _most_frequent(tag_pair_counts(corpus), top_n).select("tag1", "tag2", "count")


def head_pairs(corpus: DataFrame, head: list[str]) -> DataFrame:
    """The pairs among a few tags, one row per row of the corpus that holds both."""
    kept = F.array_intersect("tags", F.array(*[F.lit(tag) for tag in head]).cast("array<string>"))
    return _pair_rows(_tag_sets(corpus).select("query_id", kept.alias("tags")))


def frequent_pairs(corpus: DataFrame, top_n: int = 10, heads: tuple[int, ...] = HEADS) -> DataFrame:
    """As :func:`tag_cooccurrence`, mostly without making the pairs of rare tags.

    No pair is more frequent than the rarer of its tags. So pairs are first counted among
    the most frequent tags only; once the last of the top pairs is more frequent than any
    tag left out, no other pair can be among them. Where that never holds, all pairs are
    counted.
    """
    uses = _tag_sets(corpus).select(F.explode("tags").alias("tag")).groupBy("tag").count()
    # a bounded number of tags reaches the driver
    ranked = uses.orderBy(F.desc("count"), "tag").limit(max(heads, default=0) + 1).collect()
    for size in heads:
        left_out = ranked[size]["count"] if len(ranked) > size else 0
        top = materialise(_most_frequent(
            _counted(head_pairs(corpus, [r["tag"] for r in ranked[:size]])), top_n), "top-pairs")
        found = top.agg(F.count("*").alias("n"), F.min("count").alias("least")).first()
        if not left_out or (found["n"] == top_n and (top_n == 0 or found["least"] > left_out)):
            return _most_frequent(top, top_n).select("tag1", "tag2", "count")
    return tag_cooccurrence(corpus, top_n)


def top_tags_share(corpus: DataFrame, n: int = 15) -> DataFrame:
    """Most used tags with their share of the corpus and the width of their bar."""
    total = corpus.agg(F.count("*"))
    share = top_tags(corpus, n).withColumn("percentage",
                                           percentage(F.col("count"), total.scalar()))
    return share.select("tag", "count", "percentage",
                        F.floor(F.col("percentage") / 2).alias("bar_width"))


def chart_top_tags(corpus: DataFrame, n: int = 50) -> DataFrame:
    """Series of the bar, scatter and tree charts."""
    return top_tags(corpus, n)


def chart_tag_share(corpus: DataFrame, n: int = 20) -> DataFrame:
    """Series of the pie chart: top tags and their share of those tags."""
    top = top_tags(corpus, n)
    return top.withColumn("share", percentage(F.col("count"), top.agg(F.sum("count")).scalar()))
