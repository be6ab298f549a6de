"""Near duplicates among saved queries: exact Jaccard similarity of word shingles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.operators.duplicates import hashed
from textquarry.operators.linking import linked, sharing
from textquarry.session import discard, materialise

SIMILARITY = 0.8
SHINGLE = 5
#: Texts and shingles are dealt to so many parts, of which one is shuffled at a time.
PARTS = 4


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Distinct hashes of ``size`` words in a row; a shorter text is one shingle, an
    empty one has none."""
    def of_words(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1)))
        return F.array_distinct(F.transform(
            starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " "))))

    # bound by a lambda of its own, so that a text is split once and not for every shingle
    found = F.transform(F.array(F.split(text, " ")), of_words)[0]
    return F.when(text == "", F.array().cast("array<long>")).otherwise(found)


def _needed(similarity: float) -> Column:
    """How many of the n shingles of a text a similar one cannot lack all of."""
    return F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9)) + 1


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _open_bags(parts: list[DataFrame], similarity: float) -> DataFrame:
    """The bags, in parts, of texts that may be similar to another one.

    A text with enough shingles that no other text has is not. Shingles are counted part by
    part, and what is shuffled for one goes before the next, as all of them fill the disk.
    """
    bags = _all(parts)
    own = [materialise(
        bags.select("node", F.explode("bag").alias("gram")).where(F.pmod("gram", F.lit(PARTS)) == part)
        .groupBy("gram").agg(F.count("*").alias("texts"), F.min("node").alias("node")).where("texts = 1")
        .groupBy("node").agg(F.count("*").alias("own")), "own") for part in range(PARTS)]
    known = _all(own).groupBy("node").agg(F.sum("own").alias("own"))
    left = materialise(bags.select("node", "n").join(known, "node", "left").where(
        F.coalesce("own", F.lit(0)) < _needed(similarity)).select("node"), "open")
    return _all([materialise(part.join(left, "node", "left_semi").select("node", "n", "bag"), "open-bags")
                 for part in parts])


def near_duplicates(corpus: DataFrame, mode: str = "sql", similarity: float = SIMILARITY,
                    size: int = SHINGLE) -> DataFrame:
    """(query_id, group_id) of every row; a group holds what is linked by similar texts.

    Copies are one text from the start. Of texts with n shingles, two that are
    similar share one of their n - ceil(similarity * n) + 1 rarest: these are the
    groups in which candidates are compared, and no link is lost. A text with as many
    that nobody shares is left out before. ``group_id`` is the smallest id of the group.
    """
    texts = materialise(hashed(corpus, mode).select("query_id", "hash", "normalized_text"), "texts", "zstd")
    rows = materialise(texts.select("query_id", "hash"), "rows")
    parts = []
    for part in range(PARTS):
        single = texts.where(F.pmod(F.xxhash64("hash"), F.lit(PARTS)) == part).groupBy("hash").agg(
            F.min("query_id").alias("first_id"), F.first("normalized_text").alias("text"))
        parts.append(materialise(single.select(
            (F.monotonically_increasing_id() * PARTS + part).alias("node"), "hash", "first_id",
            shingles(F.col("text"), size).alias("bag")).withColumn("n", F.size("bag")), "bags"))
    discard(texts)
    named = materialise(_all(parts).select("node", "hash", "first_id"), "nodes")
    bags = _open_bags(parts, similarity)
    discard(*parts)
    grams = bags.select("node", "n", F.explode("bag").alias("gram"))
    rarity = materialise(grams.groupBy("gram").count(), "rarity")
    # the rarest first; as many as any similar text must share one of
    order = Window.partitionBy("node").orderBy("count", "gram")
    prefix = grams.join(rarity, "gram").withColumn("rank", F.row_number().over(order)).where(
        (F.col("rank") <= _needed(similarity)) & (F.col("count") > 1))
    prefixes = materialise(prefix.select("node", "n", F.col("gram").alias("band")), "prefixes")
    discard(rarity)
    comps = linked(sharing(prefixes), bags.select("node", "bag"), similarity)
    if comps is None:
        named = named.withColumn("comp", F.col("node"))
    else:
        named = named.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = materialise(named, "near-groups")
    groups = named.groupBy("comp").agg(F.min("first_id").alias("group_id"))
    return rows.select("query_id", "hash").join(
        named.join(groups, "comp").select("hash", "group_id"), "hash").select("query_id", "group_id")
