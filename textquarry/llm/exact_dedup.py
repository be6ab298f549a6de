"""Exact duplicates with the heavy hitters split off.

Misra-Gries counters (Spark's ``freqItems``) name the digests that may hold more
than a given share of the rows. Their exact counts verify them; the winners, at
most ``1 / support`` rows, are broadcast, so rows of the mass copies find their
survivor in the map task and are never sent to one place. All other digests are
grouped by an ordinary shuffle, in which no group is larger than that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import ROW, filled, with_rows, without_rows
from textquarry.session import materialise

# Fixed value: what counts as one space in a comparison.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(filled(text), SPACE_RUN, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text_sha256): one row per document, stored once."""
    row = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.sha2(normalised(F.col(f"`{text_col}`").cast("string")), 256).alias("text_sha256"))
    return materialise(rows, "digests")


def _survivors(rows: DataFrame) -> DataFrame:
    # a null id gives way to any other; of repeated ids the first row stays
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    return rows.groupBy("text_sha256").agg(
        F.count("*").alias("group_size"), F.min(order).alias("first"))


def heavy_hitters(rows: DataFrame, support: float = 0.001) -> DataFrame:
    """Survivors of the digests that hold at least ``support`` of all rows.

    Misra-Gries misses none of them; what it names too much fails the exact
    count. The result has at most ``1 / support`` rows.
    """
    prefix = F.xxhash64("text_sha256")
    named = rows.select(prefix.alias("prefix")).freqItems(["prefix"], support).select(
        F.explode("prefix_freqItems").alias("prefix"))
    counted = _survivors(rows.withColumn("prefix", prefix).join(
        F.broadcast(named), "prefix", "left_semi"))
    return counted.where(F.col("group_size") >= support * rows.count())


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     support: float = 0.001) -> DataFrame:
    """One row per document with the document that stays for its text.

    Texts are equal when they are after each run of ASCII white space became one
    space; null counts as empty. Of equal texts the smallest ``doc_id`` stays; a
    null id stays only if its group has no other, and of rows that repeat an id
    one stays. An empty table gives no rows. Further columns are ignored.
    Columns: doc_id, keep_id, group_size, kept, text_sha256.
    """
    return _decided(docs, id_col, text_col, support).drop("row")


def _decided(docs: DataFrame, id_col: str, text_col: str, support: float) -> DataFrame:
    rows = digests(docs, id_col, text_col)
    winners = materialise(heavy_hitters(rows, support), "heavy")
    rest = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    found = rows.join(F.broadcast(winners), "text_sha256").unionByName(
        rest.join(_survivors(rest), "text_sha256"))
    return found.select(
        "row", "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                support: float = 0.001) -> DataFrame:
    """The documents that stay, with all their columns: of rows with an id, one of each text.

    Of equal texts the row with the smallest id stays, one of them where it repeats. Rows
    without an id are kept. An empty table stays empty.
    """
    keyed = with_rows(docs)
    return without_rows(keyed, _decided(keyed, id_col, text_col, support).where(
        ~F.col("kept") & F.col("doc_id").isNotNull()))


# DuckDB counterpart of exact_duplicates over ``documents``.
SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'))
                  AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d"""
