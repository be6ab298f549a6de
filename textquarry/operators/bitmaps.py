"""Sets of ids as bitmaps: what is saved, what is missing, and runs of either.

An id lies in a bucket of 32 768 neighbours and is one bit of the bucket's 4 096 bytes
(Spark's ``bitmap_*`` functions). Tasks combine their bits before the shuffle, which
then carries one bitmap per bucket and task, not a row per id, and repeated ids cost
nothing. Runs are read off one bitmap at a time; those that reach a bucket's edge are
stitched to their neighbours, at most two rows per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.ordering import with_next_id
from textquarry.session import materialise

#: Ids of a bitmap, fixed by Spark, as a power of two.
BITS = 15
BUCKET = 1 << BITS
_RUNS = "start_id long, end_id long"


def id_bitmaps(ids: DataFrame, column: str = "query_id") -> DataFrame:
    """(bucket, bits): the set of ids, null ones left out; bucket k begins with id k * BUCKET."""
    known = F.col(column).cast("long")
    placed = ids.where(known.isNotNull()).select(
        F.shiftright(known, BITS).alias("bucket"), known.bitwiseAND(BUCKET - 1).alias("place"))
    return placed.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def merge_bitmaps(parts: DataFrame) -> DataFrame:
    """The union of sets (bucket, bits), such as those of several loads."""
    return parts.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_ids(bitmaps: DataFrame) -> DataFrame:
    """One row (ids): how many distinct ids are set."""
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("ids"))


def write_bitmaps(bitmaps: DataFrame, path: str) -> None:
    """Store a set, so that the next load only has to merge its own."""
    bitmaps.write.mode("overwrite").parquet(path)


def read_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket long, bits binary").parquet(path)


def _members(bits: bytes, wanted: bool) -> np.ndarray:
    flags = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little")
    return np.flatnonzero(flags == wanted)


def unset_ids(bitmaps: DataFrame, start_id: int, end_id: int) -> DataFrame:
    """(query_id) of [start_id, end_id] that are not set, ascending: buckets are sorted, not ids."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket, bits in zip(batch["bucket"], batch["bits"]):
                ids = int(bucket) * BUCKET + _members(bits, False)
                yield pd.DataFrame({"query_id": ids[(ids >= start_id) & (ids <= end_id)]})

    wanted = bitmaps.sparkSession.range(start_id >> BITS, (end_id >> BITS) + 1).withColumnRenamed("id", "bucket")
    empty = F.lit(bytes(BUCKET // 8))
    return wanted.join(bitmaps, "bucket", "left").select("bucket", F.coalesce("bits", empty).alias("bits")) \
        .orderBy("bucket").mapInPandas(listed, "query_id long")


def _runs(bitmaps: DataFrame, present: bool) -> DataFrame:
    """(start_id, end_id) of the runs inside each bucket."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket, bits in zip(batch["bucket"], batch["bits"]):
                ids = int(bucket) * BUCKET + _members(bits, present)
                if len(ids):
                    after = np.flatnonzero(np.diff(ids) > 1)
                    yield pd.DataFrame({"start_id": ids[np.append(0, after + 1)],
                                        "end_id": ids[np.append(after, len(ids) - 1)]})

    return bitmaps.mapInPandas(found, _RUNS)


def _stitched(runs: DataFrame) -> DataFrame:
    """Runs with those joined that meet at the edge of a bucket."""
    runs = materialise(runs, "runs")
    edge = (F.col("start_id").bitwiseAND(BUCKET - 1) == 0) | (F.col("end_id").bitwiseAND(BUCKET - 1) == BUCKET - 1)
    at_edge = runs.where(edge)
    # what begins where another ends goes on; the starts and ends that are left alternate
    starts = at_edge.join(at_edge.select((F.col("end_id") + 1).alias("start_id")), "start_id", "left_anti")
    ends = at_edge.join(at_edge.select((F.col("start_id") - 1).alias("end_id")), "end_id", "left_anti")
    # doubled, so that a start comes before an end at the same id
    marks = starts.select((F.col("start_id") * 2).alias("mark")).union(ends.select(F.col("end_id") * 2 + 1))
    joined = with_next_id(materialise(marks, "marks"), "mark").where(F.col("mark").bitwiseAND(1) == 0).select(
        F.shiftright("mark", 1).alias("start_id"), F.shiftright("next_id", 1).alias("end_id"))
    return runs.where(~edge).unionByName(joined)


def set_runs(bitmaps: DataFrame) -> DataFrame:
    """(start_id, end_id) of every run of consecutive ids that are set."""
    return _stitched(_runs(bitmaps, True))


def unset_runs(bitmaps: DataFrame, start_id: int, end_id: int) -> DataFrame:
    """(start_id, end_id) of every stretch of [start_id, end_id] in which no id is set.

    Buckets without any id are not made: they are the gaps between those there are.
    """
    spark = bitmaps.sparkSession
    first, last = start_id >> BITS, end_id >> BITS
    inside = materialise(bitmaps.where(F.col("bucket").between(first, last)), "bitmaps")
    fences = spark.createDataFrame([(first - 1,), (last + 1,)], "number long")
    absent = with_next_id(inside.select(F.col("bucket").alias("number")).union(fences), "number").where(
        F.col("next_id") > F.col("number") + 1).select(
        ((F.col("number") + 1) * BUCKET).alias("start_id"), (F.col("next_id") * BUCKET - 1).alias("end_id"))
    runs = _stitched(_runs(inside, False).union(absent)).select(
        F.greatest("start_id", F.lit(start_id)).alias("start_id"), F.least("end_id", F.lit(end_id)).alias("end_id"))
    return runs.where("start_id <= end_id")
