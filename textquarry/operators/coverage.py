"""Which ids of a range are saved, which are missing, and how they are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.scores import percentage
from textquarry.operators.bitmaps import id_bitmaps, set_runs, unset_ids, unset_runs
from textquarry.operators.ordering import with_next_id, with_rank
from textquarry.session import materialise

HISTOGRAM_BINS = 50
DEFAULT_BATCH_SIZE = 500


def saved_ids(corpus: DataFrame) -> DataFrame:
    return corpus.select("query_id").where(F.col("query_id").isNotNull()).distinct()


def missing_ids(saved: DataFrame, start_id: int, end_id: int) -> DataFrame:
    """Ids of [start_id, end_id] that are not saved, ascending."""
    return unset_ids(id_bitmaps(saved), start_id, end_id)


def group_consecutive(ids: DataFrame) -> DataFrame:
    """Runs of consecutive ids as (start_id, end_id)."""
    return set_runs(id_bitmaps(ids))


def missing_ranges(saved: DataFrame, start_id: int, end_id: int) -> DataFrame:
    """Missing stretches of [start_id, end_id]; the missing ids themselves are never listed."""
    return unset_runs(id_bitmaps(saved), start_id, end_id)


def largest_ranges(ranges: DataFrame, n: int = 5) -> DataFrame:
    size = (F.col("end_id") - F.col("start_id") + 1).alias("size")
    return (ranges.select(size, "start_id", "end_id")
            .orderBy(F.desc("size"), F.desc("start_id"), F.desc("end_id")).limit(n))


def coverage_summary(saved: DataFrame, start_id: int, end_id: int) -> DataFrame:
    """One row; saved ids outside the range count as saved, so % may exceed 100."""
    total = end_id - start_id + 1
    in_range = F.count_if(F.col("query_id").between(start_id, end_id))
    return (
        saved.select("query_id").distinct()
        .agg(F.count("*").alias("saved_ids"), in_range.alias("in_range"))
        .select(F.lit(total).cast("long").alias("total_ids"), "saved_ids",
                (F.lit(total) - F.col("in_range")).alias("missing_ids"),
                percentage(F.col("saved_ids"), F.lit(total)).alias("percentage_saved"))
    )


def coverage_pie(saved: DataFrame, total_range: int) -> DataFrame:
    """Found and missing slices of the range, with their share."""
    total = F.lit(total_range)
    counted = saved.select("query_id").distinct().agg(F.count("*").alias("found"))
    slices = F.explode(F.array(
        F.struct(F.lit("Found").alias("slice"), F.col("found").alias("ids")),
        F.struct(F.lit("Missing").alias("slice"), (total - F.col("found")).alias("ids"))))
    return counted.select(slices.alias("s")).select(
        "s.slice", "s.ids", percentage(F.col("s.ids"), total).alias("share"))


def coverage_timeline(saved: DataFrame, total_range: int) -> DataFrame:
    """Cumulative coverage in % at every saved id."""
    return with_rank(saved).select(
        "query_id", (F.col("rank") / F.lit(total_range) * 100).alias("coverage_pct"))


def id_gaps(saved: DataFrame) -> DataFrame:
    """Distance of every id but the last to the next one."""
    return (with_next_id(saved).where(F.col("next_id").isNotNull())
            .select("query_id", (F.col("next_id") - F.col("query_id")).alias("gap")))


def gap_statistics(ids: DataFrame, total_range: int) -> DataFrame:
    """The 11 gap figures as one row; no row for no ids, null gaps for one id.

    The exact median is cheap: d distinct gaps need an id span of d*(d+1)/2, so
    the value counts kept for it grow with the square root of the range only.
    """
    gap = F.col("next_id") - F.col("query_id")
    over = [F.when(F.count(gap) > 0, F.count_if(gap > t)).alias(f"gaps_over_{t}")
            for t in (1, 10, 100)]
    return (
        with_next_id(ids)
        .agg(F.count("*").alias("total_ids"), F.min("query_id").alias("min_id"),
             F.max("query_id").alias("max_id"),
             (F.max("query_id") - F.min("query_id") + 1).alias("id_range_span"),
             F.avg(gap).alias("average_gap"), F.median(gap).alias("median_gap"),
             F.max(gap).alias("max_gap"), *over,
             percentage(F.count("*"), F.lit(total_range)).alias("coverage_percentage"))
        .where("total_ids > 0")
    )


def missing_gap_statistics(saved: DataFrame, start_id: int, end_id: int) -> DataFrame:
    """The same figures for the ids that are not there."""
    return gap_statistics(missing_ids(saved, start_id, end_id), end_id - start_id + 1)


def gap_histogram(ids: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over the gaps, the last one closed; empty bins included."""
    # few rows, as d distinct gaps need an id span of d * (d + 1) / 2; read four times
    frequencies = materialise(id_gaps(ids).groupBy("gap").agg(F.count("*").alias("n")), "gaps")
    same = F.min("gap") == F.max("gap")
    half = F.when(same, 0.5).otherwise(0.0)
    bounds = frequencies.agg(F.struct((F.min("gap") - half).alias("lo"),
                                      (F.max("gap") + half).alias("hi")))
    placed = frequencies.withColumn("b", bounds.scalar())
    width = F.col("b.hi") - F.col("b.lo")
    slot = F.floor((F.col("gap") - F.col("b.lo")) * bins / width)
    counted = (placed.groupBy(F.least(slot, F.lit(bins - 1)).cast("int").alias("bin"))
               .agg(F.sum("n").alias("frequency")))
    edges = (ids.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
             .withColumn("b", bounds.scalar()).where("b.lo IS NOT NULL"))

    def edge(k: Column) -> Column:
        return F.col("b.lo") + width * k / bins

    return edges.join(counted, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("lower"), edge(F.col("bin") + 1).alias("upper"),
        F.coalesce("frequency", F.lit(0)).alias("frequency"))


def _batch_columns(size: int, last: Column) -> list[Column]:
    end = F.least(F.col("batch_start") + (size - 1), last)
    name = F.concat(F.col("batch_start").cast("string"), F.lit("-"), end.cast("string"),
                    F.lit(".parquet"))
    return [F.col("batch_start"), end.alias("batch_end"), name.alias("file_name")]


def batch_plan(spark: SparkSession, start_id: int, end_id: int,
               batch_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """Fetch batches of a range with the file each one is saved to."""
    starts = spark.range(start_id, end_id + 1, batch_size).withColumnRenamed("id", "batch_start")
    return starts.select(*_batch_columns(batch_size, F.lit(end_id)))


def retry_plan(ranges: DataFrame, batch_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """Fetch batches of every missing range.

    A long range is cut twice, first into strides and then into batches, and
    spread out in between, so one huge range is not unrolled by one task.
    """
    stride = batch_size * 1000
    strides = (
        ranges.select(F.col("start_id").alias("range_start"), F.col("end_id").alias("range_end"),
                      F.explode(F.sequence("start_id", "end_id", F.lit(stride))).alias("first"))
        .withColumn("last", F.least(F.col("first") + (stride - 1), F.col("range_end")))
        .repartition("first")
    )
    batches = strides.withColumn(
        "batch_start", F.explode(F.sequence("first", "last", F.lit(batch_size))))
    return batches.select("range_start", "range_end",
                          *_batch_columns(batch_size, F.col("range_end")))


def retry_totals(ranges: DataFrame) -> DataFrame:
    """How many ranges and ids a retry run has to fetch."""
    return ranges.agg(
        F.count("*").alias("ranges"),
        F.coalesce(F.sum(F.col("end_id") - F.col("start_id") + 1), F.lit(0)).alias("ids_to_retry"))
