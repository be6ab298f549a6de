"""The fetch cursor: three counters and the time of the last run, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of the cursor file.
CURSOR_SCHEMA = ("total_processed bigint, total_success bigint, total_failed bigint, "
                 "last_run string")


def default_cursor(spark: SparkSession) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return spark.range(1).select(
        zero.alias("total_processed"), zero.alias("total_success"), zero.alias("total_failed"),
        F.lit(None).cast("string").alias("last_run"))


def load_cursor(spark: SparkSession, path: str | None) -> DataFrame:
    """The stored cursor laid over the defaults; the defaults alone for no path."""
    if path is None:
        return default_cursor(spark)
    stored = (spark.read.schema(CURSOR_SCHEMA).option("multiLine", "true").json(path)
              .agg(*[F.max(c).alias(c) for c in
                     ("total_processed", "total_success", "total_failed", "last_run")]))
    counters = [F.coalesce(c, F.lit(0)).alias(c)
                for c in ("total_processed", "total_success", "total_failed")]
    return stored.select(*counters, "last_run")


def write_cursor(cursor: DataFrame, path: str) -> None:
    """Store the counters with the present UTC time as ``last_run``."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    cursor.withColumn("last_run", now).coalesce(1).write.mode("overwrite").json(path)
