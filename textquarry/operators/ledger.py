"""Bookkeeping of a fetch run: outcome of every attempt, totals, resume point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.scores import backoff_delay

# Statuses and retry defaults of the fetch protocol.
OK_STATUS = 200
NOT_FOUND_STATUS = 404
RETRY_STATUSES = (429, 500, 502, 503, 504)
MAX_RETRIES = 3
BACKOFF_FACTOR = 2.0


def outcome(max_retries: int = MAX_RETRIES, retry_statuses: tuple[int, ...] = RETRY_STATUSES) -> Column:
    """What the attempt (``attempt``, ``status``) comes to: success, not_found, retry or failed."""
    status = F.col("status")
    retryable = status.isNull() | status.isin(*retry_statuses)
    return (F.when(status == OK_STATUS, "success")
            .when(status == NOT_FOUND_STATUS, "not_found")
            .when(retryable & (F.col("attempt") < max_retries), "retry")
            .otherwise("failed"))


def attempt_outcomes(attempts: DataFrame, max_retries: int = MAX_RETRIES,
                     backoff_factor: float = BACKOFF_FACTOR,
                     retry_statuses: tuple[int, ...] = RETRY_STATUSES) -> DataFrame:
    """Every attempt up to the first final one of its id, with outcome and delay.

    ``attempt`` is 0-based, a null ``status`` is a network error. Attempts after
    a final one, or beyond the retry limit, would not have been made.
    """
    judged = (attempts.where(F.col("attempt") <= max_retries)
              .withColumn("outcome", outcome(max_retries, retry_statuses)))
    final = judged.where(F.col("outcome") != "retry").groupBy("query_id").agg(
        F.min("attempt").alias("final_attempt"))
    delay = F.when(F.col("outcome") == "retry", backoff_delay(F.col("attempt"), backoff_factor))
    return (
        judged.join(final, "query_id", "left")
        .where(F.col("final_attempt").isNull() | (F.col("attempt") <= F.col("final_attempt")))
        .select("query_id", "attempt", "status", "outcome", delay.alias("delay"))
    )


def id_outcomes(attempts: DataFrame, max_retries: int = MAX_RETRIES,
                retry_statuses: tuple[int, ...] = RETRY_STATUSES) -> DataFrame:
    """Final outcome and attempts made per id; ids with no final attempt are absent."""
    judged = (attempts.where(F.col("attempt") <= max_retries)
              .withColumn("outcome", outcome(max_retries, retry_statuses)))
    return (judged.where(F.col("outcome") != "retry").groupBy("query_id")
            .agg(F.min(F.struct("attempt", "outcome")).alias("final"))
            .select("query_id", "final.outcome",
                    (F.col("final.attempt") + 1).cast("long").alias("attempts")))


def ledger_totals(outcomes: DataFrame, base_processed: int = 0) -> DataFrame:
    """Run totals as one row, of final outcomes (query_id, outcome, attempts)."""
    done = F.col("outcome") == "success"
    retries = F.greatest(F.col("attempts") - 1, F.lit(0))
    zero = F.lit(0)
    return (
        outcomes
        .agg(F.count("*").alias("n"), F.count_if(done).alias("success"),
             F.count_if(~done).alias("failed"),
             F.coalesce(F.sum(F.when(done, retries)), zero).alias("total_retried"),
             F.coalesce(F.sum(F.when(~done, retries)), zero).alias("failed_after_retry"),
             F.coalesce(F.sum("attempts"), zero).alias("total_attempts"))
        .withColumn("processed", F.col("n") + F.lit(base_processed))
        .select("processed", "success", "failed", "total_retried", "failed_after_retry",
                "total_attempts",
                F.when(F.col("processed") > 0, F.col("total_attempts") / F.col("processed"))
                .otherwise(F.lit(0.0)).alias("avg_attempts"))
    )


def fetch_ledger(attempts: DataFrame, base_processed: int = 0, **retry) -> DataFrame:
    """Run totals as one row. ``base_processed`` carries an earlier run's count."""
    return ledger_totals(id_outcomes(attempts, **retry), base_processed)


def high_water_mark(corpus: DataFrame, stored: int = 0) -> DataFrame:
    """Largest id seen so far, in the files or in the stored cursor."""
    return corpus.agg(F.greatest(F.coalesce(F.max("query_id"), F.lit(0)), F.lit(stored))
                      .cast("long").alias("total_processed"))


def resume_cursor(cursor: DataFrame, corpus: DataFrame, ledger: DataFrame) -> DataFrame:
    """Cursor to resume from: the larger of stored and seen id, successes of the ledger.

    Cursor and ledger are one row each.
    """
    mark = high_water_mark(corpus)
    return cursor.select(
        F.greatest("total_processed", mark.scalar()).alias("total_processed"),
        ledger.select("success").scalar().alias("total_success"), "total_failed", "last_run")


def incremental_rows(corpus: DataFrame, mark: int) -> DataFrame:
    """Rows above the high-water mark; the filter reaches the Parquet scan."""
    return corpus.where(F.col("query_id") > F.lit(mark))
