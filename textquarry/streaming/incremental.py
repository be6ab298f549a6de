"""Taking in corpus files as they arrive: the streaming form of the resume cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textquarry.sources.corpus import (
    CORPUS_TYPES, canonicalise, footer_report, grouped_files, read_groups)

_LISTED = "path string, modificationTime timestamp, length bigint, content binary"
RAW_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in CORPUS_TYPES.items())


def arriving_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """Canonical rows of files new since the last run of the stream's checkpoint.

    This stream reads one schema: columns a file lacks come out null. Files whose
    types drift are for :func:`ingest_drifting_files`.
    """
    raw = (spark.readStream.schema(RAW_SCHEMA).option("recursiveFileLookup", "true")
           .parquet(directory))
    return canonicalise(raw)


def ingest_new_files(spark: SparkSession, directory: str, target: str,
                     checkpoint: str) -> StreamingQuery:
    """Append everything that arrived since the last call to ``target``, then stop."""
    return (arriving_corpus(spark, directory).writeStream.format("parquet")
            .option("path", target).option("checkpointLocation", checkpoint)
            .option("compression", "zstd").outputMode("append")
            .trigger(availableNow=True).start())


def ingest_drifting_files(spark: SparkSession, directory: str, target: str, checkpoint: str,
                          files_per_batch: int = 1000) -> StreamingQuery:
    """Take in everything that arrived since the last call, whatever its columns, then stop.

    The stream is one of file names. Each micro-batch reads the footers of its files in
    tasks, reads files of one schema together, and writes the canonical rows as
    ``batch=<id>`` below ``target``. A batch that is played again replaces what it had
    written. Unreadable files, and those without ids, are passed over as in a batch load.
    """

    def take_in(listed: DataFrame, batch: int) -> None:
        session = listed.sparkSession
        readable = footer_report(listed.select("path")).where("error IS NULL")
        rows = canonicalise(read_groups(session, grouped_files(readable)))
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/batch={batch}")

    arriving = (spark.readStream.format("binaryFile").schema(_LISTED).option("pathGlobFilter", "*.parquet")
                .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
                .load(directory).select("path"))
    return (arriving.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """The canonical rows that :func:`ingest_drifting_files` has written."""
    return spark.read.parquet(target).drop("batch")
