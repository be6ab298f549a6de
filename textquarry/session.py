"""Session settings and the shared folder for checkpoints and scratch output."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import textquarry

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Shuffle files go at the end of the query that made them (Spark 4.1; else when the driver collects garbage).
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the adaptive settings the operators count on."""
    builder = (
        SparkSession.builder.appName("textquarry")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_code() -> None:
    """Send this package's functions to the workers by value.

    So it need not be installed there, nor be the working directory.
    """
    cloudpickle.register_pickle_by_value(textquarry)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named (tests)."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    own = tempfile.mkdtemp(prefix="textquarry-")
    spark.conf.set(CHECKPOINT_CONF, own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(frame: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """The frame as a table in the shared folder, read back.

    Cuts the lineage so that it survives lost executors, and replaces size
    estimates, which multiply with every join of a loop, by real file sizes. What was
    shuffled to make it is deleted once it is written; texts are best stored as ``zstd``.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        frame.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)
    stored = spark.read.schema(frame.schema).parquet(path)
    stored.scratch = [path]
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing made from them will read again.

    Frames that are not stored are passed over.
    """
    for frame in stored:
        spark = frame.sparkSession
        for name in frame.__dict__.get("scratch", []):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
