"""Reading corpora whose Parquet schema drifts from file to file.

File footers are read by Spark tasks, files with the same columns are read
together, and every group is cast to the canonical columns. So the number of
scans is the number of distinct schemas, and one bad file costs only itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from textquarry.functions.text import mask_literals, normalize_tags, normalize_text

# Columns of the corpus format, in order.
CORPUS_TYPES = {
    "query_id": "bigint",
    "name": "string",
    "description": "string",
    "tags": "array<string>",
    "owner": "string",
    "query_sql": "string",
}
MASKED_COLUMNS = ("query_id", "name", "description", "tags")
MASKED_LIMIT = 10

_FOOTER_SCHEMA = "path string, columns string, error string, row_groups int"
_PAGE_SCHEMA = "path string, row_group int, error string"
#: Rows that are decoded at a time where pages are only checked.
CHECKED_ROWS = 4096


def _opened(path: str, **options):
    """A Parquet file, with the footer read."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    filesystem, inner = pafs.LocalFileSystem(), path
    if ":/" in path:
        # only the root is a URI: names may hold blanks and percent signs
        scheme, inner = path.split(":/", 1)
        authority, inner = inner[1:].split("/", 1) if inner.startswith("/") else ("", inner)
        filesystem, root = pafs.FileSystem.from_uri(f"{scheme}://{authority}/")
        inner = f"{root.rstrip('/')}/{inner}"
    return pq.ParquetFile(inner, filesystem=filesystem, **options)


def _read_footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Column names and types of each file, or why its footer cannot be read."""
    for batch in batches:
        found = []
        for path in batch["path"]:
            try:
                with _opened(path) as file:
                    columns = ",".join(sorted(f"{f.name} {f.type}" for f in file.schema_arrow))
                    found.append((path, columns, None, file.metadata.num_row_groups))
            except Exception as problem:  # any unreadable file is reported, not fatal
                found.append((path, None, type(problem).__name__, 0))
        yield pd.DataFrame(found, columns=["path", "columns", "error", "row_groups"])


def _check_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decode every page of each row group, and say why one cannot be."""
    for batch in batches:
        found = []
        for path, group in zip(batch["path"], batch["row_group"]):
            error = None
            try:
                with _opened(path, page_checksum_verification=True) as file:
                    for _ in file.iter_batches(batch_size=CHECKED_ROWS, row_groups=[group]):
                        pass
            except Exception as problem:  # reported, not fatal
                error = type(problem).__name__
            found.append((path, group, error))
        yield pd.DataFrame(found, columns=["path", "row_group", "error"])


def load_report(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """One row per Parquet file: path, columns, and the error of unreadable ones.

    Folders below the directory are left out unless ``recursive`` is set, and so are
    files of no bytes, which Spark does not list.
    """
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", str(recursive).lower()).load(directory)
        .where(F.col("length") >= 0).select("path")
    )
    return footer_report(listed)


def footer_report(listed: DataFrame) -> DataFrame:
    """(path, columns, error, row_groups) of the files (path)."""
    return listed.mapInPandas(_read_footers, _FOOTER_SCHEMA)


def page_report(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """(path, row_group, error): one row per row group after decoding all its pages.

    Row groups are dealt over the tasks, so a large file is checked by many. A file
    whose footer cannot be read has one row without a row group; one without row groups
    has none.
    """
    footers = load_report(spark, directory, recursive)
    groups = footers.where((F.col("error").isNull()) & (F.col("row_groups") > 0)).select(
        "path", F.explode(F.sequence(F.lit(0), F.col("row_groups") - 1)).alias("row_group"))
    unread = footers.where(F.col("error").isNotNull()).select(
        "path", F.lit(None).cast("int").alias("row_group"), "error")
    return groups.repartition("path", "row_group").mapInPandas(_check_pages, _PAGE_SCHEMA).unionByName(unread)


@dataclass(frozen=True)
class FileGroup:
    """Files that share one set of columns."""

    columns: frozenset[str]
    paths: tuple[str, ...]


def file_groups(spark: SparkSession, directory: str, verify: bool = False) -> list[FileGroup]:
    """Readable files by schema. Only paths reach the driver, as for any file scan.

    ``verify`` leaves out files with a page that cannot be decoded, at the price of
    reading everything once more.
    """
    readable = load_report(spark, directory).where("error IS NULL")
    if verify:
        bad = page_report(spark, directory).where("error IS NOT NULL").select("path").distinct()
        readable = readable.join(bad, "path", "left_anti")
    return grouped_files(readable)


def grouped_files(readable: DataFrame) -> list[FileGroup]:
    """Files (path, columns) by schema."""
    rows = (readable.orderBy("columns", "path").select("columns", "path").toLocalIterator())
    by_schema: dict[str, list[str]] = {}
    for row in rows:
        by_schema.setdefault(row["columns"], []).append(row["path"])
    return [
        FileGroup(frozenset(part.split(" ", 1)[0] for part in columns.split(",")), tuple(paths))
        for columns, paths in by_schema.items()
    ]


def _select_cast(frame: DataFrame, wanted: dict[str, str]) -> DataFrame:
    present = set(frame.columns)
    return frame.select(*[
        (F.col(name) if name in present else F.lit(None)).try_cast(kind).alias(name)
        for name, kind in wanted.items()
    ])


def _empty(spark: SparkSession, wanted: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in wanted.items()))


def read_reconciled(spark: SparkSession, directory: str, columns: tuple[str, ...] | None = None,
                    required: tuple[str, ...] = ("query_id",), verify: bool = False) -> DataFrame:
    """Union of all readable files that have the required columns, raw values.
    With ``verify``, files with damaged pages count as unreadable too.

    A column a file lacks, or holds only nulls in, comes out null, as does a value
    that is not of the column's kind. An ``owner``
    or ``query_sql`` the file lacks comes out empty, as the format defines.
    """
    return read_groups(spark, file_groups(spark, directory, verify), columns, required)


def read_groups(spark: SparkSession, groups: list[FileGroup], columns: tuple[str, ...] | None = None,
                required: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """As :func:`read_reconciled`, of files whose schemas are known."""
    wanted = {n: t for n, t in CORPUS_TYPES.items() if columns is None or n in columns}
    result: DataFrame | None = None
    for group in groups:
        if not set(required) <= group.columns:
            continue
        frame = _select_cast(spark.read.parquet(*group.paths), wanted)
        absent = [n for n in ("owner", "query_sql") if n in wanted and n not in group.columns]
        frame = frame.withColumns({n: F.lit("") for n in absent})
        result = frame if result is None else result.unionByName(frame)
    return _empty(spark, wanted) if result is None else result


def canonicalise(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical corpus rows: normalised name, description and tags; rest as is.

    Columns named in ``keep`` stay beside the canonical ones.
    """
    expressions: dict[str, Column] = {
        "query_id": F.col("query_id").cast("bigint"),
        "name": normalize_text(F.col("name")),
        "description": normalize_text(F.col("description")),
        "tags": normalize_tags(F.col("tags")),
        "owner": F.col("owner"),
        "query_sql": F.col("query_sql"),
    }
    return raw.select(*[expr.alias(name) for name, expr in expressions.items()], *keep)


def limited(corpus: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows in corpus order; 0 and None mean all."""
    return corpus.orderBy("query_id").limit(limit) if limit else corpus


def load_corpus(spark: SparkSession, directory: str, limit: int | None = None,
                verify: bool = False) -> DataFrame:
    """The corpus of a directory in canonical form; ``verify`` skips files with damaged pages."""
    return canonicalise(limited(read_reconciled(spark, directory, verify=verify), limit))


def load_saved_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Distinct ids over all files that have the id column; only it is read."""
    return read_reconciled(spark, directory, ("query_id",)).where(
        F.col("query_id").isNotNull()).distinct()


def _pushing(spark: SparkSession, push: bool) -> SparkSession:
    """A session beside the given one that answers minima and maxima from Parquet footers."""
    beside = spark.newSession()
    if push:
        beside.conf.set("spark.sql.sources.useV1SourceList", "")
        beside.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return beside


def largest_id(spark: SparkSession, paths: tuple[str, ...], push: bool = True) -> DataFrame:
    """(id): the largest id of files of one schema, from their footers where ``push`` is set."""
    frame = _pushing(spark, push).read.parquet(*paths)
    whole = isinstance(frame.schema["query_id"].dataType, IntegralType)
    return frame.agg((F.max("query_id") if whole else F.max(F.col("query_id").try_cast("bigint"))).alias("id"))


def footer_high_water_mark(spark: SparkSession, directory: str, stored: int = 0) -> int:
    """Largest id of a folder's files, or the stored one, without reading any row.

    Files whose footers hold no statistics are scanned, together with those of their schema.
    """
    mark = stored
    for group in file_groups(spark, directory):
        if "query_id" not in group.columns:
            continue
        try:
            found = largest_id(spark, group.paths).first()["id"]
        except (PySparkException, Py4JJavaError) as error:
            if "No min/max found" not in str(error):
                raise
            found = largest_id(spark, group.paths, push=False).first()["id"]
        mark = max(mark, found if found is not None else mark)
    return mark


def masked_rows(raw: DataFrame, limit: int = MASKED_LIMIT) -> DataFrame:
    """Id, literal-masked name and description, tags, for the first ``limit`` rows."""
    rows = raw.orderBy("query_id").limit(limit)
    return rows.select(
        "query_id", mask_literals(F.col("name")).alias("name"),
        mask_literals(F.col("description")).alias("description"),
        normalize_tags(F.col("tags")).alias("tags"))


def load_masked_sample(spark: SparkSession, directory: str,
                       limit: int = MASKED_LIMIT) -> DataFrame:
    """As :func:`masked_rows`, from the files that have all four columns."""
    return masked_rows(read_reconciled(spark, directory, MASKED_COLUMNS, MASKED_COLUMNS), limit)
