"""Every operator as a named query over the test tables.

Results are made comparable with SQL: lists become text joined by '|', and
floating-point values are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from textquarry.functions import text
from textquarry.operators import (
    arrivals, coverage, density, duplicates, embedding, layout, ledger, metrics, near, placing, profiles, tags)
from textquarry.plans import clustering, tables
from textquarry.session import scratch_path, ship_code
from textquarry.sources import corpus as source
from textquarry.sources import cursor as cursors
from textquarry.sources import sinks
from textquarry.streaming.attempts import keep_ledger, kept_ledger
from textquarry.streaming.incremental import ingest_drifting_files, ingest_new_files, ingested

Query = Callable[[SparkSession, str], DataFrame]

LOAD_LIMIT = 100
BATCH = 2000


def flat(frame: DataFrame) -> DataFrame:
    """Lists as text, doubles rounded, minus zero as zero."""
    columns: list[Column] = []
    for field in frame.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, ArrayType):
            column = F.array_join(column, "|")
        elif isinstance(field.dataType, DoubleType):
            column = F.round(column, 6) + F.lit(0.0)
        columns.append(column.alias(field.name))
    return frame.select(*columns)


def _text_query(expression: Callable[[], Column], view=tables.corpus) -> Query:
    return lambda spark, sf: view(spark, sf).select("query_id", expression().alias("text"))


def _document_text(expression: Callable[[Column], Column]) -> Query:
    return lambda spark, sf: tables.table(spark, sf, "documents").select(
        F.col("doc_id").alias("query_id"), expression(F.col("text")).alias("text"))


def _sql_text(expression: Callable[[Column], Column]) -> Query:
    return lambda spark, sf: tables.sql_texts(spark, sf).select(
        "query_id", expression(F.col("query_sql")).alias("text"))


# --- sources -----------------------------------------------------------------

def load_corpus(spark, sf):
    return source.load_corpus(spark, tables.write_drifting(spark, sf))


def load_corpus_limit(spark, sf):
    return source.load_corpus(spark, tables.write_drifting(spark, sf), limit=LOAD_LIMIT)


def load_masked_sample(spark, sf):
    return source.load_masked_sample(spark, tables.write_drifting(spark, sf), limit=LOAD_LIMIT)


def load_report(spark, sf):
    report = source.load_report(spark, tables.write_drifting(spark, sf))
    return report.select("columns", "error").distinct()


def saved_ids(spark, sf):
    return source.load_saved_ids(spark, tables.write_drifting(spark, sf))


def high_water_mark(spark, sf):
    return ledger.high_water_mark(tables.corpus(spark, sf))


def high_water_mark_footers(spark, sf):
    mark = source.footer_high_water_mark(spark, tables.write_drifting(spark, sf))
    return spark.range(1).select(F.lit(mark).cast("long").alias("total_processed"))


def fetch_ledger_stream(spark, sf):
    """The attempts in two deliveries, later ones first, the stream run after each."""
    arrived, target, log = (scratch_path(spark, n) for n in ("arrived", "settled", "progress"))
    attempts = tables.timed_attempts(spark, sf)
    for late in (True, False):
        attempts.where((F.col("attempt") > 1) == late).write.parquet(f"{arrived}/{late}")
        # the first attempts come up to the whole length of the log after the last
        keep_ledger(spark, arrived, target, log, delay="100 years").awaitTermination()
    return kept_ledger(spark, target)


def _ledger_cursor(spark, sf):
    run = ledger.fetch_ledger(tables.attempts(spark, sf))
    return run.select(F.col("processed").alias("total_processed"),
                      F.col("success").alias("total_success"),
                      F.col("failed").alias("total_failed"))


def _stored_cursor(spark, sf) -> str:
    path = scratch_path(spark, "cursor")
    cursors.write_cursor(_ledger_cursor(spark, sf), path)
    return path


def load_cursor(spark, sf):
    return cursors.load_cursor(spark, _stored_cursor(spark, sf)).drop("last_run")


def write_cursor(spark, sf):
    stored = spark.read.json(_stored_cursor(spark, sf))
    shape = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}$"
    return stored.select("total_processed", "total_success", "total_failed",
                         F.col("last_run").rlike(shape).alias("has_last_run"))


def resume_cursor(spark, sf):
    stored = cursors.load_cursor(spark, _stored_cursor(spark, sf))
    run = ledger.fetch_ledger(tables.attempts(spark, sf))
    return ledger.resume_cursor(stored, tables.corpus(spark, sf), run).drop("last_run")


def incremental_rows(spark, sf):
    stored = cursors.load_cursor(spark, _stored_cursor(spark, sf)).first()
    return ledger.incremental_rows(tables.sql_texts(spark, sf), stored["total_processed"]).select(
        "query_id", "query_sql")


def incremental_stream(spark, sf):
    """Two deliveries of files, the stream run after each."""
    arrived, target, log = (scratch_path(spark, n) for n in ("arrived", "ingested", "progress"))
    raw = tables.raw_documents(spark, sf).drop("cluster")
    first = F.col("description").isNull()
    for name, part in (("first", raw.where(first)), ("second", raw.where(~first))):
        part.write.parquet(f"{arrived}/{name}")
        ingest_new_files(spark, arrived, target, log).awaitTermination()
    return spark.read.parquet(target)


def incremental_stream_drifting(spark, sf):
    """Two deliveries of files with different columns, the stream run after each."""
    arrived, target, log = (scratch_path(spark, n) for n in ("arrived", "ingested", "progress"))
    raw = tables.raw_documents(spark, sf).drop("cluster")
    first = F.col("description").isNull()
    for name, part in (("first", raw.where(first).drop("description")), ("second", raw.where(~first))):
        part.write.parquet(f"{arrived}/{name}")
        ingest_drifting_files(spark, arrived, target, log).awaitTermination()
    return ingested(spark, target)


# --- sinks, read back --------------------------------------------------------

def write_corpus(spark, sf):
    path = scratch_path(spark, "corpus")
    sinks.write_corpus(tables.corpus(spark, sf), path)
    return spark.read.parquet(path)


def write_clustered(spark, sf):
    path = scratch_path(spark, "clustered")
    sinks.write_clustered(tables.clustered(spark, sf), path)
    return spark.read.parquet(path)


def write_by_cluster(spark, sf):
    path = scratch_path(spark, "by-cluster")
    sinks.write_by_cluster(tables.clustered(spark, sf), path)
    return spark.read.parquet(path)


def write_cluster_stats(spark, sf):
    path = scratch_path(spark, "cluster-stats")
    sinks.write_cluster_stats(profiles.cluster_profile(tables.clustered(spark, sf)), path)
    read = (spark.read.option("header", "true").option("escape", '"')
            .schema("cluster_id int, size bigint, top_tags string, sample_names string, "
                    "avg_name_length double").csv(path))
    lists = [F.from_json(c, "array<string>").alias(c) for c in ("top_tags", "sample_names")]
    return read.select("cluster_id", "size", *lists, "avg_name_length")


def write_keywords(spark, sf):
    path = scratch_path(spark, "keywords")
    sinks.write_keywords(profiles.cluster_keywords(tables.clustered(spark, sf), "semantic"), path)
    entry = F.from_json("value", "map<string,array<string>>")
    return (spark.read.text(path).select(F.explode(entry).alias("cluster", "keywords"))
            .select(F.col("cluster").cast("int").alias("cluster"), "keywords"))


def write_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    points = tables.points(spark, sf)
    sinks.write_metrics(metrics.cluster_metrics(points), metrics.cluster_tightness(points), path)
    return spark.read.json(f"{path}/record")


def write_tags(spark, sf):
    path = scratch_path(spark, "tags")
    sinks.write_tags(tags.tag_counts(tables.baskets(spark, sf)), path)
    return spark.read.parquet(path)


def write_tags_tsv(spark, sf):
    path = scratch_path(spark, "tags-tsv")
    sinks.write_tags_tsv(tags.tag_counts(tables.baskets(spark, sf)), path)
    return (spark.read.option("sep", "\t").option("header", "true").schema(
        "TAG string, COUNT bigint").csv(path)
        .select(F.col("TAG").alias("tag"), F.col("COUNT").alias("count")))


def write_cooccurrence_tsv(spark, sf):
    path = scratch_path(spark, "pairs-tsv")
    pairs = tags.tag_cooccurrence(tables.corpus(spark, sf), 20)
    sinks.write_cooccurrence_tsv(pairs, path)
    return (spark.read.option("sep", "\t").option("header", "true").option("emptyValue", "")
            .schema("tag1 string, tag2 string, count bigint").csv(path)
            .na.fill("", ["tag1", "tag2"]))


def write_duplicates(spark, sf):
    path = scratch_path(spark, "duplicates")
    rows = duplicates.find_duplicates(tables.sql_texts(spark, sf).drop("cluster"), "sql")
    sinks.write_duplicates(rows, path, "sql")
    return spark.read.parquet(f"{path}/duplicates_sql.parquet").select("query_id", "hash")


def write_deduplicated(spark, sf):
    path = scratch_path(spark, "deduplicated")
    sinks.write_deduplicated(duplicates.remove_duplicates(tables.corpus(spark, sf)), path)
    return spark.read.parquet(path)


def write_cluster_state(spark, sf):
    path = scratch_path(spark, "state")
    sinks.write_cluster_state(tables.points(spark, sf).select("query_id", "v", "cluster"), path)
    return spark.read.parquet(path).select(
        "query_id", "cluster", F.size("v").alias("dimensions"),
        F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x).alias("total"))


# --- text --------------------------------------------------------------------

def blank_text_count(spark, sf):
    rows = tables.corpus(spark, sf)
    return rows.agg(F.count_if(text.is_blank(F.col("description"))).alias("blank_descriptions"),
                    F.count_if(text.is_blank(text.text_semantic())).alias("blank_semantic"),
                    F.count_if(text.is_blank(text.text_sql())).alias("blank_sql"))


def fn_normalize_tags(spark, sf):
    return tables.baskets(spark, sf).select(
        "query_id", text.normalize_tags(F.col("tags")).alias("tags"))


def fn_euclidean(spark, sf):
    return metrics.centroid_distances(tables.points(spark, sf)).select(
        "query_id", "cluster", "distance")


# --- ranges ------------------------------------------------------------------

def _with_range(operator: Callable[..., DataFrame], view=tables.line_ids,
                bounds=tables.order_range) -> Query:
    def run(spark, sf):
        start, end = bounds(spark, sf)
        return operator(coverage.saved_ids(view(spark, sf)), start, end)
    return run


def _with_total(operator: Callable[..., DataFrame], view=tables.line_ids,
                bounds=tables.order_range) -> Query:
    return _with_range(lambda ids, start, end: operator(ids, end - start + 1), view, bounds)


def batch_plan(spark, sf):
    start, end = tables.order_range(spark, sf)
    return coverage.batch_plan(spark, start, end)


def retry_plan(ids, start, end):
    return coverage.retry_plan(coverage.missing_ranges(ids, start, end), BATCH)


def _labelled(operator):
    return operator, tables.labelled_ids, tables.document_range


# --- clusters ----------------------------------------------------------------

def near_duplicates(spark, sf):
    """Over whole texts: the documents as query texts."""
    rows = tables.table(spark, sf, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("query_sql"))
    return near.near_duplicates(rows)


def duplicates_arriving(spark, sf):
    """Repeated hashes after all texts have arrived, in three deliveries."""
    rows = tables.sql_texts(spark, sf)
    folder, known = scratch_path(spark, "digests"), None
    # every row is in one of the three
    for n in range(3):
        version = arrivals.DigestTable(f"{folder}/{n}", buckets=8)
        arrivals.take_in(rows.where(F.pmod("query_id", F.lit(3)) == n), version, known)
        known = version
    return known.read(spark).where("copies > 1")


def attach_labels(spark, sf):
    labels = tables.raw_documents(spark, sf).select("query_id", "cluster")
    return profiles.attach_labels(tables.corpus(spark, sf), labels).select(
        "query_id", "name", "cluster")


def cluster_summary(spark, sf):
    return profiles.cluster_summary(profiles.cluster_profile(tables.clustered(spark, sf)))


def embed_text(spark, sf):
    embedded = embedding.embed_text(tables.corpus(spark, sf), "semantic")
    return embedded.select("query_id", F.size("v").alias("dimensions"), F.sqrt(F.aggregate(
        "v", F.lit(0.0), lambda acc, x: acc + x * x)).alias("length"))


def encode_by_model(spark, sf):
    path = scratch_path(spark, "projection")
    embedding.save_projection(spark, path)
    texts = embedding.mode_texts(tables.corpus(spark, sf), "semantic")
    return embedding.encode_by_model(texts, path, embedding.load_projection)


def neighbour_graph(spark, sf):
    sites = density.distinct_sites(tables.points(spark, sf))
    return layout.neighbour_graph(sites).select(
        F.col("site").alias("query_id"), F.col("neighbour").alias("neighbour_id"), "place")


def neighbour_layout(spark, sf):
    return layout.lay_out(tables.points(spark, sf).select("query_id", "v"))


def reduce_dimensions(spark, sf):
    points = tables.points(spark, sf).select("query_id", "v")
    return embedding.reduce_dimensions(points)


def kmeans_labels(spark, sf):
    return embedding.kmeans_labels(tables.points(spark, sf))


def density_clusters(spark, sf):
    return density.density_clusters(tables.points(spark, sf).select("query_id", "v"))


def place_points(spark, sf):
    """Every point, moved a little, in the stored clustering of all points."""
    points = tables.points(spark, sf).select("query_id", "v")
    path = scratch_path(spark, "index")
    placing.index_clustering(*density.fit_density(points)).save(path)
    moved = points.withColumn("v", F.transform("v", lambda x: x + F.lit(0.001)))
    return placing.place_points(moved, placing.load_index(spark, path)).select("query_id", "cluster")


def score_corpus(spark, sf):
    """The whole corpus, scored by the reloaded models of its own run, against that run."""
    corpus = tables.corpus(spark, sf)
    run = clustering.cluster_corpus(corpus, "semantic")
    path = scratch_path(spark, "models")
    clustering.save_models(run.models, path)
    scored = clustering.score_corpus(clustering.load_models(spark, path), corpus)
    own = run.clustered.select("query_id", F.col("cluster").alias("own"))
    return scored.join(own, "query_id").select("query_id", (F.col("cluster") == F.col("own")).alias("same_cluster"))


def cluster_corpus(spark, sf):
    return clustering.cluster_corpus(tables.corpus(spark, sf), "semantic").profile


def _on_points(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(tables.points(spark, sf))


def _on_clustered(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(tables.clustered(spark, sf))


def _on_baskets(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(tables.baskets(spark, sf))


def _on_hashed(operator: Callable[[DataFrame], DataFrame], mode: str) -> Query:
    view = tables.sql_texts if mode == "sql" else tables.corpus
    return lambda spark, sf: operator(duplicates.hashed(view(spark, sf), mode))


def _deduplicated(mode: str) -> Query:
    return lambda spark, sf: duplicates.remove_duplicates(
        tables.sql_texts(spark, sf), mode).select("query_id", "query_sql")


QUERIES: dict[str, Query] = {
    "load_corpus": load_corpus,
    "load_corpus_limit": load_corpus_limit,
    "load_masked_sample": load_masked_sample,
    "load_report": load_report,
    "saved_ids": saved_ids,
    "high_water_mark": high_water_mark,
    "high_water_mark_footers": high_water_mark_footers,
    "load_cursor": load_cursor,
    "write_cursor": write_cursor,
    "resume_cursor": resume_cursor,
    "incremental_rows": incremental_rows,
    "incremental_stream": incremental_stream,
    "incremental_stream_drifting": incremental_stream_drifting,
    "write_corpus": write_corpus,
    "write_clustered": write_clustered,
    "write_by_cluster": write_by_cluster,
    "write_cluster_stats": write_cluster_stats,
    "write_keywords": write_keywords,
    "write_metrics": write_metrics,
    "write_tags": write_tags,
    "write_tags_tsv": write_tags_tsv,
    "write_cooccurrence_tsv": write_cooccurrence_tsv,
    "write_duplicates": write_duplicates,
    "write_deduplicated": write_deduplicated,
    "write_cluster_state": write_cluster_state,
    "text_semantic": _text_query(text.text_semantic),
    "text_sql": _text_query(text.text_sql, tables.sql_texts),
    "dedup_text_semantic": _text_query(lambda: text.dedup_text("semantic")),
    "dedup_text_sql": _text_query(lambda: text.dedup_text("sql"), tables.sql_texts),
    "keyword_text_semantic": _text_query(lambda: text.keyword_text("semantic")),
    "keyword_text_sql": _text_query(lambda: text.keyword_text("sql")),
    "blank_text_count": blank_text_count,
    "fn_normalize_text": _document_text(text.normalize_text),
    "fn_clean_sql": _sql_text(text.clean_sql),
    "fn_normalize_sql": _sql_text(text.normalize_sql),
    "fn_normalize_sql_documents": _document_text(text.normalize_sql),
    "fn_hash": _document_text(text.text_hash),
    "fn_mask_literals": _sql_text(text.mask_literals),
    "fn_mask_literals_documents": _document_text(text.mask_literals),
    "fn_normalize_tags": fn_normalize_tags,
    "fn_tokens": _document_text(text.tokens),
    "fn_euclidean": fn_euclidean,
    "missing_ids": _with_range(coverage.missing_ids),
    "missing_ranges": _with_range(coverage.missing_ranges),
    "consecutive_ranges": lambda spark, sf: coverage.group_consecutive(tables.line_ids(spark, sf)),
    "largest_missing_ranges": _with_range(
        lambda ids, s, e: coverage.largest_ranges(coverage.missing_ranges(ids, s, e))),
    "coverage_summary": _with_range(coverage.coverage_summary),
    "coverage_pie": _with_total(coverage.coverage_pie),
    "coverage_timeline": _with_total(coverage.coverage_timeline),
    "id_gaps": lambda spark, sf: coverage.id_gaps(tables.line_ids(spark, sf)),
    "gap_statistics": _with_total(coverage.gap_statistics),
    "gap_statistics_labels": _with_total(*_labelled(coverage.gap_statistics)),
    "missing_gap_statistics": _with_range(*_labelled(coverage.missing_gap_statistics)),
    "gap_histogram": lambda spark, sf: coverage.gap_histogram(tables.labelled_ids(spark, sf)),
    "batch_plan": batch_plan,
    "retry_plan": _with_range(retry_plan),
    "retry_totals": _with_range(
        lambda ids, s, e: coverage.retry_totals(coverage.missing_ranges(ids, s, e))),
    "attempt_outcomes": lambda spark, sf: ledger.attempt_outcomes(tables.attempts(spark, sf)),
    "fetch_ledger_stream": fetch_ledger_stream,
    "fetch_ledger": lambda spark, sf: ledger.fetch_ledger(tables.attempts(spark, sf)),
    "tag_counts": _on_baskets(tags.tag_counts),
    "tag_statistics": _on_baskets(tags.tag_statistics),
    "frequent_pairs": lambda spark, sf: tags.frequent_pairs(tables.corpus(spark, sf), 20),
    "tag_cooccurrence": lambda spark, sf: tags.tag_cooccurrence(
        tables.baskets(spark, sf).withColumn("tags", text.normalize_tags(F.col("tags"))), 20),
    "top_tags_share": _on_baskets(tags.top_tags_share),
    "chart_top_tags": _on_baskets(tags.chart_top_tags),
    "chart_tag_share": _on_baskets(tags.chart_tag_share),
    "duplicates_sql": _on_hashed(
        lambda rows: duplicates.duplicates_of(rows).select("query_id", "normalized_text", "hash"),
        "sql"),
    "duplicates_semantic": _on_hashed(
        lambda rows: duplicates.duplicates_of(rows).select("query_id", "normalized_text", "hash"),
        "semantic"),
    "duplicates_structure": lambda spark, sf: duplicates.structural_duplicates(
        tables.sql_texts(spark, sf)).select("query_id", "normalized_text", "hash"),
    "duplicate_groups_sql": _on_hashed(duplicates.duplicate_groups, "sql"),
    "duplicate_groups_semantic": _on_hashed(duplicates.duplicate_groups, "semantic"),
    "duplicate_group_owners_sql": _on_hashed(duplicates.group_owners, "sql"),
    "duplicate_group_owners_semantic": _on_hashed(duplicates.group_owners, "semantic"),
    "top_duplicate_groups_sql": _on_hashed(duplicates.top_duplicate_groups, "sql"),
    "top_duplicate_groups_semantic": _on_hashed(duplicates.top_duplicate_groups, "semantic"),
    "duplicate_summary_sql": _on_hashed(duplicates.duplicate_summary, "sql"),
    "duplicate_summary_semantic": _on_hashed(duplicates.duplicate_summary, "semantic"),
    "deduplicated_exact": _deduplicated("exact"),
    "deduplicated_hash": _deduplicated("hash"),
    "deduplicated_structure": _deduplicated("structure"),
    "duplication_by_cluster": lambda spark, sf: duplicates.duplication_by_cluster(
        tables.sql_texts(spark, sf)),
    "duplicates_arriving": duplicates_arriving,
    "near_duplicates": near_duplicates,
    "attach_labels": attach_labels,
    "cluster_profile": _on_clustered(profiles.cluster_profile),
    "cluster_summary": cluster_summary,
    "cluster_top_tags": _on_clustered(profiles.cluster_top_tags),
    "cluster_sample_names": _on_clustered(profiles.cluster_sample_names),
    "cluster_keywords_sql": _on_clustered(lambda c: profiles.cluster_keywords(c, "sql")),
    "cluster_keywords_semantic": _on_clustered(lambda c: profiles.cluster_keywords(c, "semantic")),
    "cluster_counts": _on_clustered(metrics.cluster_counts),
    "label_contingency": _on_points(metrics.label_contingency),
    "cluster_tightness": _on_points(metrics.cluster_tightness),
    "tightest_clusters": _on_points(metrics.tightest_clusters),
    "silhouette": _on_points(metrics.silhouette),
    "davies_bouldin": _on_points(metrics.davies_bouldin),
    "calinski_harabasz": _on_points(metrics.calinski_harabasz),
    "homogeneity": _on_points(lambda p: metrics.label_agreement(p).select("homogeneity_score")),
    "completeness": _on_points(lambda p: metrics.label_agreement(p).select("completeness_score")),
    "v_measure": _on_points(lambda p: metrics.label_agreement(p).select("v_measure_score")),
    "cluster_metrics": _on_points(metrics.cluster_metrics),
    "assessment": _on_points(lambda p: metrics.assessment(metrics.cluster_metrics(p))),
    "embed_text": embed_text,
    "encode_by_model": encode_by_model,
    "reduce_dimensions": reduce_dimensions,
    "neighbour_graph": neighbour_graph,
    "neighbour_layout": neighbour_layout,
    "kmeans_labels": kmeans_labels,
    "density_clusters": density_clusters,
    "cluster_corpus": cluster_corpus,
    "place_points": place_points,
    "score_corpus": score_corpus,
}


def _comparable(query: Query) -> Query:
    return lambda spark, sf: flat(query(spark, sf))


def all_queries() -> dict[str, Query]:
    ship_code()
    return {name: _comparable(query) for name, query in QUERIES.items()}
