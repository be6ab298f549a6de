"""The clustering run from corpus to report, and its saved form."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import IDFModel, PCAModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.text import check_mode, embedding_text
from textquarry.operators import embedding, metrics, profiles
from textquarry.operators.density import (
    MIN_CLUSTER_SIZE, MIN_SAMPLES, NOISE, SELECTION_EPSILON, fit_density)
from textquarry.operators.embedding import HASHED_DIMENSIONS, REDUCED_DIMENSIONS, Encoder
from textquarry.operators.placing import ClusterIndex, index_clustering, load_index, place_points
from textquarry.session import discard, materialise
from textquarry.sources import sinks


@dataclass(frozen=True)
class FittedModels:
    """What a run has learned: enough to score rows it has not seen.

    ``weights`` is missing where a user's encoder made the vectors, ``pseudo`` where there
    were fewer than two clusters.
    """

    parameters: dict
    weights: IDFModel | None
    reduction: PCAModel
    index: ClusterIndex
    pseudo: KMeansModel | None


@dataclass(frozen=True)
class ClusteringRun:
    """Results of one run. ``state`` has query_id, embedding, v and cluster."""

    mode: str
    state: DataFrame
    clustered: DataFrame
    profile: DataFrame
    keywords: DataFrame
    metrics: DataFrame
    tightness: DataFrame
    models: FittedModels


def _keyed(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The corpus, stored, with a key for each row, and again with it for ``query_id``."""
    keyed = materialise(corpus.withColumn("_row", F.monotonically_increasing_id()), "corpus", "zstd")
    return keyed, keyed.withColumn("query_id", F.col("_row")).drop("_row")


def cluster_corpus(corpus: DataFrame, mode: str, encoder: Encoder | None = None,
                   min_cluster_size: int = MIN_CLUSTER_SIZE, min_samples: int = MIN_SAMPLES,
                   epsilon: float = SELECTION_EPSILON, dimensions: int = HASHED_DIMENSIONS,
                   components: int = REDUCED_DIMENSIONS) -> ClusteringRun:
    """Embed, reduce and cluster the corpus, row by row: ids may repeat.

    Rows get a key of their own at the start, which stands for ``query_id`` until
    the results are made. Vectors and labels are written to the shared folder once and read by every
    later step; nothing is computed twice.
    """
    mode = check_mode(mode)
    keyed, rows = _keyed(corpus)
    texts = embedding.mode_texts(rows, mode)
    weights = None
    if encoder is None:
        counted = embedding.term_counts(texts, dimensions)
        weights = embedding.fit_weights(counted)
        vectors = embedding.weighted(counted, weights)
    else:
        vectors = embedding.encode(texts, encoder)
    embedded = materialise(vectors, "embedded")
    if encoder is None:
        discard(counted)
    reduction = embedding.fit_reduction(embedded, components)
    reduced = materialise(embedding.reduced(embedded, reduction), "reduced")
    members, tree = fit_density(reduced, min_cluster_size, min_samples, epsilon)
    members = materialise(members, "members")
    labels = reduced.join(members.select("v", "cluster"), "v", "left").select(
        "query_id", "v", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
    points = materialise(labels, "labelled")
    pseudo = embedding.fit_kmeans(points)
    scored = points.join(embedding.pseudo_labels(points, pseudo), "query_id", "left")
    ids = keyed.select("query_id", "_row")
    label_of = points.select(F.col("query_id").alias("_row"), "cluster")
    clustered = keyed.join(label_of, "_row").drop("_row")
    state = (points.join(embedded.withColumnRenamed("v", "embedding"), "query_id")
             .withColumnRenamed("query_id", "_row").join(ids, "_row")
             .select("query_id", "v", "cluster", "embedding"))
    models = FittedModels(
        {"mode": mode, "min_cluster_size": min_cluster_size, "min_samples": min_samples, "epsilon": epsilon,
         "dimensions": dimensions, "components": components, "own_encoder": encoder is not None},
        weights, reduction, index_clustering(members, tree, min_samples), pseudo)
    return ClusteringRun(
        mode, state, clustered, profiles.cluster_profile(clustered),
        profiles.cluster_keywords(clustered, mode), metrics.cluster_metrics(scored, mode),
        metrics.cluster_tightness(points), models)


def save_models(models: FittedModels, path: str) -> None:
    """Write parameters, models and the cluster index below a folder.

    A user's encoder is not stored; who scores new rows passes it again.
    """
    spark = models.index.packs.sparkSession
    parts = {"weights": models.weights, "reduction": models.reduction, "pseudo": models.pseudo}
    for name, model in parts.items():
        if model is not None:
            model.write().overwrite().save(f"{path}/{name}")
    models.index.save(f"{path}/index")
    stored = models.parameters | {"models": [name for name, model in parts.items() if model is not None]}
    # last, so that a folder with parameters is whole
    spark.createDataFrame([(json.dumps(stored),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/parameters")


def load_models(spark: SparkSession, path: str) -> FittedModels:
    """What :func:`save_models` has written."""
    parameters = json.loads(spark.read.text(f"{path}/parameters").first()["value"])
    kinds = {"weights": IDFModel, "reduction": PCAModel, "pseudo": KMeansModel}
    present = parameters.pop("models")
    models = {name: kind.load(f"{path}/{name}") if name in present else None for name, kind in kinds.items()}
    return FittedModels(parameters, models["weights"], models["reduction"],
                        load_index(spark, f"{path}/index"), models["pseudo"])


def score_corpus(models: FittedModels, corpus: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """(query_id, cluster, length, pseudo) of every row of a corpus, by a run's models.

    Nothing is fitted. A row whose vector is a member's gets that member's cluster;
    ``length`` tells how far off the clustering a row is, ``pseudo`` is null for noise. Ids may
    repeat.
    """
    if models.parameters["own_encoder"] != (encoder is not None):
        raise ValueError("pass the encoder that the run was made with, and no other")
    # of the corpus only what is embedded is stored, and no longer than for that
    read = materialise(corpus.select("query_id", embedding_text(models.parameters["mode"]).alias("text"),
                                     F.monotonically_increasing_id().alias("_row")), "texts", "zstd")
    keyed = materialise(read.select("query_id", "_row"), "rows")
    texts = read.select(F.col("_row").alias("query_id"), "text")
    if encoder is None:
        counted = embedding.term_counts(texts, models.parameters["dimensions"])
        vectors = embedding.weighted(counted, models.weights)
    else:
        counted = None
        vectors = embedding.encode(texts, encoder)
    points = materialise(embedding.reduced(vectors, models.reduction), "reduced")
    discard(read, *([counted] if counted else []))
    placed = materialise(place_points(points, models.index), "placed")
    pseudo = embedding.pseudo_labels(points.join(placed, "query_id"), models.pseudo)
    found = placed.join(pseudo, "query_id", "left").withColumnRenamed("query_id", "_row")
    return keyed.select("query_id", "_row").join(found, "_row").select(
        "query_id", "cluster", "length", "pseudo")


def save_run(run: ClusteringRun, path: str) -> None:
    """Write every result of a run, and its models, below one folder."""
    sinks.write_clustered(run.clustered, f"{path}/clustered")
    sinks.write_by_cluster(run.clustered, f"{path}/individual_clusters")
    sinks.write_cluster_stats(run.profile, f"{path}/cluster_statistics")
    sinks.write_keywords(run.keywords, f"{path}/cluster_keywords")
    sinks.write_metrics(run.metrics, run.tightness, f"{path}/clustering_metrics")
    sinks.write_cluster_state(run.state, f"{path}/state")
    save_models(run.models, f"{path}/models")
