"""Texts as vectors, vectors in few dimensions, and k-means labels on them."""

from __future__ import annotations

import re
import shutil
import tempfile
from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer, PCA, PCAModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from textquarry.functions.text import embedding_text, tokens
from textquarry.session import materialise

Encoder = Callable[[pd.Series], np.ndarray]

HASHED_DIMENSIONS = 256
REDUCED_DIMENSIONS = 5
# K-means restarts and seed of the pseudo labels.
RESTARTS = 10
SEED = 42
PARALLEL_RUNS = 4
NOISE = -1
WORD = re.compile(r"\w+")


def encode(texts: DataFrame, encoder: Encoder) -> DataFrame:
    """``v`` from a user's model, called with one Arrow batch of texts at a time."""

    @F.pandas_udf("array<double>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.asarray(encoder(batch), dtype=float)))

    return texts.select("query_id", encoded("text").alias("v"))


def _send_folder(spark: SparkSession, path: str) -> str:
    """Have a folder fetched by every executor; the name under which SparkFiles finds it.

    Executors fetch a folder of a remote store themselves. One of a local or shared disk Spark
    sends to other processes only as an archive.
    """
    path = path.rstrip("/")
    name = path.rsplit("/", 1)[-1]
    scheme, local = re.fullmatch(r"(?:(\w[\w+.-]*):(?://[^/]*)?)?(.*)", path).groups()
    if scheme in (None, "file"):
        packed = shutil.make_archive(f"{tempfile.mkdtemp(prefix='textquarry-')}/{name}", "zip", local)
        spark.sparkContext.addArchive(f"{packed}#{name}")
    else:
        spark.sparkContext.addFile(path, recursive=True)
    return name


def encode_by_model(texts: DataFrame, path: str, load: Callable[[str], Encoder], batch_size: int = 256) -> DataFrame:
    """(query_id, v) from a stored model, which ``load`` opens once in each Python worker.

    ``path`` is a folder, in a remote store or on a disk the driver sees, that Spark sends to
    the executors; ``load`` gets its local name.
    Only that name travels with the tasks, not the model. A null text counts as empty.
    """
    name = _send_folder(texts.sparkSession, path)

    def opened():
        encoder = load(SparkFiles.get(name))
        return lambda batch: np.asarray(encoder(pd.Series(batch)), dtype=float)

    predict = predict_batch_udf(opened, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    return texts.select("query_id", predict(F.coalesce("text", F.lit(""))).alias("v"))


def save_projection(spark: SparkSession, path: str, dimensions: int = 64, buckets: int = 4096,
                    seed: int = SEED) -> None:
    """A small model as a folder: a random direction for each bucket of hashed words."""
    weights = np.random.default_rng(seed).standard_normal((buckets, dimensions)) / np.sqrt(dimensions)
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(weights)], "bucket int, direction array<double>")
    rows.coalesce(1).write.parquet(path)


def load_projection(path: str) -> Encoder:
    """The encoder stored by :func:`save_projection`: unit sums of the words' directions."""
    stored = pd.read_parquet(path).sort_values("bucket")
    weights = np.stack(stored["direction"].to_numpy())

    def encoder(batch: pd.Series) -> np.ndarray:
        out = np.zeros((len(batch), weights.shape[1]))
        for i, text in enumerate(batch):
            words = [crc32(w.encode()) % len(weights) for w in WORD.findall(text.lower())]
            out[i] = weights[words].sum(axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encoder


def term_counts(texts: DataFrame, dimensions: int = HASHED_DIMENSIONS) -> DataFrame:
    """(query_id, tf) of (query_id, text): hashed term frequencies, stored.

    Texts are taken apart once; what is fitted and transformed later are these narrow rows.
    """
    words = texts.select("query_id", tokens(F.col("text")).alias("words"))
    counted = HashingTF(inputCol="words", outputCol="tf", numFeatures=dimensions).transform(words)
    return materialise(counted.select("query_id", "tf"), "terms")


def fit_weights(counted: DataFrame) -> IDFModel:
    """Inverse document frequencies of the hashed terms."""
    return IDF(inputCol="tf", outputCol="tfidf").fit(counted)


def weighted(counted: DataFrame, model: IDFModel) -> DataFrame:
    """``v`` as term frequencies weighted by the model."""
    return model.transform(counted).select("query_id", vector_to_array("tfidf").alias("v"))


def hashed_tfidf(texts: DataFrame, dimensions: int = HASHED_DIMENSIONS) -> DataFrame:
    """``v`` as hashed term frequencies weighted by inverse document frequency."""
    counted = term_counts(texts, dimensions)
    return weighted(counted, fit_weights(counted))


def mode_texts(corpus: DataFrame, mode: str) -> DataFrame:
    """(query_id, text): the text the mode stands for."""
    return corpus.select("query_id", embedding_text(mode).alias("text"))


def embed_text(corpus: DataFrame, mode: str, encoder: Encoder | None = None,
               dimensions: int = HASHED_DIMENSIONS) -> DataFrame:
    """(query_id, v) of the text the mode stands for; vectors are not normalised."""
    texts = mode_texts(corpus, mode)
    return hashed_tfidf(texts, dimensions) if encoder is None else encode(texts, encoder)


def _unit(embedded: DataFrame) -> DataFrame:
    vectors = embedded.select("query_id", array_to_vector("v").alias("raw"))
    return Normalizer(inputCol="raw", outputCol="unit").transform(vectors)


def fit_reduction(embedded: DataFrame, k: int = REDUCED_DIMENSIONS) -> PCAModel:
    """A linear projection of the unit-length vectors: the covariance is as wide as the
    vectors, not as long as the corpus."""
    return PCA(k=k, inputCol="unit", outputCol="reduced").fit(_unit(embedded))


def reduced(embedded: DataFrame, model: PCAModel) -> DataFrame:
    """(query_id, v): the vectors by a fitted projection."""
    return model.transform(_unit(embedded)).select("query_id", vector_to_array("reduced").alias("v"))


def reduce_dimensions(embedded: DataFrame, k: int = REDUCED_DIMENSIONS) -> DataFrame:
    """(query_id, v) with k components of the unit-length vectors."""
    return reduced(embedded, fit_reduction(embedded, k))


def fit_kmeans(points: DataFrame, k: int | None = None, seed: int = SEED,
               restarts: int = RESTARTS) -> KMeansModel | None:
    """The best of several k-means runs over the clustered points.

    k is the number of clusters; with fewer than two there is no model.
    """
    kept = points.where(F.col("cluster") != NOISE)
    if k is None:
        k = kept.agg(F.count_distinct("cluster")).first()[0]
    if k < 2:
        return None
    features = materialise(kept.select(array_to_vector("v").alias("features")), "features").persist()

    def fit(restart: int):
        return KMeans(k=k, seed=seed + restart, featuresCol="features",
                      predictionCol="pseudo").fit(features)

    # the runs are independent Spark jobs: a few are kept going at a time
    with ThreadPool(min(PARALLEL_RUNS, restarts)) as pool:
        models = pool.map(fit, range(restarts))
    features.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


def pseudo_labels(points: DataFrame, model: KMeansModel | None) -> DataFrame:
    """(query_id, pseudo) of the clustered points; no model, no labels."""
    if model is None:
        return points.sparkSession.createDataFrame([], "query_id long, pseudo int")
    kept = points.where(F.col("cluster") != NOISE)
    return model.transform(kept.select("query_id", array_to_vector("v").alias("features"))).select(
        "query_id", "pseudo")


def kmeans_labels(points: DataFrame, k: int | None = None, seed: int = SEED,
                  restarts: int = RESTARTS) -> DataFrame:
    """(query_id, pseudo): the best of several k-means runs over the clustered points.

    k is the number of clusters; with fewer than two there are no labels.
    """
    return pseudo_labels(points, fit_kmeans(points, k, seed, restarts))
