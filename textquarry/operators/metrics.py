"""Quality of a clustering: compactness, separation, agreement with k-means.

``points`` has ``query_id``, ``v`` (array<double>) and ``cluster``; noise (-1)
is left out of every score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.scores import euclidean, homogeneity_band, separation_band
from textquarry.operators.blocks import (
    BLOCK_SIZE, block_pairs, distance_tiles, distances, run_kernel)
from textquarry.session import materialise

NOISE = -1
SAMPLE_SEED = 42
TIGHTEST = 5
#: Clusters of a block whose sums are held at a time.
CLUSTERS = 128
#: Centroids in a block: the matrix of two such blocks is held whole.
CENTROIDS = 4096


def clustered_only(points: DataFrame) -> DataFrame:
    return points.where(F.col("cluster") != NOISE)


def cluster_counts(points: DataFrame) -> DataFrame:
    """Clusters, noise points and clustered points as one row."""
    noise = F.col("cluster") == NOISE
    return points.agg(
        F.count_distinct(F.when(~noise, F.col("cluster"))).alias("n_clusters"),
        F.count_if(noise).alias("n_noise"), F.count_if(~noise).alias("n_clustered"))


def _scorable() -> Column:
    # at least two clusters, hence at least two points
    return F.col("n_clusters") >= 2


def centroids(points: DataFrame) -> DataFrame:
    """(cluster, size, centroid) of every cluster."""
    return clustered_only(points).groupBy("cluster").agg(
        F.count("*").alias("size"),
        vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("centroid"))


def centroid_distances(points: DataFrame) -> DataFrame:
    """Every clustered point with the distance to its own centroid."""
    return (clustered_only(points).select("query_id", "cluster", "v")
            .join(centroids(points), "cluster")
            .select("query_id", "cluster", "size", "centroid",
                    euclidean(F.col("v"), F.col("centroid")).alias("distance")))


def _spread(points: DataFrame) -> DataFrame:
    """Per cluster: size, centroid, mean and squared distance of its points to it."""
    return (centroid_distances(points).groupBy("cluster")
            .agg(F.first("size").alias("size"), F.first("centroid").alias("v"),
                 F.avg("distance").alias("scatter"),
                 F.sum(F.col("distance") * F.col("distance")).alias("within")))


def _tightness_kernel(grp, same, left, right) -> Iterator[pd.DataFrame]:
    total = sum(tile.sum() for _, _, tile in distance_tiles(left[1], right[1]))
    yield pd.DataFrame({"cluster": [grp], "total": [total if same else 2.0 * total]})


def cluster_tightness(points: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Mean pairwise distance per cluster, 0 for a single point."""
    kept = clustered_only(points)
    sizes = kept.groupBy("cluster").agg(F.count("*").alias("size"))
    sums = (run_kernel(block_pairs(kept, group="cluster", block_size=block_size),
                       _tightness_kernel, "cluster long, total double")
            .groupBy("cluster").agg(F.sum("total").alias("total")))
    n = F.col("size")
    return (sizes.join(sums, sizes["cluster"] == sums["cluster"])
            .select(sizes["cluster"], "size",
                    F.when(n > 1, F.col("total") / (n * (n - 1))).otherwise(F.lit(0.0))
                    .alias("tightness")))


def tightest_clusters(points: DataFrame, n: int = TIGHTEST) -> DataFrame:
    return cluster_tightness(points).orderBy("tightness", "cluster").limit(n)


def _by_clusters(side) -> list[tuple]:
    """A side (ids, matrix, labels) in parts of CLUSTERS clusters, each sorted by cluster, with
    the clusters of the part and the place of each row's among them."""
    ids, matrix, labels = side
    order = np.argsort(labels, kind="stable")
    clusters, place = np.unique(labels[order], return_inverse=True)
    parts = []
    for first in range(0, len(clusters), CLUSTERS):
        part = slice(*np.searchsorted(place, [first, first + CLUSTERS]))
        rows = order[part]
        parts.append((ids[rows], matrix[rows], labels[rows], clusters[first:first + CLUSTERS], place[part] - first))
    return parts


def _starts(place: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, place[1:] != place[:-1]])


def _silhouette_kernel(grp, same, left, right) -> Iterator[pd.DataFrame]:
    """Distance sums of each point of one side to each cluster of the other."""
    parts = _by_clusters(left)
    others = parts if same else _by_clusters(right)
    for i, a in enumerate(parts):
        for j, b in enumerate(others):
            if same and j < i:
                continue
            twice = not same or j > i
            forward, backward = np.zeros((len(a[0]), len(b[3]))), np.zeros((len(b[0]), len(a[3])))
            for rows, cols, tile in distance_tiles(a[1], b[1]):
                starts = _starts(b[4][cols])
                forward[rows, b[4][cols][starts]] += np.add.reduceat(tile, starts, axis=1)
                if twice:
                    starts = _starts(a[4][rows])
                    backward[cols, a[4][rows][starts]] += np.add.reduceat(tile, starts, axis=0).T
            for (ids, _, own, _, _), clusters, sums in [(a, b[3], forward), (b, a[3], backward)][:1 + twice]:
                yield pd.DataFrame({
                    "query_id": np.repeat(ids, len(clusters)), "cluster": np.repeat(own, len(clusters)),
                    "other": np.tile(clusters, len(ids)), "total": sums.ravel()})


def sampled(points: DataFrame, size: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """A seeded sample of the clustered points, for callers who ask for an estimate."""
    kept = clustered_only(points)
    # ordering by a hash makes it a top-k per task; ids break the rare tie
    return kept.orderBy(F.xxhash64(F.lit(seed), F.col("query_id")), "query_id").limit(size)


def silhouette_points(points: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Euclidean silhouette coefficient of every clustered point; 0 for a cluster of one.

    Work grows with the square of the points, as the score is defined on all pairs.
    """
    used = clustered_only(points)
    sizes = used.groupBy(F.col("cluster").cast("long").alias("other")).agg(
        F.count("*").alias("n"))
    sums = (run_kernel(block_pairs(used, label="cluster", block_size=block_size),
                       _silhouette_kernel,
                       "query_id long, cluster long, other long, total double")
            .groupBy("query_id", "cluster", "other").agg(F.sum("total").alias("total")))
    own = F.col("cluster") == F.col("other")
    means = sums.join(sizes, "other").select(
        "query_id", "cluster", "n", own.alias("own"),
        (F.col("total") / F.when(own, F.greatest(F.col("n") - 1, F.lit(1)))
         .otherwise(F.col("n"))).alias("mean"))
    per_point = means.groupBy("query_id", "cluster").agg(
        F.max(F.when(F.col("own"), F.col("mean"))).alias("a"),
        F.min(F.when(~F.col("own"), F.col("mean"))).alias("b"),
        F.max(F.when(F.col("own"), F.col("n"))).alias("n"))
    widest = F.greatest("a", "b")
    score = (F.when(F.col("b").isNull(), F.lit(None))
             .when((F.col("n") == 1) | (widest == 0), F.lit(0.0))
             .otherwise((F.col("b") - F.col("a")) / widest))
    return per_point.select("query_id", "cluster", score.alias("silhouette"))


def _only_if_scorable(score: DataFrame, points: DataFrame) -> DataFrame:
    """The one-row score, or no row where there are fewer than two clusters."""
    clusters = cluster_counts(points).select("n_clusters").scalar()
    return score.withColumn("n_clusters", clusters).where(_scorable()).drop("n_clusters")


def silhouette(points: DataFrame) -> DataFrame:
    """Mean coefficient over all clustered points."""
    per_point = silhouette_points(points)
    return _only_if_scorable(
        per_point.agg(F.avg("silhouette").alias("silhouette_score")), points)


def _separation_kernel(grp, same, left, right) -> Iterator[pd.DataFrame]:
    """Per cluster, the worst (S_i + S_j) / d(c_i, c_j) against the other side.

    The last matrix column holds the scatter S, the others the centroid.
    """
    a, b = left[1], right[1]
    between = distances(a[:, :-1], a[:, :-1] if same else b[:, :-1])
    if same:
        np.fill_diagonal(between, np.inf)
    both = a[:, -1][:, None] + b[:, -1][None, :]
    # coinciding centroids add nothing to the index
    ratio = np.divide(both, between, out=np.zeros_like(both), where=between > 0)
    yield pd.DataFrame({"cluster": left[0], "worst": ratio.max(axis=1)})
    if not same:
        yield pd.DataFrame({"cluster": right[0], "worst": ratio.max(axis=0)})


def davies_bouldin(points: DataFrame) -> DataFrame:
    """Mean over clusters of the worst scatter-to-separation ratio."""
    described = _spread(points).select(
        F.col("cluster").cast("long").alias("query_id"),
        F.concat("v", F.array("scatter")).alias("v"))
    worst = (run_kernel(block_pairs(described, block_size=CENTROIDS), _separation_kernel,
                        "cluster long, worst double")
             .groupBy("cluster").agg(F.max("worst").alias("worst")))
    return _only_if_scorable(worst.agg(F.avg("worst").alias("davies_bouldin_index")), points)


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """Between-cluster over within-cluster dispersion; 1 when the latter is 0."""
    mean = clustered_only(points).agg(
        vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m"))
    apart = euclidean(F.col("v"), F.col("m"))
    totals = (_spread(points).withColumn("m", mean.scalar())
              .agg(F.sum(F.col("size") * apart * apart).alias("between"),
                   F.sum("within").alias("within"), F.count("*").alias("k"),
                   F.sum("size").alias("n")))
    score = F.when(F.col("within") == 0, F.lit(1.0)).otherwise(
        (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k"))))
    return totals.where("k >= 2").select(score.alias("calinski_harabasz_score"))


def label_contingency(points: DataFrame) -> DataFrame:
    """Joint counts of (pseudo, cluster) over the clustered points."""
    return (clustered_only(points).groupBy("pseudo", "cluster")
            .agg(F.count("*").alias("count")))


def _entropy(counts: DataFrame, by: str) -> DataFrame:
    """Σ n·ln n over the marginal of ``by``, and the total."""
    marginal = counts.groupBy(by).agg(F.sum("count").alias("n"))
    return marginal.agg(F.sum(F.col("n") * F.log(F.col("n").cast("double"))))


def label_agreement(points: DataFrame) -> DataFrame:
    """Homogeneity, completeness and V-measure; k-means labels act as the truth.

    With T = total and s(X) = Σ n·ln n over the counts of X:
    H(X) = ln T - s(X)/T and H(X|Y) = (s(Y) - s(XY))/T.
    """
    counts = label_contingency(points)
    n = F.col("count")
    joint = counts.agg(F.sum("count").alias("t"),
                       F.sum(n * F.log(n.cast("double"))).alias("s_joint"))
    t = F.col("t")
    h_truth = F.log(t.cast("double")) - F.col("s_truth") / t
    h_pred = F.log(t.cast("double")) - F.col("s_pred") / t
    h_truth_given_pred = (F.col("s_pred") - F.col("s_joint")) / t
    h_pred_given_truth = (F.col("s_truth") - F.col("s_joint")) / t
    tiny = 1e-12
    h = F.when(h_truth <= tiny, F.lit(1.0)).otherwise(1 - h_truth_given_pred / h_truth)
    c = F.when(h_pred <= tiny, F.lit(1.0)).otherwise(1 - h_pred_given_truth / h_pred)
    scores = (joint.withColumn("s_truth", _entropy(counts, "pseudo").scalar())
              .withColumn("s_pred", _entropy(counts, "cluster").scalar())
              .where("t > 0").select(h.alias("h"), c.alias("c")))
    both = F.col("h") + F.col("c")
    v = F.when(both == 0, F.lit(0.0)).otherwise(2 * F.col("h") * F.col("c") / both)
    return _only_if_scorable(
        scores.select(F.col("h").alias("homogeneity_score"), F.col("c").alias("completeness_score"),
                      v.alias("v_measure_score")), points)


def cluster_metrics(points: DataFrame, mode: str = "semantic") -> DataFrame:
    """The metrics record as one row, or no row for under two clusters.

    ``points`` also has ``pseudo``, the k-means labels. The tightness of the
    single clusters, as many as there are clusters, stays the table
    :func:`cluster_tightness`; the record has their mean.
    """
    points = materialise(points, "scored")  # each score reads it, none computes it again
    agreement = label_agreement(points)
    agreed = agreement.select(F.struct(*agreement.columns))
    tightness = cluster_tightness(points).agg(F.avg("tightness"))
    return (
        cluster_counts(points).where(_scorable())
        .withColumn("agreed", agreed.scalar())
        .select(
            F.lit(mode).alias("mode"),
            silhouette(points).scalar().alias("silhouette_score"),
            davies_bouldin(points).scalar().alias("davies_bouldin_index"),
            calinski_harabasz(points).scalar().alias("calinski_harabasz_score"),
            F.col("agreed.homogeneity_score"), F.col("agreed.completeness_score"),
            F.col("agreed.v_measure_score"), tightness.scalar().alias("avg_cluster_tightness"),
            "n_clusters", "n_noise", "n_clustered")
    )


def assessment(metrics: DataFrame) -> DataFrame:
    """Verdict in words on separation and homogeneity."""
    return metrics.select(
        separation_band(F.col("silhouette_score")).alias("separation"),
        homogeneity_band(F.col("homogeneity_score")).alias("homogeneity"))
