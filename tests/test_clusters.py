from __future__ import annotations

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textquarry.operators import metrics, profiles
from textquarry.operators.density import density_clusters
from textquarry.operators.embedding import embed_text, kmeans_labels
from textquarry.operators.spatial import core_distances, partition_sites
from textquarry.plans import tables
from textquarry.plans.clustering import cluster_corpus, load_models, save_run, score_corpus
from textquarry.session import ship_code

ship_code()


def points_frame(spark, matrix, **columns):
    data = {"query_id": range(len(matrix)), "v": [list(map(float, r)) for r in matrix], **columns}
    schema = "query_id long, v array<double>" + "".join(f", {c} int" for c in columns)
    return spark.createDataFrame(pd.DataFrame(data), schema)


def blobs(n, centres, dimensions, spread, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dimensions)) * 2
    return np.vstack([middle[i % centres] + rng.normal(size=dimensions) * spread * (1 + i % 3)
                      for i in range(n)])


def clusters_of(frame):
    found: dict[int, set[int]] = {}
    rows = frame.collect()
    for row in rows:
        if row["cluster"] >= 0:
            found.setdefault(row["cluster"], set()).add(row["query_id"])
    return {frozenset(v) for v in found.values()}, len(rows)


@pytest.fixture(scope="module")
def labelled(spark):
    matrix = blobs(90, 4, 3, 0.4, 5)
    labels = np.arange(90) % 4
    labels[:5] = -1
    labels[89] = 9  # a cluster of one
    return matrix, labels, points_frame(spark, matrix, cluster=labels, pseudo=np.arange(90) % 3)


def test_silhouette_and_tightness_over_many_blocks(labelled):
    matrix, labels, frame = labelled
    kept = labels != -1
    gaps, owner = brute.distances(matrix[kept]), labels[kept]
    expected = []
    for i, own in enumerate(owner):
        mates = (owner == own).sum() - 1
        a = gaps[i, owner == own].sum() / max(mates, 1)
        b = min(gaps[i, owner == c].mean() for c in set(owner) - {own})
        expected.append((b - a) / max(a, b) if mates else 0.0)
    got = metrics.silhouette_points(frame, block_size=16)
    values = [r["silhouette"] for r in got.orderBy("query_id").collect()]
    assert np.allclose(values, expected)
    tight = {r["cluster"]: r["tightness"]
             for r in metrics.cluster_tightness(frame, block_size=8).collect()}
    for c in set(owner):
        n = (owner == c).sum()
        total = gaps[np.ix_(owner == c, owner == c)].sum()
        assert np.isclose(tight[c], total / (n * (n - 1)) if n > 1 else 0.0)


def test_sampled_silhouette_is_repeatable(labelled):
    frame = labelled[2]
    first, second = (metrics.silhouette_points(metrics.sampled(frame, 30)).orderBy("query_id").collect()
                     for _ in range(2))
    assert len(first) == 30 and first == second


def test_no_scores_below_two_clusters(spark):
    frame = points_frame(spark, [[0, 0], [1, 1], [9, 9]], cluster=[0, 0, -1], pseudo=[0, 0, 0])
    for score in (metrics.silhouette, metrics.davies_bouldin, metrics.calinski_harabasz,
                  metrics.label_agreement, metrics.cluster_metrics):
        assert score(frame).count() == 0
    assert kmeans_labels(frame).count() == 0
    assert tuple(metrics.cluster_counts(frame).first()) == (1, 1, 2)


def test_core_distances_across_blocks(spark):
    matrix = blobs(120, 3, 2, 0.5, 8)
    frame = points_frame(spark, matrix).selectExpr("query_id AS site", "1L AS weight", "v")
    sites, blocks = partition_sites(frame, block_rows=16)
    assert blocks == 8
    rows = core_distances(sites, blocks, 4).orderBy("site").collect()
    assert np.allclose([r["core"] for r in rows], brute.core_distances(matrix, 4))


@pytest.mark.parametrize("case", [
    dict(n=120, size=6, samples=3, epsilon=0.05, block_rows=4096, rung_edges=10**6),
    dict(n=120, size=5, samples=3, epsilon=0.4, block_rows=32, rung_edges=80),
])
def test_density_clusters_equal_brute_force(spark, case):
    matrix = blobs(case["n"], 4, 2, 0.25, case["n"])
    got, n = clusters_of(density_clusters(
        points_frame(spark, matrix), case["size"], case["samples"], case["epsilon"],
        case["block_rows"], case["rung_edges"]))
    assert n == len(matrix)
    assert got == set(brute.density_clusters(matrix, case["size"], case["samples"], case["epsilon"]))


def test_copies_and_equal_lengths(spark):
    matrix = np.round(blobs(120, 4, 2, 0.3, 3), 1)
    matrix[::3] = matrix[0]
    got, n = clusters_of(density_clusters(points_frame(spark, matrix), 5, 4, 0.2, 16))
    assert n == len(matrix)
    assert got == set(brute.density_clusters(matrix, 5, 4, 0.2))


def test_own_encoder(spark, sf_dir):
    rows = embed_text(tables.corpus(spark, sf_dir), "sql",
                      encoder=lambda texts: np.stack([texts.str.len(), texts.str.count("a")], 1))
    first = rows.orderBy("query_id").first()
    assert len(first["v"]) == 2 and first["v"][0] > 0


def test_run_and_save(spark, sf_dir, tmp_path):
    run = cluster_corpus(tables.corpus(spark, sf_dir), "semantic", min_cluster_size=5)
    save_run(run, str(tmp_path))
    rows = tables.corpus(spark, sf_dir).count()
    sizes = {r["cluster_id"]: r["size"] for r in run.profile.collect()}
    assert sum(sizes.values()) == rows
    assert all(size >= 5 for cluster, size in sizes.items() if cluster >= 0)
    assert spark.read.parquet(f"{tmp_path}/individual_clusters").count() == rows
    assert spark.read.parquet(f"{tmp_path}/state").columns == [
        "query_id", "v", "cluster", "embedding"]
    models = load_models(spark.newSession(), f"{tmp_path}/models")
    assert models.parameters == run.models.parameters and models.parameters["min_cluster_size"] == 5
    own = {r["query_id"]: r["cluster"] for r in run.clustered.collect()}
    scored = score_corpus(models, tables.corpus(models.index.packs.sparkSession, sf_dir)).collect()
    assert {r["query_id"]: r["cluster"] for r in scored} == own and len(scored) == rows
    assert all((r["cluster"] == -1) == (r["pseudo"] is None) and r["length"] == 0 for r in scored)
    unseen = [(1, "never seen words here", "", [], "", ""), (1, None, None, None, None, None)]
    unseen = spark.createDataFrame(unseen, "query_id long, name string, description string, "
                                           "tags array<string>, owner string, query_sql string")
    assert score_corpus(models, unseen).count() == 2
    with pytest.raises(ValueError, match="encoder"):
        score_corpus(models, unseen, encoder=lambda texts: texts)


def test_silhouette_uses_every_point(spark):
    # more points than any block, on a line: the sums are known in closed form
    n = 6000
    where = np.arange(2 * n, dtype=float) + np.repeat([0.0, 10.0 * n], n)
    frame = points_frame(spark, [[x] for x in where], cluster=[0] * n + [1] * n)
    got = metrics.silhouette_points(frame)
    assert got.count() == 2 * n
    own, other = np.arange(n, dtype=float), np.arange(n, dtype=float) + 11.0 * n
    a = (own * (own + 1) / 2 + (n - 1 - own) * (n - own) / 2) / (n - 1)
    b = other.mean() - own
    mean = ((b - a) / np.maximum(a, b)).mean()
    assert np.isclose(metrics.silhouette(frame).first()[0], mean, atol=1e-3)


def test_partition_survives_ties():
    from textquarry.operators.spatial import _fit_partition

    source = np.random.default_rng(3)
    matrix = source.random((8000, 8)) * (source.random((8000, 8)) > 0.7)
    matrix[:, 0] = 5.0  # a dimension without spread
    matrix = np.unique(matrix, axis=0)
    sizes = np.bincount(_fit_partition(matrix, 3).assign(matrix), minlength=8)
    assert sizes.max() <= 2 * len(matrix) / 8


def test_repeated_ids_do_not_multiply_rows(spark):
    corpus = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id long, name string")
    labels = spark.createDataFrame([(1, 4), (1, 3), (2, 0)], "query_id long, cluster int")
    got = profiles.attach_labels(corpus, labels).orderBy("query_id", "name").collect()
    assert [(r["query_id"], r["name"], r["cluster"]) for r in got] == [(1, "a", 3), (1, "b", 3), (2, "c", 0)]


@pytest.mark.parametrize("seed,digits,rung_edges", [(12, 1, 30), (14, 0, 60)])
def test_small_problems_and_blocks_change_nothing(spark, seed, digits, rung_edges):
    matrix = np.round(blobs(120, 5, 2, 0.3, seed), digits)
    got, n = clusters_of(density_clusters(points_frame(spark, matrix), 5, 3, 0.1, 32, rung_edges))
    assert n == len(matrix)
    assert got == set(brute.density_clusters(matrix, 5, 3, 0.1))


def test_spanning_tree_is_minimal(spark):
    from textquarry.operators.density import spanning_tree

    matrix = blobs(200, 6, 3, 0.2, 21)
    frame = points_frame(spark, matrix).selectExpr("query_id AS site", "1L AS weight", "v")
    sites, blocks = partition_sites(frame, block_rows=32)
    sites = core_distances(sites, blocks, 3)
    found = sorted(r["w"] for r in spanning_tree(sites, blocks).collect())
    core = brute.core_distances(matrix, 3)
    gaps = np.maximum(brute.distances(matrix), np.maximum(core[:, None], core[None, :]))
    inside, best, expected = np.zeros(200, dtype=bool), np.full(200, np.inf), []
    best[0] = 0.0
    for _ in range(200):
        at = int(np.argmin(np.where(inside, np.inf, best)))
        inside[at] = True
        expected.append(best[at])
        best = np.minimum(best, gaps[at])
    assert blocks == 8 and np.allclose(found, sorted(expected)[1:])


def test_folding_equals_one_task(spark):
    from textquarry.operators.density import best_below

    source = np.random.default_rng(6)
    rows = [(f"n{i}", f"n{source.integers(max(0, i - 4), i)}" if i % 40 else "top", float(source.random() * (1 + 200 / (i + 1))))
            for i in range(1, 160)]
    nodes = spark.createDataFrame(rows, "node string, parent string, stability double")
    one, many = ({r["node"]: r["best"] for r in best_below(nodes, size).collect()} for size in (1000, 3))
    assert len(one) == len(rows) and one.keys() == many.keys()
    assert all(np.isclose(one[n], many[n]) for n in one)


def test_problems_are_bounded(spark):
    from textquarry.operators.density import _problems

    source = np.random.default_rng(9)
    # a path whose lengths grow: one component takes in node after node
    edges = [(f"s{i}", f"s{i + 1}", float(i // 3)) for i in range(300)] + [(f"s{i}", f"t{i}", 50.0) for i in range(300)]
    source.shuffle(edges)
    tree = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "a string, b string, w double")
    sizes = spark.createDataFrame([(n, 1) for n in sorted({x for a, b, _ in edges for x in (a, b)})], "node string, size long")
    problems, flat, sizes = _problems(tree, sizes, 20)
    assert problems.groupBy("problem").count().agg({"count": "max"}).first()[0] <= 20
    assert flat.groupBy("problem").agg({"w": "min"}).count() >= 1
    assert problems.count() + flat.count() == len(edges)


def test_stored_model_is_opened_once_in_each_worker(spark, tmp_path):
    import os
    import uuid

    from textquarry.operators.embedding import encode_by_model, load_projection, save_projection

    model, marks = str(tmp_path / "model"), tmp_path / "marks"
    marks.mkdir()
    save_projection(spark, model, dimensions=8, buckets=64)

    def load(path):
        (marks / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return load_projection(path)

    texts = spark.range(200).select(F.col("id").alias("query_id"), F.when(
        F.col("id") % 5 > 0, F.concat(F.lit("word"), (F.col("id") % 7).cast("string"), F.lit(" and more"))).alias("text"))
    rows = encode_by_model(texts.repartition(8), model, load, batch_size=4).collect()
    opened = [p.name.split("-")[0] for p in marks.iterdir()]
    assert len(rows) == 200 and 1 <= len(opened) == len(set(opened))
    own = load_projection(model)
    told = {r["query_id"]: r["text"] or "" for r in texts.collect()}
    for row in rows:
        assert np.allclose(row["v"], own(pd.Series([told[row["query_id"]]]))[0])


def test_stored_model_reaches_the_workers_of_a_cluster(spark, tmp_path, monkeypatch):
    from textquarry.operators.embedding import encode_by_model, load_projection, save_projection

    def refuse(self, path, recursive=False):
        raise ValueError("outside local mode Spark sends no local folder as a file")

    monkeypatch.setattr(type(spark.sparkContext), "addFile", refuse)
    texts = spark.createDataFrame([(1, "some words"), (2, None)], "query_id long, text string")
    for at in ("plain", "named"):
        model = f"{tmp_path}/{at}"
        save_projection(spark, model, dimensions=4, buckets=16)
        rows = encode_by_model(texts, model if at == "plain" else f"file://{model}/", load_projection).collect()
        own = load_projection(model)
        assert all(np.allclose(r["v"], own(pd.Series([t or ""]))[0]) for r, t in zip(rows, ("some words", None)))


def test_visits_tell_only_what_is_within_reach(spark):
    from textquarry.operators.spatial import _visit, pack_blocks

    matrix = blobs(60, 3, 16, 0.3, 4)
    sites = points_frame(spark, matrix).selectExpr("query_id AS site", "query_id + 1 AS weight", "v", "1 AS block")
    gaps = brute.distances(matrix)
    reaches = [float(np.sort(gaps[i])[i % 6]) if i % 5 else float("inf") for i in range(30)]
    calls = spark.createDataFrame([(i, list(map(float, matrix[i])), reaches[i], 1) for i in range(30)]
                                  + [(99, [1e4] * 16, 2.0, 1)], "site long, v array<double>, reach double, block int")
    seen = {r["site"]: r for r in _visit(calls, pack_blocks(sites), 4).collect()}
    assert 99 not in seen  # nothing is that near to it
    for i in range(30):
        order = np.argsort(gaps[i])[:min(4, i % 6 + 1) if i % 5 else 4]
        assert np.allclose(seen[i]["near"], gaps[i][order]) and seen[i]["copies"] == [int(j) + 1 for j in order]


@pytest.mark.parametrize("dimensions,digits", [(1, 1), (2, 1), (16, 9)])
def test_spanning_edges_of_a_block_by_exact_arithmetic(dimensions, digits):
    from textquarry.operators.blocks import distances
    from textquarry.operators.spatial import spanning_edges

    matrix = np.round(blobs(150, 4, dimensions, 0.4, 2), digits) + 1000.0
    core = brute.core_distances(matrix, 3)
    a, b, w = spanning_edges(matrix, core)
    inside, best = np.arange(150) == 0, np.full(150, np.inf)
    at = 0
    for i in range(149):
        best = np.minimum(best, np.maximum(distances(matrix[at:at + 1], matrix)[0], np.maximum(core, core[at])))
        at = int(np.argmin(np.where(inside, np.inf, best)))
        assert b[i] == at and w[i] == best[at] and inside[a[i]]
        inside[at] = True


@pytest.mark.parametrize("apart,dimensions,digits", [(0, 2, 1), (0.5, 5, 9), (3, 3, 1), (40, 2, 9)])
def test_crossing_edges_complete_the_tree_and_look_at_near_rows_only(monkeypatch, apart, dimensions, digits):
    from textquarry.operators import spatial

    matrix = np.round(blobs(300, 3, dimensions, 0.4, 7), digits) + 1000.0
    matrix[170:, 0] += np.ptp(matrix[:, 0]) * (apart > 3) + apart
    core = brute.core_distances(matrix, 3)
    sides = [(matrix[part], core[part], *spatial.spanning_edges(matrix[part], core[part]))
             for part in (slice(0, 170), slice(170, 300))]
    looked = []
    nearest = spatial._Across.nearest
    monkeypatch.setattr(spatial._Across, "nearest", lambda self, rows, *more: looked.extend(rows) or nearest(self, rows, *more))
    a, b, w = spatial.crossing_edges(*sides)
    edges = [*zip(w, a, b + 170), *zip(sides[0][4], *sides[0][2:4]), *zip(sides[1][4], *(x + 170 for x in sides[1][2:4]))]
    link, lengths = list(range(300)), []

    def root(i):
        while link[i] != i:
            i = link[i]
        return i

    for length, i, j in sorted(edges):
        if root(i) != root(j):
            link[root(i)] = root(j)
            lengths.append(length)
    assert lengths == sorted(spatial.spanning_edges(matrix, core)[2])
    assert apart < 40 or (len(w) == 1 and len(looked) <= 300)


@pytest.mark.parametrize("rung_edges", [0, 100])
def test_links_are_followed_in_one_task_or_in_joins(spark, rung_edges):
    from textquarry.operators.density import _climb

    up = {i: max(i - 2, 0) for i in range(40)} | {50: 50, 51: 50, 52: 60}
    found = _climb(spark.createDataFrame(list(up.items()), "node long, at long"), rung_edges).collect()
    assert {r["node"]: r["at"] for r in found} == {i: 0 for i in range(40)} | {50: 50, 51: 50, 52: 60}


def test_distance_sums_keep_their_digits_and_come_in_bounded_frames():
    from textquarry.operators.blocks import distance_tiles

    source = np.random.default_rng(5)
    matrix = source.normal(size=(1500, 8)) + 1e4
    matrix[1::3] = matrix[::3][:500] + source.normal(size=(500, 8)) * 1e-6
    matrix[2::3] = matrix[::3][:500]
    labels, ids = source.integers(0, 300, 1500), np.arange(1500)
    gaps = brute.distances(matrix)
    whole = np.full((1500, 1500), np.nan)
    for rows, cols, tile in distance_tiles(matrix, matrix):
        whole[rows, cols] = tile
    assert np.allclose(whole, gaps, rtol=1e-8, atol=0)
    member = np.eye(300)[labels]
    sides = [(ids[part], matrix[part], labels[part]) for part in (slice(0, 700), slice(700, 1500))]
    total = np.zeros((1500, 300))
    for same, left, right in ((True, sides[0], sides[0]), (False, *sides), (True, sides[1], sides[1])):
        for frame in metrics._silhouette_kernel(0, same, left, right):
            assert frame["other"].nunique() <= metrics.CLUSTERS
            np.add.at(total, (frame["query_id"], frame["other"]), frame["total"])
            assert (labels[frame["query_id"]] == frame["cluster"]).all()
    assert np.allclose(total, gaps @ member, rtol=1e-8, atol=0)
