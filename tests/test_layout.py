"""The neighbour graph against brute force, and how well layouts keep neighbourhoods."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textquarry.operators import layout
from textquarry.operators.embedding import reduce_dimensions
from textquarry.operators.layout import edge_weights, lay_out, neighbour_graph
from textquarry.plans import tables


def _frame(spark, matrix, name="site"):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)],
                                 f"{name} long, v array<double>")


def _order(matrix):
    gaps = np.sqrt(((matrix[:, None, :] - matrix[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(gaps, np.inf)
    return gaps, np.argsort(gaps, axis=1, kind="stable")


def trustworthiness(matrix, places, k=15):
    n = len(matrix)
    rank = np.empty((n, n), dtype=int)
    rank[np.arange(n)[:, None], _order(matrix)[1]] = np.arange(1, n + 1)
    near = _order(places)[1][:, :k]
    far = np.maximum(np.take_along_axis(rank, near, axis=1) - k, 0).sum()
    return 1 - 2 * far / (n * k * (2 * n - 3 * k - 1))


def test_one_block_is_exact_with_ties(spark):
    matrix = np.random.default_rng(1).integers(0, 6, (300, 3)).astype(float)
    matrix = np.unique(matrix, axis=0)
    gaps, order = _order(matrix)
    found = {(r["site"], r["place"]): (r["neighbour"], r["distance"])
             for r in neighbour_graph(_frame(spark, matrix), 5).collect()}
    assert len(found) == 5 * len(matrix)
    for (site, place), (neighbour, distance) in found.items():
        assert neighbour == order[site, place - 1] and distance == pytest.approx(gaps[site, neighbour])


def test_recall_over_many_blocks(spark):
    source = np.random.default_rng(2)
    matrix = source.normal(size=(20, 24))[source.integers(0, 20, 2500)] * 2 + source.normal(size=(2500, 24))
    order = _order(matrix)[1][:, :10]
    rows = neighbour_graph(_frame(spark, matrix), 10, block_rows=160).collect()
    found = {(r["site"], r["neighbour"]) for r in rows}
    assert len(rows) == len(found) == 25_000
    assert np.mean([(i, j) in found for i in range(2500) for j in order[i]]) >= 0.9


def test_edge_weights_are_the_same_both_ways(spark):
    matrix = np.random.default_rng(3).normal(size=(60, 4))
    weights = {(r["site"], r["neighbour"]): r["w"] for r in edge_weights(neighbour_graph(_frame(spark, matrix), 4)).collect()}
    assert all(0 < w <= 1 + 1e-12 and weights[b, a] == pytest.approx(w) for (a, b), w in weights.items())
    nearest = _order(matrix)[1][:, 0]
    assert all(weights[i, j] == pytest.approx(1) for i, j in enumerate(nearest))


def test_layout_keeps_more_neighbours_than_main_directions(spark, sf_dir):
    points = tables.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))

    def matrix(frame):
        rows = sorted(frame.collect(), key=lambda r: r["query_id"])
        return np.array([r["v"] for r in rows])

    whole = matrix(points)
    whole /= np.linalg.norm(whole, axis=1)[:, None]
    laid, main = (trustworthiness(whole, matrix(f)) for f in (lay_out(points), reduce_dimensions(points)))
    assert laid > main + 0.01


def test_awkward_points(spark):
    none = spark.createDataFrame([], "query_id long, v array<double>")
    assert lay_out(none, 2).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (4, None)],
                                 "query_id long, v array<double>")
    assert [tuple(r["v"]) for r in lay_out(same, 2).collect()] == [(0.0, 0.0)] * 3
    mixed = spark.createDataFrame([(i % 7, [float(i % 5), 1.0, 0.0]) for i in range(40)], "query_id long, v array<double>")
    rows = lay_out(mixed, 2, k=3).collect()
    assert len(rows) == 40 and len({tuple(r["v"]) for r in rows}) == 5
    assert all(np.isfinite(r["v"]).all() for r in rows)


def test_neighbours_in_a_block_need_few_exact_distances(monkeypatch):
    class Packs:
        def select(self, *names):
            return self

        def mapInPandas(self, near, schema):
            return near

    matrix = np.random.default_rng(5).normal(size=(700, 16)).round(1)
    ids = np.random.default_rng(6).permutation(700)
    gaps = np.sqrt(((matrix[:, None, :] - matrix[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(gaps, np.inf)
    cells, exact = [], layout.distances
    monkeypatch.setattr(layout, "distances", lambda a, b: cells.append(len(a) * len(b)) or exact(a, b))
    block = pd.DataFrame({"sites": [ids], "flat": [matrix.ravel()]})
    found = pd.concat(layout._near_in_blocks(Packs(), 5)(iter([block])))
    assert sum(cells) < 700 * 700 / 4
    place = {number: at for at, number in enumerate(ids)}
    for site, near in found.groupby("site"):
        assert np.allclose(near["distance"], np.sort(gaps[place[site]])[:5])
    assert len(found) == 3500
