"""Reduction that keeps neighbourhoods: a graph of nearest neighbours and a layout of it.

Blocks of several trees of cuts, each over vectors turned another way, give first
neighbours. Then neighbours of neighbours are compared: each site gathers its few
neighbours and tells those that are nearer to each other than what they know. The
layout starts from the main directions, is smoothed along the graph by power steps on
its normalised Laplacian, and is spread by rounds in which edges pull and a sample of
all sites pushes. No step gathers more than a block or a site's k neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.operators.blocks import distances
from textquarry.operators.density import distinct_sites
from textquarry.operators.embedding import REDUCED_DIMENSIONS, reduce_dimensions
from textquarry.operators.spatial import (
    BLOCK_ROWS, block_matrix, first_in_rows, hits, pack_blocks, partition_sites, squares)
from textquarry.session import materialise

NEIGHBOURS = 15
TREES = 3
#: Rounds of comparing neighbours of neighbours.
DESCENTS = 3
POWER_STEPS = 5
FORCE_ROUNDS = 10
#: Sites that push all others in a round; also the bound of what reaches the driver.
PUSHERS = 256
#: Half the width that a layout starts with, and the strongest push of one site.
SPREAD = 5.0
STRONGEST = 4.0
STRIP = 256

_EDGES = "site long, neighbour long, distance double"


def _turned(sites: DataFrame, turn: int) -> DataFrame:
    """The sites in a space turned by a random rotation, which keeps distances; turn 0 is none."""
    if turn == 0:
        return sites

    @F.pandas_udf("array<double>")
    def rotated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rotation = None
        for vectors in batches:
            matrix = np.stack(vectors.to_numpy())
            if rotation is None:
                shape = (matrix.shape[1], matrix.shape[1])
                rotation = np.linalg.qr(np.random.default_rng(turn).standard_normal(shape))[0]
            yield pd.Series(list(matrix @ rotation))

    return sites.withColumn("v", rotated("v"))


def _near_in_blocks(packs: DataFrame, k: int) -> DataFrame:
    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = np.asarray(row.sites)
                order = np.argsort(ids)  # so that places settle ties by id
                ids, matrix = ids[order], block_matrix(row)[order]
                wanted = min(k, len(ids) - 1)
                for start in range(0, len(ids) if wanted else 0, STRIP):
                    part = matrix[start:start + STRIP]
                    rough, off = squares(part, matrix)
                    rough[np.arange(len(part)), start + np.arange(len(part))] = np.inf
                    kth = np.partition(rough, wanted - 1, axis=1)[:, wanted - 1]
                    at, other, gaps = hits(part, matrix, np.sqrt(np.maximum(kth + 2 * off, 0.0)))
                    apart = other != at + start
                    at, other, gaps = at[apart], other[apart], gaps[apart]
                    kept = first_in_rows(at, np.lexsort((other, gaps, at)), wanted)
                    yield pd.DataFrame({"site": ids[start + at[kept]], "neighbour": ids[other[kept]],
                                        "distance": gaps[kept]})

    return packs.select("block", "sites", "flat").mapInPandas(near, _EDGES)


def _best(edges: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("site").orderBy("distance", "neighbour")
    single = edges.groupBy("site", "neighbour").agg(F.min("distance").alias("distance"))
    return single.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _told(graph: DataFrame, sites: DataFrame, k: int) -> DataFrame:
    """Edges between two neighbours of a site, or it and one, that are nearer than what the
    first one of them knows."""
    reach = graph.groupBy("site").agg(F.max("distance").alias("reach"), F.count("*").alias("known"))
    known = sites.join(reach, "site", "left").select(
        F.col("site").alias("neighbour"), "v",
        F.when(F.col("known") >= k, F.col("reach")).otherwise(float("inf")).alias("reach"))
    around = graph.select("site", "neighbour").union(sites.select("site", F.col("site").alias("neighbour")))
    groups = around.join(known, "neighbour").groupBy("site").agg(
        F.collect_list(F.struct("neighbour", "reach", "v")).alias("rows")).select(
        F.col("rows.neighbour").alias("sites"), F.col("rows.reach").alias("reaches"),
        F.flatten("rows.v").alias("flat"))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                ids, matrix = np.asarray(row.sites), block_matrix(row)
                gaps = distances(matrix, matrix)
                np.fill_diagonal(gaps, np.inf)
                a, b = np.nonzero(gaps < np.asarray(row.reaches)[:, None])
                found.append((ids[a], ids[b], gaps[a, b]))
            columns = [np.concatenate(part) for part in zip(*found)] if found else [[], [], []]
            yield pd.DataFrame(dict(zip(("site", "neighbour", "distance"), columns)))

    return groups.mapInPandas(told, _EDGES)


def neighbour_graph(sites: DataFrame, k: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS, trees: int = TREES,
                    descents: int = DESCENTS) -> DataFrame:
    """(site, neighbour, distance, place): the k nearest other sites of each, stored.

    ``sites`` are distinct vectors (site, v). Within one block the result is exact, ties
    go to the smaller id; beyond, more ``trees`` and ``descents`` find more of the true
    neighbours. Rounds end early when one tells nothing new.
    """
    sites = materialise(sites.select("site", "v"), "sites")
    found, turn = None, 0
    while turn < max(1, trees):
        blocked, blocks = partition_sites(_turned(sites, turn), block_rows)
        near = _near_in_blocks(pack_blocks(blocked), k)
        found = near if found is None else found.union(near)
        if blocks == 1:
            return materialise(_best(found, k), "graph")
        turn += 1
    graph = materialise(_best(found, k), "graph")
    for _ in range(descents):
        news = materialise(_told(graph, sites, k), "told")
        if news.isEmpty():
            break
        graph = materialise(_best(graph.drop("place").union(news), k), "graph")
    return graph


def edge_weights(graph: DataFrame) -> DataFrame:
    """(site, neighbour, w) in both directions: how surely either is the other's neighbour.

    A site's nearest neighbour weighs 1, farther ones less on the scale of its own distances.
    """
    scale = graph.groupBy("site").agg(F.min("distance").alias("least"), F.avg("distance").alias("mean"))
    beyond = F.col("mean") - F.col("least")
    weight = F.when(beyond > 0, F.exp((F.col("least") - F.col("distance")) / beyond)).otherwise(1.0)
    one = graph.join(scale, "site").select("site", "neighbour", weight.alias("w"))
    both = one.union(one.select("neighbour", "site", "w"))
    return both.groupBy("site", "neighbour").agg(
        (F.sum("w") - F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("w"))


def _names(dimensions: int) -> list[str]:
    return [f"x{i}" for i in range(dimensions)]


def _evened(placed: DataFrame, dimensions: int) -> list[Column]:
    """The axes centred and made orthonormal, sites weighing as much as their edges."""
    names = _names(dimensions)
    pairs = [(i, j) for i in range(dimensions) for j in range(i, dimensions)]
    row = placed.agg(
        F.sum("degree").alias("total"), *[F.sum(F.col("degree") * F.col(n)).alias(n) for n in names],
        *[F.sum(F.col("degree") * F.col(names[i]) * F.col(names[j])).alias(f"{i}_{j}") for i, j in pairs]).first()
    mean = np.array([row[n] for n in names]) / row["total"]
    gram = np.zeros((dimensions, dimensions))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"{i}_{j}"] / row["total"] - mean[i] * mean[j]
    values, axes = np.linalg.eigh(gram)
    # an axis without extent stays at zero
    real = values > 1e-12 * max(values.max(), 1e-300)
    turn = axes * np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)
    return [sum((F.col(names[i]) - float(mean[i])) * float(turn[i, j]) for i in range(dimensions)).alias(names[j])
            for j in range(dimensions)]


def smoothed(start: DataFrame, edges: DataFrame, dimensions: int, steps: int = POWER_STEPS) -> DataFrame:
    """(site, x0, ...): the axes after power steps on the normalised Laplacian of the graph."""
    names = _names(dimensions)
    degrees = edges.groupBy("site").agg(F.sum("w").alias("degree"))
    placed = materialise(start.join(degrees, "site"), "placed")
    for _ in range(steps):
        even = placed.select("site", "degree", *_evened(placed, dimensions))
        others = even.select(F.col("site").alias("neighbour"), *names)
        moved = edges.join(others, "neighbour").groupBy("site").agg(
            *[F.sum(F.col("w") * F.col(n)).alias(f"near_{n}") for n in names])
        placed = materialise(even.join(moved, "site").select("site", "degree", *[
            (F.col(n) / 2 + F.col(f"near_{n}") / F.col("degree") / 2).alias(n) for n in names]), "placed")
    return placed.select("site", *_evened(placed, dimensions))


def _pushed(others: np.ndarray):
    """Mean push away from the given places."""

    @F.pandas_udf("array<double>")
    def pushed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for places in batches:
            own = np.stack(places.to_numpy())
            total = np.zeros_like(own)
            for other in others:
                apart = own - other
                square = (apart * apart).sum(axis=1)[:, None]
                total += np.minimum(2 / ((0.01 + square) * (1 + square)), STRONGEST) * apart
            yield pd.Series(list(total / len(others)))

    return pushed


def spread(start: DataFrame, edges: DataFrame, dimensions: int, rounds: int = FORCE_ROUNDS,
           pushers: int = PUSHERS) -> DataFrame:
    """(site, x0, ...): the layout after rounds of pulling edges and pushing sites."""
    names = _names(dimensions)
    widest = F.greatest(*[F.max(F.abs(n)) for n in names], F.lit(0.0)).alias("widest")
    scale = SPREAD / (start.agg(widest).first()["widest"] or 1.0)
    placed = materialise(start.select("site", *[(F.col(n) * scale).alias(n) for n in names]), "placed")
    for turn in range(rounds):
        step = 1 - turn / rounds
        # the pushers of this round, by a hash; a bounded number, so they may be collected
        some = placed.orderBy(F.xxhash64("site", F.lit(turn)), "site").limit(pushers).select(*names).collect()
        others = placed.select(F.col("site").alias("neighbour"), *[F.col(n).alias(f"o_{n}") for n in names])
        ahead = [F.col(f"o_{n}") - F.col(n) for n in names]
        strength = F.col("w") * 2 / (1 + sum(a * a for a in ahead))
        pulls = edges.join(others, "neighbour").join(placed, "site").groupBy("site").agg(
            F.sum("w").alias("degree"), *[F.sum(strength * a).alias(f"o_{n}") for n, a in zip(names, ahead)])
        both = placed.join(pulls, "site", "left").withColumn("push", _pushed(np.array(some))(F.array(*names)))
        placed = materialise(both.select("site", *[
            (F.col(n) + step * (F.coalesce(F.col(f"o_{n}") / F.col("degree"), F.lit(0.0)) + F.col("push")[i]))
            .alias(n) for i, n in enumerate(names)]), "placed")
    return placed


def lay_out(points: DataFrame, dimensions: int = REDUCED_DIMENSIONS, k: int = NEIGHBOURS,
            block_rows: int = BLOCK_ROWS, steps: int = POWER_STEPS, rounds: int = FORCE_ROUNDS) -> DataFrame:
    """(query_id, v): the points (query_id, v) in few dimensions, near ones kept near.

    Equal vectors share a place. Points without a vector are left out; with fewer than two
    different vectors all lie at zero.
    """
    points = points.where(F.col("v").isNotNull()).select("query_id", F.col("v").cast("array<double>").alias("v"))
    # ids may repeat, so sites get a number of their own
    sites = materialise(distinct_sites(points).select(
        F.monotonically_increasing_id().alias("site"), "v"), "sites")
    names = _names(dimensions)
    if len(sites.take(2)) < 2:
        return points.select("query_id", F.array(*[F.lit(0.0)] * dimensions).alias("v"))
    edges = materialise(edge_weights(neighbour_graph(sites, k, block_rows)), "edges")
    main = reduce_dimensions(sites.withColumnRenamed("site", "query_id"), dimensions)
    start = main.select(F.col("query_id").alias("site"), *[F.col("v")[i].alias(n) for i, n in enumerate(names)])
    placed = spread(smoothed(start, edges, dimensions, steps), edges, dimensions, rounds)
    at = sites.join(placed, "site").select("v", F.array(*names).alias("place"))
    return points.join(at, "v").select("query_id", F.col("place").alias("v"))
