"""Classes of similar rows from groups of candidates, without comparing all pairs.

Rows that share a group may be similar. In each group a pivot is compared with all
members, so a large group of copies costs a few comparisons a member; in small groups
all pairs that are not yet of one class follow. Larger groups that are still of several
classes are joined to families, whose members are compared block by block:
a pair of blocks is a row, a pair of members is not, and a block goes out once for each
other block of its family. No pair that shares a group is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import discard, materialise

#: Groups up to this size are compared pair by pair after their first pivot.
PIVOTS = 8
#: Members of a block, and numbers in their bags, about.
BLOCK_NODES, BLOCK_NUMBERS = 2048, 1 << 20
#: Numbers that more than this share of the pairs have are counted by a product of matrices.
COMMON = 1 / 64
#: Columns of such a matrix, pairs counted one by one at a time.
COLUMNS, STRIP = 1024, 1 << 22


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each node's component, for nodes with an edge.

    Large-star and small-star steps in turn: neighbours are hung on the smallest
    one until every component is a star.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .where("a <> b").distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(lowest, "a")
        known, edges = edges, materialise(hung.select("a", F.col("m").alias("b")).union(
            hung.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "stars")
        discard(known)
        parents = edges.select(F.col("b").alias("a")).distinct()
        loose = edges.join(parents, "a", "left_semi").limit(1).count() or \
            edges.groupBy("a").count().where("count > 1").limit(1).count()
        if not loose:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    found = materialise(edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots), "components")
    discard(edges)
    return found


def _verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    left = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    return pairs.join(left, "a").join(right, "b").withColumn("shared", shared).select(
        "a", "b", (F.col("shared") / (F.size("bag_a") + F.size("bag_b") - F.col("shared")))
        .alias("similarity")).where(F.col("similarity") >= similarity)


def sharing(exploded: DataFrame) -> DataFrame:
    """The rows of ``exploded`` (node, n, band: the groups of each node, and the size of
    its bag) whose group has another member, stored."""
    # two sums of hashes tell the member sets of groups apart; of groups with the same
    # members one is enough
    groups = exploded.groupBy("band").agg(
        F.count("*").alias("count"), F.sum(F.shiftright(F.xxhash64("node"), 20)).alias("one"),
        F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 20)).alias("two")).where("count > 1")
    single = groups.groupBy("count", "one", "two").agg(F.min("band").alias("band"))
    shared = materialise(exploded.join(single.select("band", "count"), "band"), "shared")
    # first come nodes that meet many others: the middle of a family is alike to most
    met = shared.groupBy("node").agg((-F.sum("count")).alias("met"))
    return materialise(shared.join(met, "node").withColumn(
        "place", F.struct("met", F.xxhash64("node").alias("hash"), "node")).drop("met"), "members")


def shared_numbers(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many numbers each bag of one side shares with each of the other.

    A side is the sizes of its bags and their numbers, one bag after the other.
    """
    (sizes_a, flat_a), (sizes_b, flat_b) = left, right
    numbers, of = np.unique(np.concatenate([flat_a, flat_b]), return_inverse=True)
    of_a, of_b = of[:len(flat_a)], of[len(flat_a):]
    own_a, own_b = np.repeat(np.arange(len(sizes_a)), sizes_a), np.repeat(np.arange(len(sizes_b)), sizes_b)
    count_a, count_b = np.bincount(of_a, minlength=len(numbers)), np.bincount(of_b, minlength=len(numbers))
    out = np.zeros((len(sizes_a), len(sizes_b)), dtype=np.float32)
    meet = count_a * count_b
    common = meet > COMMON * out.size
    column = np.cumsum(common) - 1
    in_a, in_b = np.flatnonzero(common[of_a]), np.flatnonzero(common[of_b])
    for start in range(0, int(common.sum()), COLUMNS):
        sides = []
        for own, number, inside, size in ((own_a, of_a, in_a, len(sizes_a)), (own_b, of_b, in_b, len(sizes_b))):
            at = column[number[inside]] - start
            mine = (at >= 0) & (at < COLUMNS)
            matrix = np.zeros((size, COLUMNS), dtype=np.float32)
            matrix[own[inside[mine]], at[mine]] = 1
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    # the others: each entry of one side meets all entries of the other with its number
    order = np.argsort(of_b, kind="stable")
    begins = np.cumsum(count_b) - count_b
    entries = np.flatnonzero(~common[of_a] & (count_b[of_a] > 0))
    met = count_b[of_a[entries]]
    strip = np.cumsum(met) // STRIP
    flat = out.ravel()
    for part in np.split(np.arange(len(entries)), np.flatnonzero(np.diff(strip)) + 1):
        times, number = met[part], of_a[entries[part]]
        at = np.repeat(begins[number] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        np.add.at(flat, np.repeat(own_a[entries[part]], times) * out.shape[1] + own_b[order[at]], 1)
    return out


def _compared(blocks: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Links of pairs of blocks that join classes, as many as it takes to join these."""
    for batch in blocks:
        for row in batch.itertuples(index=False):
            nodes_a, nodes_b = np.asarray(row.left_nodes), np.asarray(row.right_nodes)
            left = [np.asarray(row.left_sizes), np.asarray(row.left_flat)]
            right = [np.asarray(row.right_sizes), np.asarray(row.right_flat)]
            shared = shared_numbers(left, right).astype(np.float64)
            total = left[0][:, None] + right[0][None, :] - shared
            alike = shared / total >= similarity
            label = np.concatenate([np.asarray(row.left_comps), np.asarray(row.right_comps)])
            found = []
            for at in np.flatnonzero(alike.any(axis=1)):
                near = np.flatnonzero(alike[at])
                classes, first = np.unique(label[len(nodes_a) + near], return_index=True)
                for other, one in zip(classes, first):
                    if other != label[at]:
                        found.append((nodes_a[at], nodes_b[near[one]]))
                        label[label == other] = label[at]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])


def _linked_by_blocks(active: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of links that join the classes of active members (node, n, band, comp), stored."""
    groups = materialise(active.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("size")), "groups")
    family = components(active.join(groups, "band").select(F.col("node").alias("a"), "b")).select(
        "node", F.col("comp").alias("family"))
    # a family is compared as one, unless its groups have fewer pairs
    held = materialise(active.select("node", "n", "comp", "band").join(family, "node"), "families")
    pairs = held.select("family", "band").distinct().join(groups, "band").groupBy("family").agg(
        F.sum(F.col("size") * F.col("size")).alias("apart"))
    sizes = held.select("family", "node").distinct().groupBy("family").count()
    whole = pairs.join(sizes, "family").select(
        "family", (F.col("count") * F.col("count") <= F.col("apart")).alias("whole"))
    open_nodes = materialise(held.join(whole, "family").select(
        "node", "n", "comp", "whole", F.when(F.col("whole"), F.col("family")).otherwise(F.col("band"))
        .alias("family")).distinct(), "compared")
    needed = open_nodes.groupBy("whole", "family").agg(F.ceil(F.greatest(
        F.count("*") / F.lit(BLOCK_NODES), F.sum("n") / F.lit(BLOCK_NUMBERS))).cast("int").alias("n_blocks"))
    placed = open_nodes.join(needed, ["whole", "family"]).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("n_blocks").cast("long")).cast("int"))
    # about BLOCK_NODES rows per block, however large the family is
    blocks = placed.join(bags, "node").groupBy("whole", "family", "n_blocks", "block").agg(
        F.collect_list(F.struct("node", "comp", "bag")).alias("rows"))
    side = F.struct("block", F.col("rows.node").alias("nodes"), F.col("rows.comp").alias("comps"),
                    F.transform("rows", lambda r: F.size(r["bag"])).alias("sizes"),
                    F.flatten("rows.bag").alias("flat"))
    sent = blocks.select("whole", "family", side.alias("side"),
                         F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    # one or two blocks per key
    met = sent.groupBy("whole", "family", F.least("side.block", "other").alias("i"),
                       F.greatest("side.block", "other").alias("j")).agg(
        F.array_sort(F.collect_list("side")).alias("sides"))
    first, last = F.col("sides")[0], F.element_at("sides", -1)
    complete = (F.col("i") == F.col("j")) | (F.size("sides") == 2)
    columns = met.where(complete).select(*[
        part[f].alias(f"{name}_{f}") for name, part in (("left", first), ("right", last))
        for f in ("nodes", "comps", "sizes", "flat")])
    return materialise(columns.mapInPandas(
        lambda batches: _compared(batches, similarity), "a long, b long"), "links")


def linked(members: DataFrame, bags: DataFrame, similarity: float,
           alike: Callable[[str, str], Column] | None = None) -> DataFrame | None:
    """(node, comp) of all nodes that are similar to another; None if there is none.

    ``members`` come from :func:`sharing`; ``bags`` has (node, bag) of each of them, a
    bag being distinct numbers. Similarity is shared numbers over all numbers. ``alike``
    may reject a pair before its bags are fetched, by the columns ``bits`` of the members
    whose names it is given.
    """
    largest = members.agg(F.max("count")).first()[0] or 0
    tested = comps = None

    def still_active(least: int, most: int) -> DataFrame:
        labelled = members.withColumn("comp", F.col("node")) if comps is None else members.join(
            comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        labelled = materialise(labelled, "labelled")
        several = labelled.where(F.col("count").between(least, most)).groupBy("band").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        return materialise(labelled.join(several.select("band"), "band", "left_semi"), "active")

    def joined(found: DataFrame) -> DataFrame:
        return components(found if comps is None else found.union(
            comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))

    for done, pivots, most in ((0, 1, largest), (1, PIVOTS, PIVOTS)):
        if largest <= done:
            break
        active = still_active(done + 1, most)
        order = Window.partitionBy("band").orderBy("place")
        chosen = active.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pivots).where(
            F.col("rank") > done).select("band", F.col("node").alias("p"), F.col("n").alias("p_n"),
                                         F.col("comp").alias("p_comp"), F.col("place").alias("p_place"),
                                         *([F.col("bits").alias("p_bits")] if alike else []))
        # members before the pivot have been pivots themselves
        pairs = chosen.join(active, "band").where(
            (F.col("place") > F.col("p_place")) & (F.col("comp") != F.col("p_comp"))
            & (F.least("n", "p_n") >= F.lit(similarity) * F.greatest("n", "p_n") - F.lit(1e-9))
            & (alike("bits", "p_bits") if alike else F.lit(True))).select(
            F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = tested = materialise(pairs, "pairs")
        if not pairs.isEmpty():
            found = materialise(_verified(pairs, bags, similarity).select("a", "b"), "links")
            if not found.isEmpty():
                comps = joined(found)
    if largest > PIVOTS:
        active = still_active(PIVOTS + 1, largest)
        if not active.isEmpty():
            found = _linked_by_blocks(active, bags, similarity)
            if not found.isEmpty():
                comps = joined(found)
    return comps
