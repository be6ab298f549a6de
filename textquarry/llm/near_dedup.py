"""Near duplicates by weighted Jaccard similarity of five-word shingles.

BagMinHash: each shingle carries a Poisson process over its discretised weight,
the number of times it occurs. The weight axis is split into blocks [0,1), [1,2),
[2,4), ...; a block has points of its own, each with a place on the axis, so a
block that the weight cuts is split further by the places. A component of the
signature is the earliest point among its own, and two bags agree in it with the
probability of their weighted Jaccard similarity. Points come in order of time,
so those after the latest needed are never made.

Signatures are banded; documents that share a band are candidates. Two bits of every
component tell most pairs apart that are much less alike than asked. In each band
group a pivot is compared with all members, then small groups pair by pair and larger
ones that are not yet of one class by blocks of members (``operators.linking``). So a
large group of copies costs a few comparisons a member, and no pair that shares a band
is left out. Comparisons count the overlap of the whole bags. Classes are connected
components.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import ROW, filled, text_batches, with_rows, without_rows
from textquarry.operators.linking import linked, sharing
from textquarry.session import materialise

WORD = re.compile(r"\w+")
SHINGLE = 5
SIMILARITY = 0.8
#: Two texts of similarity 0.8 share no band with probability (1 - 0.8 ** 5) ** 30 = 7e-6.
BANDS, ROWS = 30, 5
COMPONENTS = BANDS * ROWS
#: Two texts of that similarity are rejected by their short signatures as seldom as this.
MISS = 1e-6
#: Bags whose points are made together.
TOGETHER = 200
#: Bound of the words whose hashes a task keeps.
MOST_WORDS = 100_000


def _mix(values: np.ndarray, seed: int) -> np.ndarray:
    """Well-spread 64-bit hashes of 64-bit values."""
    x = values + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Bags of shingles: sorted distinct hashes and how often each occurs."""

    def __init__(self):
        class Known(dict):
            def __missing__(self, word: str) -> int:
                if len(self) > MOST_WORDS:
                    self.clear()
                number = self[word] = xxhash.xxh64_intdigest(word)
                return number

        self.known = Known()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        words = np.array([known[w] for w in WORD.findall(text.lower())], dtype=np.uint64)
        if not len(words):
            return words, np.zeros(0, dtype=np.int64)
        size = min(SHINGLE, len(words))
        hashed = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for at in range(size):
            hashed = (hashed + words[at:len(words) - size + 1 + at]) * np.uint64(0xD6E8FEB86659FD93)
            hashed ^= hashed >> np.uint64(32)
        return np.unique(hashed, return_counts=True)


def digest(bag: tuple[np.ndarray, np.ndarray]) -> str:
    return hashlib.md5(bag[0].tobytes() + bag[1].tobytes()).hexdigest()


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of COMPONENTS earliest times for each non-empty bag."""
    sizes = np.array([len(b[0]) for b in bags])
    owner = np.repeat(np.arange(len(bags)), sizes)
    shingles = np.concatenate([b[0] for b in bags])
    weights = np.concatenate([b[1] for b in bags])
    totals = np.bincount(owner, weights=weights, minlength=len(bags))
    # blocks of the weight axis: number 0 is [0, 1), number k is [2 ** (k - 1), 2 ** k)
    blocks = [(owner, shingles, weights, np.zeros(len(owner), dtype=np.int64))]
    number = 1
    while (more := weights > (1 << (number - 1))).any():
        blocks.append((owner[more], shingles[more], weights[more],
                       np.full(int(more.sum()), number, dtype=np.int64)))
        number += 1
    owner, shingles, weights, block = (np.concatenate(part) for part in zip(*blocks))
    seeds = _mix(shingles ^ (block.astype(np.uint64) << np.uint64(56)), 11)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    width = np.maximum(low, 1)
    found = np.full((len(bags), COMPONENTS), np.inf)
    # nearly surely, every component has a point before this time
    until = (np.log(COMPONENTS) + 4.0) / totals
    open_bags = np.arange(len(bags))
    while len(open_bags):
        found[open_bags] = np.inf
        is_open = np.zeros(len(bags), dtype=bool)
        is_open[open_bags] = True
        mine = is_open[owner] if len(open_bags) < len(bags) else slice(None)
        o, s, w, lo, wide = owner[mine], seeds[mine], weights[mine], low[mine], width[mine]
        time = np.zeros(len(o))
        turn = 0
        while len(o):
            drawn = _mix(s, 2 * turn + 100)
            # a uniform number in (0, 1] makes the wait for the next point
            time = time - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53) / (
                COMPONENTS * wide)
            alive = time <= until[o]
            o, s, w, lo, wide, time = (part[alive] for part in (o, s, w, lo, wide, time))
            place = _mix(s, 2 * turn + 101)
            inside = lo + ((place >> np.uint64(32)).astype(np.int64) * wide >> 32) < w
            component = ((place & np.uint64(0xFFFFFFFF)) * np.uint64(COMPONENTS) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(found, (o[inside], component[inside]), time[inside])
            turn += 1
        open_bags = open_bags[np.isinf(found[open_bags]).any(axis=1)]
        until[open_bags] *= 2
    return found


def band_keys(found: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys per signature, different for each band."""
    bits = found.view(np.uint64).reshape(len(found), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(found), BANDS)).copy()
    for row in range(ROWS):
        keys = _mix(keys * np.uint64(31) + bits[:, :, row], row + 1)
    return keys.view(np.int64)


def short_signatures(found: np.ndarray) -> np.ndarray:
    """Two bits of each component, 32 components in a number."""
    two = (_mix(found.view(np.uint64).reshape(found.shape), 7) >> np.uint64(62)).astype(np.uint64)
    two = np.pad(two, ((0, 0), (0, -found.shape[1] % 32))).reshape(len(found), -1, 32)
    return (two << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)


def most_differences(similarity: float) -> int:
    """How many components may differ in their two bits, so that a pair of that similarity
    differs in more with probability ``MISS`` at most."""
    agree = similarity + (1 - similarity) / 4
    missed, differences = 1.0, -1
    while missed > MISS and differences < COMPONENTS:
        differences += 1
        missed -= math.comb(COMPONENTS, differences) * (1 - agree) ** differences * agree ** (COMPONENTS - differences)
    return differences


def alike(similarity: float) -> Callable[[str, str], Column]:
    limit = most_differences(similarity)

    def differing(left: str, right: str, part: int) -> Column:
        x = F.col(left)[part].bitwiseXOR(F.col(right)[part])
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    def agreeing(left: str, right: str) -> Column:
        # written out, as lambdas are not compiled
        return sum(differing(left, right, part) for part in range(-(-COMPONENTS // 32))) <= limit

    return agreeing


def sketches(keyed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, digest, n, bands, bits), stored; the last four are null or 0 without words."""
    text_batches(keyed.sparkSession)

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            bags = [shingler(text) for text in batch["text"]]
            full = [b for b in bags if len(b[0])]
            made = (signatures(full[at:at + TOGETHER]) for at in range(0, len(full), TOGETHER))
            keys = (key for found in made for key in zip(band_keys(found), short_signatures(found)))
            known = [next(keys) if len(b[0]) else (None, None) for b in bags]
            yield pd.DataFrame({
                "file": batch["file"], "at": batch["at"], "doc_id": batch["doc_id"],
                "digest": [digest(b) if len(b[0]) else None for b in bags],
                "n": [int(b[1].sum()) for b in bags],
                "bands": [k[0] for k in known], "bits": [k[1] for k in known]})

    # as text, since pandas would make numbers with nulls among them inexact
    rows = keyed.select(f"{ROW}.*", F.col(f"`{id_col}`").cast("long").cast("string").alias("doc_id"),
                        filled(F.col(f"`{text_col}`").cast("string")).alias("text"))
    found = rows.mapInPandas(
        sketched, "file long, at long, doc_id string, digest string, n long, bands array<long>, bits array<long>")
    return materialise(found.select(F.struct("file", "at").alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                                    "digest", "n", "bands", "bits"), "sketches")


def bags_of(keyed: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """(node, bag) of the given nodes: hashes with repeats told apart, stored."""

    def bagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            bags = [shingler(text) for text in batch["text"]]
            yield pd.DataFrame({
                "digest": [digest(b) for b in bags],
                "bag": [_mix(np.repeat(h, c) + (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)).astype(
                    np.uint64), 5).view(np.int64) for h, c in bags]})

    rows = keyed.select(ROW, filled(F.col(f"`{text_col}`").cast("string")).alias("text"))
    wanted = rows.join(nodes.select(F.col("first.row").alias(ROW)), ROW, "left_semi").select("text")
    bags = wanted.mapInPandas(bagged, "digest string, bag array<long>")
    return materialise(bags.join(nodes.select("node", "digest"), "digest").select("node", "bag"), "bags")


def _linked(keyed: DataFrame, nodes: DataFrame, similarity: float, text_col: str) -> DataFrame | None:
    """(node, comp) of all nodes that are similar to another; None if there is none."""
    members = sharing(nodes.select("node", "n", "bits", F.explode("bands").alias("band")))
    candidates = nodes.join(members.select("node").distinct(), "node", "left_semi")
    return linked(members, bags_of(keyed, candidates, text_col), similarity, alike(similarity))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document with the class of its near duplicates.

    Words are runs of letters, digits and underscores, in lower case; shingles are
    five words, a shorter text is one shingle. Bags of shingles are similar when
    their weighted Jaccard similarity reaches ``similarity``. The class id is the
    smallest doc_id of the class. Texts without words (null, empty, signs only)
    are classes of their own. Repeated rows and rows without an id are members like
    others; a class has the null id only if no member has another. An empty table gives
    no rows. Further columns are ignored.
    Columns: doc_id, class_id, class_size, kept (one row of each class).
    """
    return _classes(with_rows(docs), similarity, id_col, text_col).drop("row")


def _classes(keyed: DataFrame, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    sketched = sketches(keyed, id_col, text_col)
    full = sketched.where(F.col("digest").isNotNull())
    nodes = materialise(full.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first"),
        F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"),
        F.count("*").alias("count")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    comps = _linked(keyed, nodes, similarity, text_col)
    classed = nodes.select("node", "digest", "first", "count")
    if comps is None:
        classed = classed.withColumn("comp", F.col("node"))
    else:
        classed = classed.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classed = materialise(classed, "classes")
    whole = classed.groupBy("comp").agg(F.min("first").alias("first"), F.sum("count").alias("class_size"))
    known = classed.select("comp", "digest").join(whole, "comp").select("digest", "first", "class_size")
    out = sketched.select("row", "doc_id", "digest").join(known, "digest", "left")
    alone = F.col("digest").isNull()
    return out.select(
        "row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"))


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns: that of the smallest id, one row
    where it repeats. Rows without an id are kept. An empty table stays empty."""
    keyed = with_rows(docs)
    return without_rows(keyed, _classes(keyed, similarity).where(~F.col("kept") & F.col("doc_id").isNotNull()))
