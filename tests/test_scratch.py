"""What queries leave on disk while they run, and that less of it gives the same rows."""
from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry import session
from textquarry.operators import density, near, placing, spatial
from textquarry.plans import clustering


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}")
    return tmp_path


def _shuffled(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def _labels(folder: Path) -> set[str]:
    return {path.name.rsplit("-", 1)[0] for path in folder.iterdir()}


def test_a_stored_table_leaves_no_shuffle_behind(spark, folder):
    before = _shuffled(spark)
    stored = session.materialise(spark.range(200_000).groupBy((F.col("id") * 7 % 199_999).alias("k")).count(), "kept")
    assert stored.count() == 199_999
    assert _shuffled(spark) - before < 100_000
    assert spark.conf.get(session.CLEANUP_CONF) == "false"
    session.discard(stored)
    assert _labels(folder) == set()


def _similar(texts: list[str]) -> list[set]:
    def bag(text: str) -> set:
        words = text.split(" ")
        return {tuple(words[i:i + near.SHINGLE]) for i in range(max(1, len(words) - near.SHINGLE + 1))} if text else set()
    return [bag(t) for t in texts]


def test_near_duplicates_drops_texts_and_lonely_bags(spark, folder):
    source = random.Random(3)
    texts = []
    for family in range(12):
        base = [f"w{source.randrange(60 if family < 6 else 4000)}" for _ in range(source.randrange(5, 90))]
        for _ in range(4):
            words = list(base)
            for _ in range(source.randrange(3)):
                words[source.randrange(len(words))] = f"x{source.randrange(9)}"
            texts.append(" ".join(words))
    texts += ["", "a", "a", " ".join(f"lone{i}" for i in range(300))]
    rows = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "query_id long, query_sql string")
    found = near.near_duplicates(rows).collect()
    bags = _similar(texts)
    group = list(range(len(texts)))
    for i, one in enumerate(bags):
        for j, two in enumerate(bags[:i]):
            if texts[i] == texts[j] or (one | two and len(one & two) >= near.SIMILARITY * len(one | two)):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(i % 50 for i in range(len(texts)) if group[i] == g) for g in group}
    assert sorted((r["query_id"], r["group_id"]) for r in found) == sorted(
        (i % 50, least[group[i]]) for i in range(len(texts)))
    # neither the texts nor the bags of all of them stay
    assert not {"texts", "bags", "rarity"} & _labels(folder)


def test_only_texts_that_share_enough_stay_candidates(spark, folder):
    rows = [(0, 10, list(range(10))), (1, 10, list(range(10, 20))), (2, 10, [*range(8), 98, 99]), (3, 10, [*range(7), 90, 91, 92])]
    parts = [spark.createDataFrame(rows, "node long, n int, bag array<long>")]
    # of ten shingles a similar text shares eight
    assert sorted(r["node"] for r in near._open_bags(parts, 0.8).collect()) == [0, 2]


def _points(spark, n: int = 400, width: int = 12):
    source = np.random.default_rng(5)
    rows = [(i, [float(x) for x in source.standard_normal(width) + 3 * (i % 3)]) for i in range(n)]
    return spark.createDataFrame(rows + [(n, rows[0][1])], "query_id long, v array<double>")


def test_blocks_are_sent_by_chunks_and_leave_nothing(spark, folder, monkeypatch):
    points = _points(spark).cache()
    members, tree = density.fit_density(points, 5)
    plain = {r["site"]: r["cluster"] for r in members.collect()}

    def joined(*_):
        raise AssertionError("a row for each pair of blocks")

    moved = points.withColumn("v", F.transform("v", lambda x: x + F.lit(0.01)))
    monkeypatch.setattr(spatial, "CHUNK_NUMBERS", 1500)
    with monkeypatch.context() as m:
        m.setattr(spatial, "_met", joined)
        before = _labels(folder)
        found, _ = density.fit_density(points, 5, block_rows=32)
        assert not {"packs", "sites", "near", "callers", "seen", "trees", "pool", "crossing", "met"} & (_labels(folder) - before)
        assert {r["site"]: r["cluster"] for r in found.collect()} == plain and len(set(plain.values())) > 2
        index = placing.index_clustering(members, tree, block_rows=32)
        by_chunks = {tuple(r) for r in placing.place_points(moved, index).collect()}
    # the other way, taken where chunks are many and few blocks meet
    monkeypatch.setattr(spatial, "_few", lambda *_: True)
    assert {tuple(r) for r in placing.place_points(moved, index).collect()} == by_chunks
    points.unpersist()


def test_a_chunk_is_bounded_and_no_block_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CHUNK_NUMBERS", 1000)
    sites = _points(spark, 300).select(F.col("query_id").alias("site"), F.lit(1).alias("weight"), "v")
    blocked, blocks = spatial.partition_sites(sites, 32)
    packs = spatial.pack_blocks(blocked).cache()
    chunks = list(spatial._chunks(packs, list(range(blocks))))
    assert len(chunks) > 2 and max(sum(b.matrix.size for b in chunk) for chunk in chunks) <= 1000
    assert sorted(s for chunk in chunks for b in chunk for s in b.sites) == list(range(301))


def test_scored_corpus_is_not_kept(spark, folder):
    rows = [(i % 30, f"name {i % 5}", f"about topic{i % 5} word{i % 3}", [], None, "SELECT 1") for i in range(60)]
    corpus = spark.createDataFrame(
        rows, "query_id long, name string, description string, tags array<string>, owner string, query_sql string")
    run = clustering.cluster_corpus(corpus, "semantic", min_cluster_size=3, dimensions=32, components=2)
    before = len([path for path in folder.iterdir() if path.name.startswith(("corpus", "texts"))])
    scored = clustering.score_corpus(run.models, corpus)
    own = run.clustered.select("query_id", "cluster").collect()
    assert sorted((r["query_id"], r["cluster"]) for r in scored.collect()) == sorted(tuple(r) for r in own)
    assert len([path for path in folder.iterdir() if path.name.startswith(("corpus", "texts"))]) == before
