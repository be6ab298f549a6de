import zlib

import cases
import numpy as np
from pyspark.sql import functions as F
from textquarry.llm import quality
from textquarry.llm.common import documents, table


def brute(texts, model):
    """Votes one text and one neighbour at a time, on terms counted word by word."""
    terms, scores = quality.Terms(), []
    for text in texts:
        counts = terms(text).astype(float)
        total = max(counts[:-len(quality.WHOLE)].sum(), 1.0)
        vector = (np.sqrt(counts / total) * model.weights) @ model.directions
        length = np.sqrt(sum(x * x for x in vector))
        near = sorted(((float(sum(a * b for a, b in zip(vector, other))) / length if length else 0.0, float(label))
                       for other, label in zip(model.vectors, model.labels)), reverse=True)[:quality.NEIGHBOURS]
        weight = sum(max(n, 0.0) for n, _ in near)
        scores.append(sum(max(n, 0.0) * y for n, y in near) / weight if weight else model.share)
    return scores


def test_scores_equal_brute_force(spark, sf_dir, monkeypatch):
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    monkeypatch.setattr(quality, "BLOCK", 30)  # several blocks of labelled vectors
    texts = [r["text"] or "" for r in docs.limit(60).collect()] + ["", "  ", "!"]
    counts = np.stack([quality.Terms()(t) for t in texts])
    assert len(model.vectors) > 60
    assert np.allclose(quality.votes(counts, model), brute(texts, model), atol=1e-3)


def test_held_out_accuracy(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.1"), table(spark, "/root/testdata/sf0.1", "labels")
    found = quality.quality(docs, labels)
    rows = found.join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    truth, got = np.array([r["quality"] for r in rows]), np.array([r["predicted"] for r in rows])
    assert (truth == got).mean() > 0.98 and (got[truth == 0] == 0).mean() > 0.95


def test_labels_of_other_folds_decide_nothing(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(
        F.col("quality")))
    first, second = ({r["doc_id"]: r["score"] for r in quality.quality(docs, known).collect()}
                     for known in (labels, turned))
    assert first == second


def test_sample_is_bounded(spark):
    docs = cases.plain(spark, [(i, f"text {i // 3}") for i in range(900)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, quality int")
    rows = quality.sample(docs, labels, 50, "doc_id", "text", "doc_id", "quality").collect()
    assert 20 < len(rows) <= 50 and len({r["text"] for r in rows}) == len(rows)


def test_awkward_quality(spark):
    labels = spark.createDataFrame([(5, 1), (3, 0), (9, None), (None, 1), (10, 0), (10, 1), (16, 0)],
                                   "doc_id long, quality int")
    found = quality.quality(cases.awkward(spark), labels).collect()
    assert len(found) == len(cases.TEXTS) and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (11, 12, 13, 14)}) == 1
    assert quality.quality(cases.empty(spark), labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality(cases.awkward(spark), none).collect()} == {0.5}
