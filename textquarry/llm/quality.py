"""Quality by votes of the nearest labelled texts in a latent-semantic space.

A text is a bag of terms: its words, the shape of each (runs of lower-case letters,
capitals, digits as one sign, other signs as they are) with its length, and how often
words and lines come back. Counts weighted by inverse document frequency are
projected on the main singular directions of the labelled texts. The labelled vectors
are broadcast; every text is multiplied with all of them, block by block, and its
nearest neighbours vote with their cosine as weight.

The fit uses at most ``most_texts`` distinct labelled texts: they bound what is
broadcast and what a text is compared with.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import filled, keyed_text, text_batches
from textquarry.session import materialise

#: Hashed terms; the last ones are those of the text as a whole.
TERMS = 4096
WHOLE = ("same word next", "word again", "long word again", "line again")
DIRECTIONS = 48
NEIGHBOURS = 20
MOST_TEXTS = 4000
#: Labelled vectors, and texts, multiplied at a time.
BLOCK = 1024
#: Bound of the words whose terms a task keeps.
MOST_WORDS = 200_000
_RUNS = (re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "9")


class Model(NamedTuple):
    """weights: of each term; directions: terms to vectors; vectors, labels: of the labelled
    texts; share: of label 1 among them."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float


def shape(word: str) -> str:
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word


class Terms:
    """Counts of the terms of a text, with a bounded memory of words."""

    def __init__(self):
        room = TERMS - len(WHOLE)

        class Known(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) > MOST_WORDS:
                    self.clear()
                form = shape(word)
                ids = [xxhash.xxh32_intdigest(t) % room for t in (
                    "w" + word.lower(), "s" + form, f"l{min(len(word), 20) // 2}{form[:1]}")]
                found = self[word] = np.array([*ids, len(word) > 5], dtype=np.uint16).tobytes()
                return found

        self.known = Known()

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        counts = Counter(words)
        if not counts:
            return np.zeros(TERMS, dtype=np.float32)
        known = np.frombuffer(b"".join(map(self.known.__getitem__, counts)), dtype=np.uint16).reshape(-1, 4)
        often = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        found = np.bincount(known[:, :3].ravel(), np.repeat(often, 3), TERMS).astype(np.float32)
        lines = [line for line in text.split("\n") if line]
        found[-4:] = (sum(map(eq, words, words[1:])), len(words) - len(counts),
                      (often - 1) @ known[:, 3], len(lines) - len(set(lines)))
        return found


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Damped shares of the terms, so that a text and twice itself are much alike."""
    totals = np.maximum(counts[:, :-len(WHOLE)].sum(axis=1, keepdims=True), 1.0)
    return np.sqrt(counts / totals) * weights


def unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def singular_directions(matrix: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """The main right singular vectors, by subspace iteration from a fixed start."""
    start = np.random.default_rng(1).standard_normal((matrix.shape[1], count + 10)).astype(np.float32)
    basis = np.linalg.qr(start)[0]
    for _ in range(rounds):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    _, _, rotation = np.linalg.svd(matrix @ basis, full_matrices=False)
    return (basis @ rotation.T)[:, :count].astype(np.float32)


def fit_terms(counts: np.ndarray, labels: np.ndarray) -> Model:
    """The model of labelled term counts."""
    held = (counts > 0).sum(axis=0)
    weights = (np.log((1 + len(counts)) / (1 + held)) + 1).astype(np.float32)
    matrix = weighted(counts, weights)
    directions = singular_directions(matrix, DIRECTIONS)
    share = float(labels.mean()) if len(labels) else 0.5
    return Model(weights, directions, unit(matrix @ directions), labels.astype(np.float32), share)


def votes(counts: np.ndarray, model: Model, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the nearest labelled texts, by cosine; texts that are near
    none get the share of all."""
    if not len(model.vectors):
        return np.full(len(counts), model.share)
    vectors = unit(weighted(counts, model.weights) @ model.directions)
    near, label = np.zeros((len(counts), 0), np.float32), np.zeros((len(counts), 0), np.float32)
    for at in range(0, len(model.vectors), BLOCK):
        near = np.hstack([near, vectors @ model.vectors[at:at + BLOCK].T])
        label = np.hstack([label, np.broadcast_to(model.labels[at:at + BLOCK], (len(counts), near.shape[1] - label.shape[1]))])
        if near.shape[1] > neighbours:
            best = np.argpartition(-near, neighbours - 1, axis=1)[:, :neighbours]
            near, label = np.take_along_axis(near, best, axis=1), np.take_along_axis(label, best, axis=1)
    weight = np.maximum(near, 0.0)
    total = weight.sum(axis=1)
    return np.clip(np.where(total > 0, (weight * label).sum(axis=1) / np.maximum(total, 1e-9), model.share), 0.0, 1.0)


def sample(docs: DataFrame, labels: DataFrame, most_texts: int, id_col: str, text_col: str, label_id: str,
           label_col: str) -> DataFrame:
    """(text, label): at most ``most_texts`` distinct labelled texts, taken by a hash of the id.

    A label that is null or disputed counts as absent; equal texts are one, with the mean
    of their labels.
    """
    known = labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"),
                          F.col(f"`{label_col}`").cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    agreed = materialise(known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where(
        "label = top").select("doc_id", "label"), "labels")
    share = min(1.0, most_texts / max(1, agreed.count()))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40))
    # at most most_texts ids, so only the texts drawn are moved
    chosen = materialise(agreed.where(drawn).limit(most_texts), "chosen")
    texts = keyed_text(docs, id_col, text_col).select("doc_id", filled(F.col("text")).alias("text"))
    # an id may stand for any number of texts
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(
        F.avg("label").alias("label")).limit(most_texts)


def fit(docs: DataFrame, labels: DataFrame, most_texts: int = MOST_TEXTS, id_col: str = "doc_id",
        text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> Model:
    """Learn from labelled documents; without labels every text scores one half."""
    text_batches(docs.sparkSession)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for batch in batches:
            rows = [terms(text) for text in batch["text"]]
            at = [np.flatnonzero(r) for r in rows]
            yield pd.DataFrame({"terms": at, "counts": [r[a] for r, a in zip(rows, at)], "label": batch["label"]})

    rows = sample(docs, labels, most_texts, id_col, text_col, label_id, label_col).mapInPandas(
        counted, "terms array<int>, counts array<float>, label double").collect()
    # one order, however the rows came, so that the model is the same
    rows.sort(key=lambda r: (r["label"], r["terms"], r["counts"]))
    counts = np.zeros((len(rows), TERMS), dtype=np.float32)
    for row, found in zip(counts, rows):
        row[found["terms"]] = found["counts"]
    return fit_terms(counts, np.array([r["label"] for r in rows]))


def score(text: Column, model: Model, spark, neighbours: int = NEIGHBOURS) -> Column:
    """0 to 1, higher where label 1 is likelier; null counts as empty. Whole texts are read."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms()
        for texts in batches:
            parts = [votes(np.stack([terms(t) for t in texts[at:at + BLOCK]]), shared.value, neighbours)
                     for at in range(0, len(texts), BLOCK)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return scored(filled(text))


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is left out of learning; a null id is not."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_texts: int = MOST_TEXTS,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its score; learned from the rows that are not held out.

    Repeated rows are scored alike. Null and empty texts, and all texts if only one label
    was learned, get the share of label 1 among the labelled texts; without labels every
    score is one half. An empty table gives no rows. Further columns are ignored.
    Columns: doc_id, held_out, score, predicted.
    """
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), most_texts, id_col, text_col)
    rows = keyed_text(docs, id_col, text_col)
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                         score(F.col("text"), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
