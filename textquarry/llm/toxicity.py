"""Toxicity by weak supervision.

Voters fire or keep silent on a text: parts of a lexicon of words and of word
beginnings found in labelled texts, by how surely a term marks toxic ones, and
patterns (several terms, shouting, exclamation marks). A generative label model
estimates by expectation maximisation how often each voter fires on toxic and on
other texts; the hand label is one more voter, so wrong labels are outvoted.
Voters that still agree once the class is known share their weight. A linear
classifier is fitted to the posterior labels; it alone scores texts.

The fit uses a sample of labelled rows of at most ``2 * per_class`` rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import filled, keyed_text, text_batches
from textquarry.session import materialise

WORD = re.compile(r"[^\W\d_]{3,}")
#: Lengths of the word beginnings looked at.
BEGINNINGS = range(3, 9)
#: A term belongs to the first tier that its share of toxic texts reaches, taken at
#: the lower end of its 95 % interval.
TIERS = (0.9, 0.75, 0.6)
Z = 1.96
#: Each tier of words and of beginnings is dealt to so many voters.
PARTS = 3
#: Texts that must hold a term before it is judged.
LEAST_TEXTS = 4
#: Bound of the words whose voters a task keeps.
MOST_WORDS = 300_000
KINDS = ("word", "beginning")
PATTERNS = ("two terms", "four terms", "eight terms", "shouting", "exclaiming", "any term")
VOTERS = len(KINDS) * len(TIERS) * PARTS + len(PATTERNS)


class Model(NamedTuple):
    """lexicon: per kind, the voter of each term; weights and bias of the classifier."""

    lexicon: tuple[dict[str, int], dict[str, int]]
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray
    correlations: np.ndarray


def sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str,
           label_id: str, label_col: str) -> DataFrame:
    """(doc_id, text, toxic): labelled texts, at most about ``per_class`` of each label.

    Rows are taken by a hash of the id; a label that is null or disputed counts
    as absent.
    """
    known = labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"),
                          F.col(f"`{label_col}`").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    agreed = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("top"))
    agreed = materialise(agreed.where("toxic = top").drop("top"), "labels")
    sizes = {row["toxic"]: row["count"] for row in agreed.groupBy("toxic").count().collect()}
    span = 1 << 40
    limits = F.lit(0).cast("long")
    for label, size in sizes.items():
        limits = F.when(F.col("toxic") == label, int(min(1.0, per_class / size) * span)).otherwise(limits)
    chosen = agreed.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < limits)
    texts = keyed_text(docs, id_col, text_col).select("doc_id", filled(F.col("text")).alias("text"))
    # bounded by per_class, so it may be broadcast; a repeated id gives one text
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def _terms_of(text: str) -> tuple[set[str], set[str]]:
    words = set(WORD.findall(text.lower()))
    return words, {w[:n] for w in words for n in BEGINNINGS if n < len(w)}


def learn_lexicon(labelled: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Terms by kind with the voter they belong to: all of the sample that mark toxic texts.

    The sample bounds them, as each must be in ``LEAST_TEXTS`` of its texts."""

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic: dict[tuple[int, str], int] = {}
            texts: dict[tuple[int, str], int] = {}
            for text, label in zip(batch["text"], batch["toxic"]):
                for kind, found in enumerate(_terms_of(text)):
                    for term in found:
                        key = (kind, term)
                        texts[key] = texts.get(key, 0) + 1
                        if label:
                            toxic[key] = toxic.get(key, 0) + 1
            keys = list(texts)
            yield pd.DataFrame({"kind": [k for k, _ in keys], "term": [t for _, t in keys],
                                "texts": [texts[k] for k in keys],
                                "toxic": [toxic.get(k, 0) for k in keys]})

    # copies of one text tell no more than one
    single = labelled.groupBy("text").agg(F.max("toxic").alias("toxic"))
    counted = single.mapInPandas(terms, "kind int, term string, texts long, toxic long").groupBy(
        "kind", "term").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"))
    n, share = F.col("texts"), F.col("toxic") / F.col("texts")
    surely = (share + Z * Z / (2 * n) - Z * F.sqrt((share * (1 - share) + Z * Z / (4 * n)) / n)) / (
        1 + Z * Z / n)
    tier = F.lit(len(TIERS))
    for number in reversed(range(len(TIERS))):
        tier = F.when(surely >= TIERS[number], number).otherwise(tier)
    known = counted.where(F.col("texts") >= LEAST_TEXTS).withColumn("tier", tier).where(
        F.col("tier") < len(TIERS)).withColumn(
        "part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int"))
    lexicon: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for row in known.select("kind", "term", "tier", "part").collect():
        lexicon[row["kind"]][row["term"]] = (row["kind"] * len(TIERS) + row["tier"]) * PARTS + row["part"]
    return lexicon


class Votes:
    """The voters of a lexicon, with a bounded memory of words."""

    def __init__(self, lexicon: tuple[dict[str, int], dict[str, int]]):
        words, beginnings = lexicon

        class Known(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) > MOST_WORDS:
                    self.clear()
                found = {beginnings[word[:n]] for n in BEGINNINGS
                         if n < len(word) and word[:n] in beginnings}
                if word in words:
                    found.add(words[word])
                voters = self[word] = tuple(sorted(found))
                return voters

        self.known = Known()

    def __call__(self, text: str) -> np.ndarray:
        fired = np.zeros(VOTERS, dtype=np.uint8)
        terms = 0
        known = self.known
        for word in set(WORD.findall(text.lower())):
            if voters := known[word]:
                terms += 1
                fired[list(voters)] = 1
        length = len(text)
        fired[-6:] = (terms >= 2, terms >= 4, terms >= 8, length > 20 and text.isupper(),
                      text.count("!") * 20 > length > 0, terms >= 1)
        return fired


def vote_patterns(labelled: DataFrame, lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vote vectors of the sample with label and count."""

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vote = Votes(lexicon)
        for batch in batches:
            yield pd.DataFrame({"votes": ["".join(map(str, vote(t))) for t in batch["text"]],
                                "toxic": batch["toxic"]})

    rows = labelled.mapInPandas(votes, "votes string, toxic int").groupBy("votes", "toxic").count() \
        .orderBy("votes", "toxic").collect()
    patterns = np.array([[int(c) for c in r["votes"]] for r in rows], dtype=float).reshape(-1, VOTERS)
    return (patterns, np.array([r["toxic"] for r in rows], dtype=float),
            np.array([r["count"] for r in rows], dtype=float))


def label_model(patterns: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 25
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each pattern, firing rates of each voter by class, correlations)."""
    votes = np.column_stack([patterns, labels])
    posterior = 0.05 + 0.9 * labels
    share = np.ones(votes.shape[1])
    rates = np.full((2, votes.shape[1]), 0.5)
    correlations = np.eye(votes.shape[1])
    for _ in range(rounds):
        for side, belief in ((0, 1 - posterior), (1, posterior)):
            mass = belief * counts
            rates[side] = (mass @ votes + 0.5) / (mass.sum() + 1.0)
        prior = np.clip(np.average(posterior, weights=counts), 1e-4, 1 - 1e-4)
        rest = votes - (posterior[:, None] * rates[1] + (1 - posterior)[:, None] * rates[0])
        covariance = (rest * counts[:, None]).T @ rest / counts.sum()
        scale = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        correlations = covariance / np.outer(scale, scale)
        np.fill_diagonal(correlations, 1.0)
        share = 1.0 / np.maximum(correlations, 0.0).sum(axis=1)
        fired, silent = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        logit = np.log(prior / (1 - prior)) + votes @ (share * fired) + (1 - votes) @ (share * silent)
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior, rates, correlations


def fit_linear(patterns: np.ndarray, posterior: np.ndarray, counts: np.ndarray,
               penalty: float = 0.01, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Newton steps."""
    x = np.column_stack([patterns, np.ones(len(patterns))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (p - posterior)) + ridge * w
        hessian = (x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 8000, id_col: str = "doc_id",
        text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> Model:
    """Learn from labelled documents; without any toxic one, nothing is toxic."""
    text_batches(docs.sparkSession)
    labelled = materialise(sample(docs, labels, per_class, id_col, text_col, label_id, label_col),
                           "labelled")
    lexicon = learn_lexicon(labelled)
    patterns, given, counts = vote_patterns(labelled, lexicon)
    if not given.any() or given.all():
        bias = 30.0 if given.any() else -30.0
        return Model(lexicon, np.zeros(VOTERS), bias, np.full((2, VOTERS + 1), 0.5),
                     np.eye(VOTERS + 1))
    posterior, rates, correlations = label_model(patterns, given, counts)
    weights, bias = fit_linear(patterns, posterior, counts)
    return Model(lexicon, weights, bias, rates, correlations)


def score(text: Column, model: Model) -> Column:
    """0 to 1, higher for toxic; null counts as empty. Whole texts are read."""
    lexicon, weights, bias = model.lexicon, model.weights, model.bias

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vote = Votes(lexicon)
        for texts in batches:
            fired = np.array([vote(t) for t in texts], dtype=float).reshape(-1, VOTERS)
            yield pd.Series(1 / (1 + np.exp(-np.clip(fired @ weights + bias, -30, 30))))

    return scored(filled(text))


def held_out(key: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether a document is left out of learning; a null id is not."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 8000, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per document with its score; learned from the rows that are not held out.

    Repeated rows are scored alike; empty and null texts get the score of a text
    on which no voter fires. Without labels, or with one class only, the score is
    that class. An empty table gives no rows. Further columns are ignored.
    Columns: doc_id, held_out, score, predicted.
    """
    learn = labels.where(~held_out(F.col("doc_id")))
    model = fit(docs, learn, per_class, id_col, text_col)
    rows = keyed_text(docs, id_col, text_col)
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                         score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 8000) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), per_class)
    return docs.where(score(F.col("text"), model) < 0.5)
