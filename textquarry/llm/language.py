"""Language of a text by error-correcting output codes.

Each language has a codeword. For each bit a linear classifier on character
n-grams (one to three letters, words told apart by their ends) says on which
side a text lies; bits that erred less on the sample weigh more. The language
whose codeword costs least logistic loss is chosen; a text is ambiguous when a
second one costs nearly as little.

The fit uses a sample of about ``most_texts`` labelled texts, the same number of
each language where there are enough, and at least one of each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import ROW, filled, keyed_text, text_batches, with_rows
from textquarry.session import materialise

FEATURES = 4096
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
#: Characters looked at in one step of a long text; steps overlap, so no n-gram is lost.
STEP = 1 << 20
UNKNOWN = "und"
#: Rows are drawn by a number below this.
SPAN = 1 << 40


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # language x bit, +1 or -1
    weights: np.ndarray  # feature x bit
    bias: np.ndarray
    reliability: np.ndarray


def codewords(count: int, seed: int = 7) -> np.ndarray:
    """A codeword per language: every two-sided split for up to six, else random ones."""
    if count < 2:
        return np.ones((count, 1))
    if count <= 6:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=count - 1)]
        return np.array([s for s in splits if -1 in s], dtype=float).T
    bits = 12 * int(np.ceil(np.log2(count)))
    best, apart = None, -1
    source = np.random.default_rng(seed)
    for _ in range(50):
        tried = source.choice([-1.0, 1.0], size=(count, bits))
        tried = tried[:, np.abs(tried.sum(axis=0)) < count]
        overlap = tried @ tried.T - 2 * bits * np.eye(count)
        if -overlap.max() > apart or best is None:
            best, apart = tried, -overlap.max()
    return best


def letter_table() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(text: str, letters: np.ndarray) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None without any letter."""
    counts = np.zeros(FEATURES, dtype=np.int64)
    any_letter = False
    lowered = f"  {text.lower()} "  # what is no letter counts as a space
    for begin in range(2, len(lowered), STEP):
        # n-grams that end in this step; two characters before it give the context
        part = lowered[begin - 2:begin + STEP]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        own = np.where(letters[points], points, 0).astype(np.uint64)
        any_letter |= bool(own.any())
        one = own[2:] * MIXERS[0]
        two = one + own[1:-1] * MIXERS[1]
        three = two + own[:-2] * MIXERS[2]
        last, middle = own[2:] > 0, own[1:-1] > 0
        for number, seen in enumerate((one[last], two[last | middle], three[middle])):
            mixed = (seen ^ (seen >> np.uint64(29))) * MIXERS[number]
            counts += np.bincount((mixed >> np.uint64(52)).astype(np.int64), minlength=FEATURES)
    return counts if any_letter else None


def shape(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: a unit vector, whatever the length of the text."""
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def sample(docs: DataFrame, most_texts: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) of the sample: about ``most_texts`` rows, the same share of them for each
    language, but at least one text of each.

    Rows, not ids, are drawn, by a hash of id and place in the file; so a repeated id
    brings no other row along.
    """
    keyed = with_rows(docs)
    draw = F.pmod(F.xxhash64("doc_id", f"{ROW}.at"), F.lit(SPAN))
    known = keyed.select(ROW, F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                         F.col(f"`{lang_col}`").cast("string").alias("lang"),
                         F.col(f"`{text_col}`").isNotNull().alias("full")).where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("full")).select(
        ROW, "lang", draw.alias("draw"))
    # a row for each language that is learned; combined in tasks before it is shuffled
    sizes = materialise(known.groupBy("lang").agg(
        F.count("*").alias("size"), F.min(F.struct("draw", ROW)).alias("first")), "languages")
    quota = max(1, most_texts // max(1, sizes.count()))
    chosen = materialise(known.join(sizes, "lang").where(
        (F.col("draw") < F.lit(float(SPAN)) * quota / F.col("size")) | (F.col(ROW) == F.col(f"first.{ROW}"))).select(
        ROW, "lang"), "sample")
    texts = keyed.select(ROW, F.col(f"`{text_col}`").cast("string").alias("text"))
    # about most_texts rows and one for each language, so it may be broadcast
    return texts.join(F.broadcast(chosen), ROW).select("lang", "text")


def fit(docs: DataFrame, most_texts: int = 4000, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", steps: int = 120) -> Model:
    text_batches(docs.sparkSession)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for batch in batches:
            found = [(lang, ngrams(text, letters)) for lang, text in zip(batch["lang"], batch["text"])]
            yield pd.DataFrame([(lang, shape(c).astype(np.float16).tobytes()) for lang, c in found
                                if c is not None], columns=["lang", "vector"])

    rows = sample(docs, most_texts, id_col, text_col, lang_col).mapInPandas(
        vectors, "lang string, vector binary").orderBy("lang", "vector").collect()
    languages = sorted({row["lang"] for row in rows})
    codes = codewords(len(languages))
    bits = codes.shape[1] if len(languages) else 1
    weights = np.zeros((FEATURES, bits), dtype=np.float32)
    bias = np.zeros(bits, dtype=np.float32)
    if len(languages) < 2:
        return Model(languages, codes, weights, bias, np.ones(bits))
    x = np.frombuffer(b"".join(row["vector"] for row in rows), dtype=np.float16).reshape(
        -1, FEATURES).astype(np.float32)
    x *= 30.0  # puts the sparse shares on the scale of the steps
    number = {language: i for i, language in enumerate(languages)}
    y = codes[[number[row["lang"]] for row in rows]].astype(np.float32)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):  # logistic loss, all bits at once, Adam
        pull = -y / (1 + np.exp(np.clip(y * (x @ weights + bias), -30, 30))) / len(x)
        gradient = x.T @ pull + 1e-4 * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient * gradient
        weights -= 0.02 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)
        bias -= 0.1 * pull.sum(axis=0)
    right = ((x @ weights + bias) * y > 0).mean(axis=0)
    reliability = np.log((right + 1e-3) / (1 - right + 1e-3))
    return Model(languages, codes, weights * 30.0, bias, np.maximum(reliability, 0.01))


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest language, its score, how far ahead of the second) for each row of margins."""
    share = model.reliability / model.reliability.sum()
    loss = np.logaddexp(0.0, -margins[:, None, :] * model.codes[None, :, :]) @ share
    likely = np.exp(-loss * model.codes.shape[1])
    likely /= likely.sum(axis=1, keepdims=True)
    order = np.sort(likely, axis=1)
    ahead = order[:, -1] - order[:, -2] if likely.shape[1] > 1 else np.ones(len(likely))
    return likely.argmax(axis=1), order[:, -1], ahead


def predict(text: Column, model: Model, margin: float = 0.2) -> Column:
    """struct(lang, score, ambiguous) of whole texts."""

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for texts in batches:
            out = []
            for text in texts:
                counts = ngrams(text, letters) if model.languages else None
                if counts is None:
                    out.append((UNKNOWN, 0.0, True))
                    continue
                margins = (shape(counts) @ model.weights + model.bias)[None, :]
                best, score, ahead = decode(margins, model)
                out.append((model.languages[best[0]], float(score[0]), bool(ahead[0] < margin)))
            yield pd.DataFrame(out, columns=["lang", "score", "ambiguous"])

    return predicted(filled(text))


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is left out of learning; a null id is not."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def languages(docs: DataFrame, most_texts: int = 4000, id_col: str = "doc_id",
              text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document with its language, learned from the rows not held out.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text if no language is known; with one known language all others are of it.
    Null languages are not learned from. Repeated rows get equal answers; an empty
    table gives no rows. Further columns are ignored.
    Columns: doc_id, held_out, lang_pred, score, ambiguous.
    """
    model = fit(docs.where(~held_out(F.col(f"`{id_col}`"))), most_texts, id_col, text_col, lang_col)
    rows = keyed_text(docs, id_col, text_col)
    found = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        predict(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"),
                        F.col("found.score").alias("score"),
                        F.col("found.ambiguous").alias("ambiguous"))
