"""Language and toxicity: held-out accuracy, and awkward input."""

import cases
import numpy as np
from pyspark.sql import functions as F
from textquarry.llm import language, toxicity
from textquarry.llm.common import documents, table


def test_languages_of_held_out_documents(spark, sf_dir):
    found = language.languages(documents(spark, sf_dir)).join(
        documents(spark, sf_dir).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_awkward_languages(spark):
    found = {r["doc_id"]: r for r in language.languages(cases.awkward(spark)).collect()}
    assert {k for k, r in found.items() if r["lang_pred"] == "und"} >= {11, 12, 13, 14, 15}
    assert all(r["lang_pred"] in ("de", "en", "und") for r in found.values())
    assert language.languages(cases.empty(spark)).count() == 0
    nothing = cases.awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.languages(nothing).collect()} == {"und"}


def test_language_sample_has_every_language_and_no_foreign_row(spark):
    texts = [(i, f"{lang} word{i} text", lang) for i in range(40) for lang in ("a", "b", "c", "d", "e")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    drawn = [tuple(r) for r in language.sample(docs, 4, "doc_id", "text", "lang").collect()]
    assert {lang for lang, _ in drawn} == set("abcde") and len(drawn) < 40
    # ids repeat here, each row keeps its own language
    assert all(text.startswith(lang) for lang, text in drawn)
    whole = language.sample(docs, 10_000, "doc_id", "text", "lang").collect()
    assert sorted(map(tuple, whole)) == sorted((lang, text) for _, text, lang in texts)
    assert "und" not in {r["lang_pred"] for r in language.languages(docs, most_texts=4).collect()}


def test_repeated_ids_do_not_grow_the_toxicity_sample(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    found = toxicity.sample(docs, labels, 10, "doc_id", "text", "doc_id", "toxic").collect()
    assert sorted((r["doc_id"], r["toxic"]) for r in found) == [(0, 1), (1, 0), (2, 0)]


def test_lexicon_keeps_every_term(spark):
    names = ["".join(chr(97 + w // 26 ** d % 26) for d in range(4)) for w in range(21_000)]
    rows = spark.createDataFrame([(i, " ".join(names) + " " + "z" * (i + 5), 1) for i in range(12)],
                                 "doc_id long, text string, toxic int")
    words, _ = toxicity.learn_lexicon(rows)
    assert words.keys() >= set(names)


def test_codewords_lie_apart():
    for count in (2, 4, 6, 9, 40):
        codes = language.codewords(count)
        apart = [(codes[i] != codes[j]).sum() for i in range(count) for j in range(i)]
        assert min(apart) >= 1 and len(codes) == count


def test_steps_of_a_long_text_lose_nothing(monkeypatch):
    letters = language.letter_table()
    text = "Ein ß langer Text, mit 12 Zahlen! " * 40
    whole = language.ngrams(text, letters)
    monkeypatch.setattr(language, "STEP", 37)
    assert (language.ngrams(text, letters) == whole).all()


def test_toxicity_of_held_out_documents(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.01"), table(spark, "/root/testdata/sf0.01", "labels")
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in found]) > 0.9
    assert np.mean([r["predicted"] for r in found if r["toxic"] == 0]) < 0.05


def test_awkward_toxicity(spark):
    labels = spark.createDataFrame([(5, 1), (3, 0), (9, None), (None, 1), (10, 0), (10, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(cases.awkward(spark), labels).collect()
    assert len(found) == len(cases.TEXTS) and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.toxicity(cases.empty(spark), labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(cases.awkward(spark), none).collect()} == {0}


def test_label_model_outvotes_wrong_labels():
    source = np.random.default_rng(5)
    truth = source.random(4000) < 0.2
    votes = np.column_stack([np.where(source.random(4000) < 0.9, truth, ~truth) for _ in range(5)]).astype(float)
    labels = np.where(source.random(4000) < 0.9, truth, ~truth).astype(float)
    posterior, rates, correlations = toxicity.label_model(votes, labels, np.ones(4000))
    assert ((posterior > 0.5) == truth).mean() > (labels == truth).mean() + 0.04
    assert rates[1][:5].min() > 0.7 > 0.3 > rates[0][:5].max() and np.allclose(np.diag(correlations), 1)
