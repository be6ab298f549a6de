import cases
import corpus_pipeline
from textquarry.llm import byte_bpe, decontaminate, exact_dedup, near_dedup, queries


def test_stages_keep_columns_and_take_awkward_documents(spark, sf_dir):
    docs = cases.awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, sf_dir)
        assert left.columns == docs.columns, name
        assert left.count() <= docs.count()
        docs = left
    assert stage is not None and corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_pipeline_against_its_operators(spark, sf_dir):
    """The rows left are those that every operator, on what the one before kept, lets through."""
    from textquarry.llm import decontaminate, exact_dedup, near_dedup, toxicity
    from textquarry.llm.common import documents, table

    docs = documents(spark, sf_dir)
    ids = {r["doc_id"] for r in toxicity.toxicity(docs, table(spark, sf_dir, "labels")).collect()
           if not r["predicted"]}
    for operator in (exact_dedup.exact_duplicates, near_dedup.near_duplicates):
        kept = operator(docs.where(docs.doc_id.isin(list(ids)))).where("kept")
        ids = {r["doc_id"] for r in kept.collect()}
    found = decontaminate.contamination(docs.where(docs.doc_id.isin(list(ids))), table(spark, sf_dir, "benchmark"))
    ids = {r["doc_id"] for r in found.where("not contaminated").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == ids


def test_every_operator_has_a_query():
    names = set(queries.all_queries())
    assert {n.split("_")[0] for n in names} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.all_sql()) <= names and byte_bpe.CHUNK > 0


def test_no_text_is_lost_with_repeated_and_absent_ids(spark):
    same, other = " ".join(f"w{i}" for i in range(30)), "quite another text of its own, and not a short one"
    near = same.replace("w29", "w30")
    docs = cases.plain(spark, [(3, same), (3, same), (5, same), (7, other), (7, same + " "), (None, other), (8, near), (8, near)])
    once = exact_dedup.deduplicate(docs)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in once.collect()) == sorted(
        [(0, other), (3, same), (7, other), (7, same + " "), (8, near)])
    left = near_dedup.without_near_duplicates(once)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(0, other), (3, same), (7, other)])
    items = spark.createDataFrame([(1, "text of its own, and not a short one")], "item_id long, text string")
    clean = decontaminate.without_contaminated(docs, items)
    assert sorted((r["doc_id"], r["text"]) for r in clean.collect()) == sorted(
        [(3, same), (3, same), (5, same), (7, same + " "), (8, near), (8, near)])


def test_rows_of_the_awkward_documents(spark):
    docs = cases.awkward(spark)
    left = exact_dedup.deduplicate(docs)
    kept = [r["doc_id"] for r in left.where("doc_id IS NOT NULL").collect()]
    # 3 of the four equal foxes (10 differs by white space only), 11 of the four empty texts
    assert sorted(kept) == [-4, 3, 9, 11, 15, 16, 17, 18, 19]
    assert left.where("doc_id IS NULL").count() == 3
    for stage in (exact_dedup.deduplicate, near_dedup.without_near_duplicates):
        assert stage(cases.empty(spark)).count() == 0
