"""The corpus operators as named queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import (
    byte_bpe, decontaminate, exact_dedup, kd_shards, language, merkle, near_dedup, quality, repeats, secrets,
    spelling, token_files, toxicity)
from textquarry.llm.common import documents, table
from textquarry.session import scratch_path, ship_code

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"
END_ID = 2


def byte_bpe_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    coded = byte_bpe.roundtrip(docs, public_tokenizers.path(BYTE_VOCABULARY),
                               public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path(WORD_VOCABULARY)
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), path,
                                  lambda: token_files.word_tokenizer(vocabulary), END_ID)
    return token_files.read_documents(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}")
              for kind in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"),
                        _listed("spans").alias("spans"), "layers", "cut")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        "contaminated")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans",
                       F.sha2("kept", 256).alias("kept_sha256"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(documents(spark, sf_dir), 24)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.manifest(documents(spark, sf_dir), presented=merkle.tampered())
    return merkle.verified(rows).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root", "verified")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_token_files": op3_token_files,
    "op4_secrets": op4_secrets,
    "op5_decontaminate": op5_decontaminate,
    "op6_repeats": op6_repeats,
    "op7_kd_shards": op7_kd_shards,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language": op9_language,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_spelling": op12_spelling,
    "op13_quality": op13_quality,
}


def all_queries() -> dict[str, Query]:
    ship_code()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return {"op5_decontaminate": decontaminate.SQL, "op8_exact_dedup": exact_dedup.SQL,
            "op11_merkle": merkle.SQL, "op12_spelling": spelling.SQL}
