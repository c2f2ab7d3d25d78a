"""The operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chat_tree, context_tree, decontam, exact, near_dup, secret_scan, spm, substring, tokcount, toxicity
from quillspark.llm.chat_tree import TRAINED
from quillspark.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokcount.token_counts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"), toxicity.severity())
    return toxicity.score(docs, model)


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_digests(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, TRAINED, said)], "conv_id long, turn long, role string, text string")
    vocabulary = _vocabulary("byte_bpe_50k.json")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_tree.read_back(*chat_tree.prefix_tree(turns, vocabulary), vocabulary)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_toxicity": op2_toxicity,
        "op3_context_tree": op3_context_tree,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_secret_scan": op5_secret_scan,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_decontamination": op8_decontamination,
        "op9_chat_tree": op9_chat_tree,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_near_duplicates": near_dup.ORACLE,
        "op7_substring_dedup": substring.ORACLE,
        "op9_chat_tree": chat_tree.ORACLE,
        "op10_exact_dedup": exact.ORACLE,
    }
