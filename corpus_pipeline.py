"""Corpus pipeline: five operators applied one after another to ``documents``.

Each stage reads all that the one before kept. Every stage but the last returns the
columns it was given; the last returns each document's token ids and what they
decode to. Run by ``run`` or stage by stage from ``STAGES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, exact, near_dup, spm, toxicity
from quillspark.llm.common import relax, release, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity grade is likelier above the lowest than not go."""
    relax(spark)
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"), toxicity.severity())
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one document stays."""
    relax(spark)
    return exact.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    relax(spark)
    return near_dup.keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    relax(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, begin and end included, and a digest of what they decode
    to; all other columns but the text stay."""
    import public_tokenizers

    made = ("n_tokens", "ids", "decoded_sha256")
    relax(spark)
    coded = spm.encode_table(docs, public_tokenizers.path("piece_bpe_32k.model"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "decoded", *made)]
    return coded.select(*rest, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: A fitted model decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            release(before)
    return docs
