"""The corpus pipeline: quality classifier, near-duplicates, repeated passages, benchmark passages, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import bpe, cotraining, decontam, neardup, queries, suffixes
from locusframe.llm.common import Work, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is 0.5 or more."""
    model = cotraining.fit(docs, table(spark, sf_dir, "labels"))
    return cotraining.score(docs, model, name="_quality").where("_quality >= 0.5").drop("_quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each class."""
    return neardup.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of 100 bytes or more that also start earlier; n_chars follows the text."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = suffixes.deduplicate(docs, keep=keep, as_text=True)
    text = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*[text.get(c, F.col(c)).alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and digests of them and of the bytes that they stand for."""
    encoded = bpe.encode(docs, public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN, back=True)
    digests = queries.bpe_digests(encoded, keep=("ids",))
    return digests.select("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark passages", benchmark_passages),
    ("token ids", token_ids),
]

#: The stages are beyond SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on the written rows of the one before."""
    work = Work(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = work.put(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
