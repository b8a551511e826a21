"""Corpus pipeline: documents through five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of the documents. None of the stages can be told in SQL, so there is no SQL twin;
``tests/llm`` holds them against brute force.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm import bpe, decontaminate, minhash, pii, toxicity
from pressroom.llm.common import fresh, settle, table
from pressroom.session import pin

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _pinned(stage: Stage) -> Stage:
    """The stage in Arrow batches of 1,000 rows: both sides of a worker's socket hold a whole batch."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(pin(spark), docs, sf_dir)

    return run


@_pinned
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of ``toxicity.THRESHOLD`` or more go."""
    score = fresh(docs, "score")
    scored = toxicity.fit(docs, table(spark, sf_dir, "labels")).score(docs, score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


@_pinned
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Rows that repeat an id and a text are one document, rows that repeat an id with another text are documents
    of their own. Rows without an id stay.
    """
    return minhash.drop_near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


@_pinned
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat benchmark passages in a twentieth of their words or more go."""
    result = fresh(docs, "spans_found")
    found = decontaminate.find_spans(docs, table(spark, sf_dir, "benchmark"), result)
    return found.where(~decontaminate.contaminated(result)).select(*docs.columns)


@_pinned
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in ``text`` becomes its kind in angle brackets; ``n_chars`` follows the text."""
    masked = pii.masked(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.length("text").cast(kind))
    return masked.select(*docs.columns)


@_pinned
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text again."""
    return bpe.tokenise(docs, RANK_FILE, PATTERN, outputs=("n_tokens", "ids", "round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
