"""From raw documents to token ids: five stages, each a DataFrame written as Parquet and read again by the next.

quality   documents that the quality rules reject go; boilerplate lines of the others are removed
simhash   of each group of near copies one document stays (five-word shingles)
secrets   secrets in the text are replaced by their kind
mixing    each row is taken as often as the target weights ask for
bpe       texts become token ids

All but the last return the columns of documents.

In every stage: a null or empty text has no words, so the quality stage rejects it; a null host, language or source is a value of its
own; a null id is kept apart from ids, and repeated rows are judged alike, of which the simhash stage keeps one. Texts of any
length are read whole. Ties go to the smallest id, then to the hash of the text. Columns beside those of documents are
passed on, whatever their names, and an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakemill.llm import bpe, line_quality, mixing, secret_scan, simhash
from lakemill.llm.common import delete, documents, materialise, new_folder, scratch

#: A SQL form would have to hold SimHash's XXH64 and the BPE merges; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("simhash", near_copies), ("secrets", secrets), ("mixing", mixture), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's inner tables go when its result is written, that result when the next one is."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}")
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), name, path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
