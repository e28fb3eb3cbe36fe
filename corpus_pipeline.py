"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all but the last return the columns of ``docs``.  Between stages the rows are
written as Parquet in the shared folder and read again.

Stages that run in Python take at most ``ROWS_AT_ONCE`` rows an Arrow batch,
which bounds a worker's memory; the session keeps that setting.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkwarden.llm import bpe, language_id, line_dedup, mixing, near_dedup
from sparkwarden.llm.common import stored, table
from sparkwarden.llm.queries import LID_MAX_ROWS, LID_PER_LANGUAGE, TOKENIZER

#: Least Jaccard similarity, in hundredths, of near-duplicates here (op2's contract has 85).
NEAR_PERCENT = 80
#: Most rows of an Arrow batch.
ROWS_AT_ONCE = 1000


def _small_batches(spark: SparkSession) -> None:
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if not 0 < now <= ROWS_AT_ONCE:
        spark.conf.set(setting, str(ROWS_AT_ONCE))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learnt from the labelled rows; documents whose language can't be told go.

    Those are the ones without a letter, and the ones that the model finds about equally near to two languages.
    """
    _small_batches(spark)
    model = language_id.learn(docs, LID_PER_LANGUAGE, LID_MAX_ROWS, "doc_id", "text", "lang")
    return language_id.filter_known(docs, model, keep_ambiguous=False)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier one are cut; documents that have no word left then go."""
    return line_dedup.drop_lines(docs, drop_empty=True)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    _small_batches(spark)
    return near_dedup.drop(docs, percent=NEAR_PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in training order, a row for each pass over a document."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, and the digests of the ids and of what they decode to."""
    _small_batches(spark)
    return bpe.digests(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", fresh_lines),
    ("near_dedup", one_of_each_group),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: Language ID and the byte-pair merges can't be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
