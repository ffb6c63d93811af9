"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All stages but
the last return the columns of ``documents``. Models are fitted on the rows of
the tables in ``sf_dir`` that are not held out; every decision is made on the
documents that the stage before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, exact_dedup, langid, ngram_join, packing, toxicity


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or whose mixture no language leads: the largest proportion of their language set is under a half."""
    model = langid.train_on(common.table(spark, sf_dir, "documents"))
    return langid.drop_unidentified(docs, model)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.3 or more go."""
    model = toxicity.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word shingle Jaccard of 0.8 or more, that with the smallest doc_id stays."""
    return ngram_join.drop_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in as few sequences as found."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("best_fit_packing", pack_sequences),
]

#: Models and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder before the next reads it; a stage's table goes once the next one is written."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), name)
        common.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
