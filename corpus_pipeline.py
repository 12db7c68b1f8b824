"""The corpus pipeline: language, toxicity, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns
of documents. run() applies them to the table documents, writing and rereading each stage's rows in the shared folder; a
stage's table is deleted once the next one is written.

Cases, alike in all stages: a null or empty text goes in the first stage, since it is in no language. Nulls in other columns,
null ids and columns besides doc_id, text and lang, whatever their names, stay as they are. Of repeated rows the near-copies
stage keeps one. Ties: of a group of near copies the least (doc_id, text hash) stays. A stage on an empty table gives an empty
table of the same columns, the last one of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirelab.llm import bpe, copies, languages, leaks, toxicity
from quirelab.session import discard, materialise, table

#: A text that is at least this likely to be toxic goes.
TOXIC = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the documents' own lang column teaches, short ones too: a text must be about as
    near to one of them as texts of its size that have a lang are. Texts without letters go; without any lang, only they."""
    return languages.keep_known(docs, languages.prototypes(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC in a model of all labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, model, TOXIC)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and all others."""
    return copies.drop_copies(docs)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    return bpe.encode(docs)


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near copies", copies_stage),
    ("decontamination", leaks_stage),
    ("token ids", tokens_stage),
]

#: None of the five decisions can be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage{k}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
