"""A cleaning pipeline over documents: language, near duplicates, benchmark leaks, secrets, encoding.

STAGES lists (name, function) in order; a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of docs. run() applies them to the table documents, each stage's rows written to the shared folder and
read again, so that a stage's lineage ends with it.

Defined cases: nulls, empty texts, ties, repeated rows, empty tables and extra columns are handled as the operators say.
Documents without a doc_id are never near duplicates of others; of rows that share a doc_id one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, common, decontaminate, jaccard, langid, queries, secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a learned language; profiles and limits learn from the documents that op4_langid doesn't hold out."""
    known = docs.filter(~langid.held_out(docs["doc_id"]))
    return langid.accept(docs, langid.calibrated(known, langid.train(known)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group linked by shingle sets."""
    return jaccard.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that benchmark windows cover; documents that are mostly such words go."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    return secrets.redact(docs, queries.RATIO)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, exact, ids of every document."""
    return bpe.encode_documents(docs, queries.RANKS, queries.PATTERN, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secret_spans),
    ("encoding", encoding),
]

#: Learned profiles and the token-ratio test have no SQL form; the pipeline is tested against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir).withColumn("ids", F.to_json("ids"))
