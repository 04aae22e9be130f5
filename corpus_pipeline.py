"""The corpus pipeline: documents in, encoded clean documents out. Counted as part of spanguard.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanguard.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from spanguard.llm.common import remove, shared_dir, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier chain, trained on labelled documents, scores as toxic.

    Null and empty texts are scored by the bias alone, repeated rows stay or go together; without labels for these
    documents all stay. All columns stay, whatever their names; an empty table gives no rows.
    """
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES)
    return toxicity.drop_toxic(docs, chain)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the longest, then first, document of each group of equal texts.

    Null and empty texts are one group; of rows that repeat id and text one stays. All columns stay, whatever their
    names; an empty table gives no rows.
    """
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose five-word shingles are similar by 0.8 or more.

    Pairs are found by their SimHash fingerprints and the generalised pigeonhole principle, those whose fingerprints
    are too far apart by MinHash bands; all are verified on the whole shingle sets.
    Texts without words (null and empty too) all stay; rows that repeat id and text stay or go together. All
    columns stay, whatever their names; an empty table gives no rows.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, up to a fifth of its words edited.

    Null and empty texts stay, items without words match nothing, repeated rows stay or go together. All columns
    stay, whatever their names; an empty table gives no rows.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode to BPE ids, decode, and give the digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids; repeated rows are all returned; other columns aren't read; an empty table
    gives no rows.
    """
    return bpe.digests(docs)


STAGES = [
    ("toxicity", clean),
    ("exact dedup", exact),
    ("near dedup", near),
    ("decontamination", decontaminated),
    ("encoding", encoded),
]

#: None: the classifier, SimHash, CGK and BPE stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's rows are written as Parquet and read again.

    The rows of a stage are deleted when the next one's are written, those of the last but one when the session ends,
    since the result reads them when it is asked for.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    remove(spark, folder, at_exit=True)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
