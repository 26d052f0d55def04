"""A training corpus from raw documents: five stages, each applied to all that the one before kept.

The documents table goes through language ID, the quality classifier, near-duplicate removal and benchmark
decontamination, which all return the columns of documents, and then into the mixture, which returns a row for each draw of
a document, with its words and output shard. SQL can't express the stages; tests hold them against brute force.

Nulls and odd rows: a null, empty or letterless text goes at language ID. Rows that repeat are judged alike; near
duplicates keep all rows that agree in doc_id and text, or none. Rows with a null doc_id pass like others but name no
group of near duplicates, so they stay. Columns beyond those of documents are carried; where one has the name of a
column that the mixture adds, the added one gets an underscore. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import common, decontam, langid, mixing, neardup, quality


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and not in doubt."""
    return langid.keep(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, a similarity of 0.8 or more), that of the least doc_id."""
    return neardup.keep(docs, neardup.AT_80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.keep(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken, with draw, shard, taken (its words), size, source_size and target,
    shuffled within each shard. Rows that share a doc_id are mixed row by row; documents without words are never taken."""
    return mixing.draw_mix(docs)


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written as Parquet to the shared folder and read again."""
    folder = common.shared_folder(spark) + f"/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
