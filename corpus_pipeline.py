"""A corpus pipeline of the operators in graphlode.llm: each stage takes the documents that the one before it kept.

Documents whose language isn't known go; lines that another document has (or has but for a word) are cut; of near duplicates one stays; sources
are mixed to their target weights, so that a row may come twice; what is left is encoded, and decoded again.

Defined results: texts that are null or without a letter go in the first stage; a null lang becomes the predicted one; a text that loses all its lines is
empty and stays until near duplicates are looked for, where all empty texts are one group; null ids come last where rows are ordered; a null source is a source of its
own; of repeated rows one stays after near_dedup; very long texts are taken whole; extra columns, whatever their names, stay in all stages but the last, which
has doc_id and what the encoding gives; an empty table gives an empty table with the same columns in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphlode.llm import bpe, common, language, linededup, mixing, neardup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.default_path(), with_ids=True, small=True)  # the stages before it leave executors large


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("bpe", encode)]
#: SQL can't express the language and tokenizer stages; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the documents table."""
    docs = common.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, name)
    return docs
