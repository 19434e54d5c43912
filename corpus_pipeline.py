"""The corpus pipeline: quality rules, language identification, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. The filtering stages work row by row on all columns of documents; the last returns one row a piece.

Defined results: a document without text, words or letters goes in the first stages; rows that repeat an id are judged each by
their own text, and of rows with the same words one stays, as of all near-duplicates (ties: the smallest id); texts of any length
are read whole; empty tables give empty results; extra columns pass the filtering stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeline.llm import langid, neardup, packing, rules
from tapeline.llm.common import cut, drop_since, mark, table
from tapeline.llm.queries import fold, token_ids


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    return rules.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in languages that two thirds of the labelled documents teach; text without letters, in other languages or of no language goes."""
    return langid.keep_known(docs, fold(3) != 1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8."""
    return neardup.keep_one(docs, width=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 tokens."""
    return packing.pack(docs, token_ids())


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("packing", pack)]

#: Learnt models and tokenizers are not to be had in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Tables that a stage has written are deleted when its result stands."""
    docs = table(spark, sf_dir, "documents")
    place = mark()
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        drop_since(spark, place, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
