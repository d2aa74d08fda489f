"""Corpus pipeline: quality rules → exact dedup → near dedup → repeated passages → packing.

``STAGES`` lists the stages in order.  A stage takes (spark, docs, sf_dir),
where ``docs`` is everything that the stage before it kept, and returns a
DataFrame; :func:`run` writes each result as Parquet to the shared folder and
reads it back as the next stage's input, so an executor that is lost costs the
stage it was working on at most.  All stages but the last return the columns of
``documents``.

Edge cases: a null text counts as empty and fails the rule of fewest words, so it
goes in the first stage; of rows that repeat an id and text one stays (exact
dedup), rows that repeat an id with other texts are documents of their own; a
document without id stays unless an equal text has one, and is linked with no near
duplicate; texts of any length are read whole; of copies the smallest id stays, its
columns as they were; further columns are carried along, whatever their names; an
empty table gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vocable.llm import bm25_packing, exact_dedup, jaccard_join, rule_ledger, suffix_dedup
from vocable.llm.store import table, written

#: Near duplicates: five-word shingles, Jaccard similarity of at least 0.8.
SHINGLE, SIMILARITY = 5, (80, 100)
#: Repeated passages: byte strings of this length that occur more than once go.
PASSAGE = 200
WINDOW = 4096


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule policy keeps."""
    return rule_ledger.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return jaccard_join.keep_one(docs, SHINGLE, *SIMILARITY)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur elsewhere too; what holds nothing else goes."""
    return suffix_dedup.without_repeats(docs, PASSAGE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, lexical neighbours together."""
    return bm25_packing.retrieval_packing(docs, public_tokenizers.path("word_bpe_49k.json"), window=WINDOW)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("near_dedup", near),
          ("repeated_passages", passages), ("packing", pack)]
#: Set similarity over all pairs, suffix order and packing are not SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
