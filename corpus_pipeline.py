"""A corpus from raw documents: quality rules, exact and near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Stages but the last
return the columns of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modewave.llm import exact_dedup, ngram_join, packing, quality, suffix_dedup
from modewave.llm.common import drop_stash, stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cutoffs that labelled documents prove safe.

    Null and empty texts fail the base rules; texts are measured whole, however long; rows that repeat, tie or lack an id are judged each; columns come back whatever
    their names; an empty table, or one without labels, is judged by the base rules alone.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id.

    Null and empty texts are equal; of ties and rows that repeat one stays, a null id only where there is no other; texts of any length are compared
    whole; columns come back whatever their names; an empty table stays empty.
    """
    return exact_dedup.drop_exact(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of at least 80 % of 5-word shingles join, the one with the smallest id.

    Texts without words, null ones among them, link with nothing and stay; of equal ids a hash of the text decides, null ids come last, rows that repeat id and text stay or go together;
    texts are compared whole, however long; columns come back whatever their names; an empty table stays empty.
    """
    return ngram_join.one_of_each(docs, k=5, t=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that stand in several documents are left in one of them, and n_chars follows.

    Null and empty texts stay as they are; a document of which no word is left goes; rows that repeat id and text are one document; texts are searched whole, however long; columns come back
    whatever their names; an empty table stays empty.
    """
    out = suffix_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids.

    Null and empty texts are the end alone; very long texts are cut into pieces; rows that repeat or tie are packed each; other columns are not read; an empty table gives no rows.
    """
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packed_sequences", packed_sequences),
]

#: SQL can't express shingle components, passage cuts or packing; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_stash(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
