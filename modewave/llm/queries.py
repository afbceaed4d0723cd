"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, lm_score, ngram_join, packing, quality, sharding, suffix_dedup, toxicity, url_filter
from .common import shared_dir, stash, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels outside the held-out part. Null and empty texts score the intercept, very long ones are scored whole; repeated and null ids are scored row by row; no documents, no rows."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens. Null and empty texts are the end alone; very long ones are cut; repeated rows are packed each; no documents, no rows."""
    out = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page. Null and empty urls have empty host and path and are allowed; very long ones are read whole; repeated rows get one each; no pages, no rows."""
    pages = table(spark, sf_dir, "pages")
    listed = stash(url_filter.listing(url_filter.RULES, url_filter.listed_urls(pages)), "url-list")
    return url_filter.judged(pages, listed, [len(p) for _, _, p in url_filter.RULES], max(h.count(".") + 1 for _, h, _ in url_filter.RULES))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and a place for every document, by a map saved and read again. Null and empty texts weigh 1; very long ones are read whole; repeated ids share a shard, null ids too; no documents, no rows."""
    store = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    sharding.SlotMap.of(8).save(spark, store)
    rows, _ = sharding.sharded(table(spark, sf_dir, "documents"), sharding.SlotMap.load(spark, store), store=store)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a verdict for every document. Null and empty texts fail; very long ones are read whole; repeated rows are judged alike; a null language is one of its own; no documents, no rows."""
    rows = stash(quality.measured(table(spark, sf_dir, "documents")), "quality")
    cuts = stash(quality.cutoffs(rows, table(spark, sf_dir, "labels")).coalesce(1), "cutoffs")
    return quality.judged(rows, cuts).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed").alias("failed_rules")
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document. Null and empty texts are their end alone; very long ones are scored in pieces; repeated rows are texts of their own; null ids count as empty; no documents, no rows."""
    return lm_score.scored(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component. Null and empty texts link with nothing; very long ones are compared whole; repeated rows are alike; a null id names a component only where there is no other; no documents, no rows."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=4, t=85).select("doc_id", "n_shingles", "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts. Null and empty texts are equal; very long ones are hashed whole; repeated rows are flagged alike; a null id stays only where there is no other; no documents, no rows."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to. Null and empty texts have no ids; very long ones are encoded whole, in safe pieces; repeated rows give repeated rows; no documents, no rows."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents. Null, empty and short texts have none; very long ones are searched whole; rows alike in id and text are one document; no documents, no rows."""
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_url_filter": op3_url_filter,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_lm_score": op6_lm_score,
    "op7_ngram_join": op7_ngram_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_bpe": op9_bpe,
    "op10_suffix_dedup": op10_suffix_dedup,
}

SQL = {"op3_url_filter": url_filter.SQL, "op7_ngram_join": ngram_join.SQL, "op8_exact_dedup": exact_dedup.SQL}
