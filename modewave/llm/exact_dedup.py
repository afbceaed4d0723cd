"""Exact duplicates by progressive refinement, in DataFrame operations only.

Rows are grouped by byte length; lengths that occur once are settled. What is left is grouped by
length and a hash of the first bytes; only rows that survive this too are grouped by the digest of the whole text.
Each step is a partial aggregate before its shuffle, so that a group of copies that holds a third of all rows arrives
as one row for each map task. Keys that hold more than 1 / HEAVY of all rows are joined by broadcast, as there are at
most HEAVY of them whatever the input; so no task of a shuffle join gets all rows of such a key.

``exact_groups`` owes the digest of every row, so it is taken with the other measures in the one pass over the texts.
``drop_exact`` doesn't: there only survivors' texts are hashed in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, restored, stash

PREFIX_BYTES = 256
#: A key is heavy if it holds more than one in HEAVY of all rows, and LEAST_HEAVY at least.
HEAVY = 2000
LEAST_HEAVY = 1000


def _measures(text: Column, prefix_bytes: int) -> tuple[Column, Column]:
    return F.octet_length(text).alias("len"), F.xxhash64(F.substring(text, 1, prefix_bytes)).alias("prefix")


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    """The keys that stand for more than one row, and for how many."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _joined(rows: DataFrame, keys: DataFrame, by: list[str], least: int, *cols: str) -> DataFrame:
    """``rows`` with ``n`` and ``cols`` of ``keys`` (null without a key): heavy keys by broadcast, the others by shuffle."""
    heavy = keys.where(F.col("n") > least)  # at most HEAVY rows
    light = keys.where(F.col("n") <= least)
    got = ["n", *cols]
    hot = rows.join(F.broadcast(heavy), by, "left")
    rest = hot.where("n is null").drop(*got).join(light, by, "left")
    return hot.where("n is not null").unionByName(rest)


def _least(n_rows: int) -> int:
    return max(LEAST_HEAVY, n_rows // HEAVY)


def survivors(rows: DataFrame, least: int) -> DataFrame:
    """Of ``rows`` (len, prefix, ...) those whose length, and prefix among them, another row shares."""
    by_length = _joined(rows, _counted(rows, "len"), ["len"], least).where("n is not null").drop("n")
    return _joined(by_length, _counted(by_length, "len", "prefix"), ["len", "prefix"], least).where("n is not null").drop("n")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; null counts as empty, so all null and empty texts are one
    group. Texts are hashed whole, however long. Of a group the row with the largest id stays; a null id stays only if all ids of its group are
    null (then keep_id is null and every row is kept). Rows that repeat both id and text are flagged alike.
    Other columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = stash(df.select(F.col(f"`{id_col}`").alias("doc_id"), *_measures(text, prefix_bytes), F.sha2(text, 256).alias("text_sha256")), "exact-rows")
    least = _least(rows.count())
    groups = survivors(rows, least).groupBy("text_sha256").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return _joined(rows, groups, ["text_sha256"], least, "keep").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """The rows of ``df`` that stay, one of each text, all columns as they came, whatever their names.

    Of equal texts the row with the largest id stays, one without an id only if all are without; of rows that tie
    (repeat the id too) any one. Null and empty texts are equal. Texts of any length are compared by the digest of the whole.
    An empty table gives an empty result.
    """
    text = F.coalesce("k1", F.lit("")).cast("binary")
    rows = carried(df, id_col, text_col).select("rest", F.col("k0").alias("id"), *_measures(text, prefix_bytes), text.alias("data"))
    sizes = stash(rows.select("len", "prefix"), "exact-sizes")
    least = _least(sizes.count())
    keys = stash(_counted(survivors(sizes, least), "len", "prefix"), "exact-keys")
    marked = _joined(rows, keys, ["len", "prefix"], least)
    alone = marked.where("n is null").select("rest")
    one = marked.where("n is not null").groupBy("len", F.sha2("data", 256).alias("sha")).agg(F.max_by("rest", F.struct(F.col("id").isNotNull(), "id")).alias("rest"))
    return restored(alone.unionByName(one.select("rest")), df)


SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
