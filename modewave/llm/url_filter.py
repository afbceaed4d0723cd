"""URL filter: a blocked Bloom filter of listed keys passes possible hits to an exact hash join.

The list has two kinds of entry: rules (a host with its subdomains, and a path prefix) and canonical
URLs that are listed one by one. Both are strings in one list, told apart by their first character, and both
go through the filter: a url's candidates that the filter passes are joined with the list itself, which
removes the filter's false positives. A verdict depends on host and path only, so everything runs on the
distinct pairs, and the pages take their verdicts by one join.

The filter is one 64-bit word for each block; a key sets 4 bits of one word. It grows with the list, KEYS_PER_BLOCK keys a block.
Up to BROADCAST_BLOCKS blocks it is broadcast; a larger one is dealt by block and meets the candidates there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BLOCKS = 1 << 18
KEYS_PER_BLOCK = 4

#: (verdict, host, path prefix)
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: str = "url") -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    u = F.coalesce(F.col(url), F.lit(""))
    return F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.``, and the path without a last ``/`` or ``.html``; query and fragment are gone."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""))


def blocks_for(n_keys: int) -> int:
    n = 1
    while n * KEYS_PER_BLOCK < n_keys:
        n *= 2
    return n


def block_of(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


#: The four bits of a key, from the column h.
BITS = " | ".join(f"shiftleft(1L, cast(shiftright(h, {6 * i}) & 63L as int))" for i in range(4))


def blocked_filter(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, word): at most ``n_blocks`` rows. ``keys`` has one column, key."""
    return (
        keys.select(block_of(F.col("key"), n_blocks).alias("block"), F.xxhash64("key", F.lit(1)).alias("h"))
        .selectExpr("block", f"{BITS} as bits")
        .groupBy("block").agg(F.expr("bit_or(bits)").alias("word"))
    )


def listing(rules: Sequence[tuple[str, str, str]], urls: DataFrame) -> DataFrame:
    """The list: key, verdict, rule (null for urls). ``urls`` has canonical URLs in its column ``canon``.

    A rule that is listed with both verdicts blocks. Null and empty URLs list nothing; rules listed twice do no harm.
    """
    structs = [F.struct(F.lit("r" + h + p).alias("key"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")) for v, h, p in rules]
    fixed = urls.sparkSession.range(1).select(F.inline(F.array(*structs)))
    rule = fixed.groupBy("key").agg(F.max("verdict").alias("verdict"), F.first("rule").alias("rule"))
    return rule.unionByName(
        urls.where("canon <> ''").select(F.concat(F.lit("u"), "canon").alias("key")).distinct()
        .select("key", F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("rule"))
    )


def judged(pages: DataFrame, listed: DataFrame, path_lengths: Sequence[int], labels: int, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    ``path_lengths`` and ``labels``: the lengths of the rules' paths, and the most labels of a rule's host. A url has one candidate for
    each suffix of its host of so many labels at most and each such length, and one for its canonical form. The longest rule that fits decides; without
    one, a listed canonical URL is blocked and any other url allowed. Null and empty urls and urls without ``://`` have
    empty host and path, which nothing fits. Urls are read whole, however long; a host's labels beyond the rules' cost nothing. Repeated rows each get a
    verdict. Other columns are not read. An empty table gives an empty result.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    blank = (F.col("host") == "") & (F.col("path") == "")
    places = rows.where(~blank).select("host", "path").distinct()
    lengths = sorted(set(path_lengths)) or [0]
    keys = f"""
        concat(
          flatten(transform(array_distinct(transform(sequence(1, {max(1, labels)}), i -> substring_index(host, '.', -i))), h ->
            transform(filter(array({", ".join(map(str, lengths))}), n -> n <= length(path)), n ->
              concat('r', h, substring(path, 1, n))))),
          array(concat('u', canon)))"""
    n_blocks = blocks_for(listed.count())
    words = blocked_filter(listed.select("key"), n_blocks)
    hits = (
        places.withColumn("canon", canonical(F.col("host"), F.col("path")))
        .select("host", "path", F.explode(F.expr(keys)).alias("key"))
        .select("host", "path", "key", block_of(F.col("key"), n_blocks).alias("block"), F.xxhash64("key", F.lit(1)).alias("h"))
        .join(F.broadcast(words) if n_blocks <= BROADCAST_BLOCKS else words, "block")
        .where(f"word & ({BITS}) = ({BITS})")
        .select("host", "path", "key")
    )
    verdicts = (
        hits.join(listed.hint("shuffle_hash"), "key")
        .groupBy("host", "path")
        .agg(
            F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("best"),
            F.max(F.col("rule").isNull()).alias("listed"),
        )
    )
    told = rows.where(~blank).join(verdicts, ["host", "path"], "left").select(
        "page_id", "host", "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("listed"), "block"), F.lit("allow")).alias("verdict"),
        F.coalesce("listed", F.lit(False)).alias("listed"),
    )
    none = rows.where(blank).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(False).alias("listed"))
    return told.unionByName(none)


#: Site names whose pages' canonical URLs make up the list of the query.
SPAM_SITES = ("spam-farm", "cheap-pills")


def listed_urls(pages: DataFrame, sites: Sequence[str] = SPAM_SITES, url_col: str = "url") -> DataFrame:
    """Canonical URLs of the pages of these sites: ``canon``, each once."""
    host = host_of(url_col)
    return pages.where(host.rlike(rf"(^|\.)({'|'.join(sites)})\.")).select(canonical(host, path_of(url_col)).alias("canon")).distinct()


SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), r AS (
  SELECT * FROM (VALUES
    (5, 'example.net/de/8', 'block', 'example.net', '/de/8'),
    (4, 'example.com/en/7', 'allow', 'example.com', '/en/7'),
    (3, 'com/en/', 'block', 'com', '/en/'),
    (2, 'org/es/', 'block', 'org', '/es/'),
    (1, 'net/de/', 'allow', 'net', '/de/')) v(prio, rule, verdict, rhost, rpath)
), best AS (
  SELECT host, path, arg_max(rule, prio) AS rule, arg_max(verdict, prio) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) q JOIN r
    ON (q.host = rhost OR q.host LIKE '%.' || rhost) AND starts_with(q.path, rpath)
  GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.verdict, CASE WHEN s THEN 'block' ELSE 'allow' END) AS verdict, s AS listed
FROM (SELECT *, regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.') AS s FROM p) p
LEFT JOIN best b USING (host, path)
"""
