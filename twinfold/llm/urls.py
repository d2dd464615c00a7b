"""Url filters: a blocked Bloom filter of listed keys, then an exact hash join of what passes.

A list holds rules (host, path) with a verdict and whole canonical urls that are blocked. Each distinct url gives its keys: for every
suffix of its host that has no more labels than a listed host, and every length that a listed path has, the host suffix with the path's
first characters; and its canonical form. The keys are tested against a split-block Bloom filter (a table of 256-bit blocks, 8 bits per key,
one per word) on the block's number, where the pages are read: the filter's blocks are counted and sent to the executors up to BLOCKS_SENT of
them. Only keys that pass are shuffled and reach the join with the list itself, which removes the false positives. All of it are DataFrame
operations.

The default list, `mirror_list`, comes from the pages' content: the canonical urls whose article another canonical url had before.

Nulls: a url that is null or has no "://" has empty host and path, no key, and the default verdict; such rows are in no join. Repeated urls
are judged once and joined back to all their rows. A very long url is as many characters in each of its keys, of which there are no
more than listed labels times listed path lengths. An empty list lets everything pass, empty pages give an empty result. Other columns
of the pages are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hint_small, pinned

#: The contract's rules, (verdict, host, path): fixed values.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: What a page's article stands between.
ARTICLE = ("<article>", "</article>")
#: Odd multipliers of the eight words of a block, one bit each (fixed values of the split-block Bloom filter of the Parquet format).
SALT = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
BLOCKS_SENT = 200_000  # blocks (32 bytes each) that are sent to every executor at most; a larger filter is joined
KEYS_PER_BLOCK = 20  # 12.8 bits per key: about 0.4 % false positives
VERDICT_BYTES = 16 << 20  # of verdicts (their urls and rules) that are sent to the tasks that read the pages at most


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty where it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One form for a page's urls: without scheme, query, fragment, a leading www., a closing slash or .html; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.|:(80|443)$", ""), F.regexp_replace(path, r"(?:/|\.html)$", "")))


def _bits(key_hash: Column) -> list[Column]:
    """The bit of each of a block's eight words."""
    low = key_hash.bitwiseAND(F.lit(0x7FFFFFFF))  # 31 bits, so that the product fits a long
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")) for s in SALT]


def _block(key_hash: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(key_hash, 32), F.lit(blocks)).cast("int")


def bloom(keys: DataFrame, key: str = "key") -> tuple[DataFrame, int]:
    """The filter's table (block, w0 to w7) over the keys, and its number of blocks."""
    blocks = max(1, -(-keys.count() // KEYS_PER_BLOCK))
    h = F.xxhash64(key)
    bits = keys.select(_block(h, blocks).alias("block"), *(x.alias(f"w{i}") for i, x in enumerate(_bits(h))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8))), blocks


def may_hold(candidates: DataFrame, filter_table: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """The candidates that the filter passes: all listed ones and a few others."""
    h = F.xxhash64(key)
    asked = candidates.select("*", _block(h, blocks).alias("block"), *(x.alias(f"b{i}") for i, x in enumerate(_bits(h))))
    hit = asked.join(hint_small(filter_table, blocks, BLOCKS_SENT), "block")  # where it is sent, candidates are tested before any shuffle
    for i in range(8):
        hit = hit.filter(F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) != 0)
    return hit.select(*candidates.columns)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Columns key (host and path as one), verdict, path_length of (verdict, host, path) rules."""
    rows = [(host + path, verdict, len(path)) for verdict, host, path in rules]
    return spark.createDataFrame(rows, "key string, verdict string, path_length int")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url", page_id: str = "page_id", default: str = "allow") -> DataFrame:
    """page_id, host, path, canonical, rule and verdict of each page.

    rules: as of `rule_table`. listed: a column `canonical` of blocked urls. The longest fitting rule wins (of equally long ones the
    larger string); without one, a listed canonical url is blocked, and others get the default.
    """
    lengths = [r[0] for r in rules.select("path_length").distinct().collect()]  # the few lengths of the listed paths
    most = rules.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))).alias("n")).first()["n"] or 0  # labels of a listed host
    host, path = host_path(F.col("url"))
    urls = pages.select(F.col(url).alias("url")).filter(F.col("url").isNotNull()).select("url", host.alias("host"), path.alias("path")).filter("host != ''")
    suffixes = F.array_distinct(F.array(*(F.substring_index("host", ".", -n) for n in range(1, most + 1)))) if most else F.array().cast("array<string>")
    heads = F.array_distinct(F.array(*(F.substring("path", 1, n) for n in lengths))) if lengths else F.array(F.lit(None).cast("string"))
    keys = F.transform(F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p)))), lambda k: F.struct(k.alias("key"), F.lit("rule").alias("kind")))
    own = F.array(F.struct(canonical(F.col("host"), F.col("path")).alias("key"), F.lit("listed").alias("kind")))
    asked = urls.select("url", F.explode(F.concat(keys, own)).alias("k")).select("url", "k.key", "k.kind").filter("key is not null")

    entries = rules.select("key", F.lit("rule").alias("kind"), "verdict").unionByName(listed.select(F.col("canonical").alias("key"), F.lit("listed").alias("kind"), F.lit("block").alias("verdict"))).filter("key is not null").distinct()
    entries = pinned(entries)
    table, blocks = bloom(entries)
    # urls meet only behind the filter and the list, in an aggregation that repeated ones don't change
    hits = may_hold(asked, table, blocks).join(hint_small(entries, entries.count()), ["key", "kind"])
    longest = F.max(F.when(F.col("kind") == "rule", F.struct(F.length("key").alias("n"), "key", "verdict")))
    found = pinned(hits.groupBy("url").agg(longest.alias("rule"), F.bool_or(F.col("kind") == "listed").alias("listed")))
    size = found.agg(F.sum(F.octet_length("url") + F.coalesce(F.octet_length("rule.key"), F.lit(0)) + 64).alias("bytes")).first()["bytes"] or 0
    shown = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    host, path = host_path(F.col("url"))
    shown = shown.select("page_id", "url", host.alias("host"), path.alias("path"))
    apart = shown.filter("host = ''").withColumn("rule", F.lit(None).cast(found.schema["rule"].dataType)).withColumn("listed", F.lit(None).cast("boolean"))
    judged = shown.filter("host != ''").join(F.broadcast(found) if size <= VERDICT_BYTES else found, "url", "left").unionByName(apart)
    return judged.select(
        "page_id", "host", "path", canonical(F.col("host"), F.col("path")).alias("canonical"), F.col("rule.key").alias("rule"),
        F.coalesce(F.col("rule.verdict"), F.when(F.col("listed"), "block"), F.lit(default)).alias("verdict"),
    )


def mirror_list(pages: DataFrame, url: str = "url", page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(canonical, original): the canonical urls of pages whose article, to the byte, has a smaller page_id at another canonical url.

    Pages without a host or an article are left out; an empty article counts as none. Only digests are shuffled, one row per digest and canonical url and task.
    """
    host, path = host_path(F.col(url))
    opened = F.substring_index(F.col(html), ARTICLE[0], -1)
    article = F.when(F.contains(F.col(html), F.lit(ARTICLE[0])) & F.contains(opened, F.lit(ARTICLE[1])), F.substring_index(opened, ARTICLE[1], 1))
    seen = pages.select(F.col(page_id).alias("page_id"), canonical(host, path).alias("canonical"), F.md5(F.encode(F.nullif(article, F.lit("")), "UTF-8")).alias("digest")).filter("canonical is not null and digest is not null")
    each = seen.groupBy("digest", "canonical").agg(F.min("page_id").alias("page_id"))
    first = each.groupBy("digest").agg(F.min(F.struct("page_id", "canonical")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.canonical").alias("original"))
    return each.join(first, "digest").filter("canonical <> original").groupBy("canonical").agg(F.min("original").alias("original"))


def judged_pages(spark: SparkSession, pages: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """The contract's columns. listed: a column `canonical` of blocked urls; the mirrors among the pages (see `mirror_list`), if not given."""
    return judge(pages, rule_table(spark, RULES), mirror_list(pages) if listed is None else listed).select("page_id", "host", "path", "rule", "verdict", "canonical")
