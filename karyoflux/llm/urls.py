"""Verdicts on URLs by a list too large to send everywhere: a blocked Bloom filter passes possible hits to an exact hash join.

The list holds rules (host and path prefix, allow or block) and canonical URLs to block. A URL asks for a few keys: its canonical
form, and each suffix of its host at a dot with each prefix of its path that has the length of some rule's. The filter has blocks
of 256 bits; a key sets eight bits of one block, so a look-up is one row of a hash table. It is built by an aggregation on block
numbers and has a size bound: a longer list makes more false positives, never wrong results. What passes is joined with the list
by the key itself, which removes false positives. Keys that many URLs ask for (every .com host asks for "com/") are hot: those with
over 1/HOT_SHARE of the hits are fewer than HOT_SHARE, so their rows are broadcast; all others meet in a shuffled join.

A rule fits its host and all subdomains if the path starts with the rule's. The longest rule (host and path together) wins, then
the one with the longest host, then block over allow. Where no rule fits, a listed canonical URL is blocked and any other allowed.
Null URLs and those without "://" have empty host and path, fit no rule and are never listed: allow. Repeated rows are each
judged. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karyoflux.runtime import materialize

#: Bits of the filter for each key of the list, and its greatest number of blocks (of 32 bytes): 4 MB.
BITS_A_KEY, MOST_BLOCKS = 16, 1 << 17
#: Keys with over 1 / HOT_SHARE of all hits are broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters that don't change what a URL shows.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=|\z)"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without "www." and default port, path without "/" at its end, sorted parameters but for TRACKING; null without "://"."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)\z", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(url, _SPLIT, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit(""))
    return F.when(F.contains(url, F.lit("://")), F.concat(host, F.rtrim(path_of(url), F.lit("/")), query))


def url_list(rules: DataFrame, blocked: DataFrame) -> DataFrame:
    """(key, rule, verdict, host_size, path_size): one row a key, from rules (host, path, verdict) and blocked (url).

    Of rules that differ in the verdict alone block stays. rule is null for canonical URLs.
    """
    host, path = F.translate("host", _UPPER, _LOWER), F.coalesce("path", F.lit(""))
    sizes = F.length(host).alias("host_size"), F.length(path).alias("path_size")
    of_rules = rules.where("host IS NOT NULL").select(F.concat(F.lit("rule "), host, path).alias("key"), F.concat(host, path).alias("rule"), "verdict", *sizes)
    of_urls = blocked.select(canonical(F.col("url")).alias("url")).where("url IS NOT NULL")
    of_urls = of_urls.select(F.concat(F.lit("url "), "url").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(0).alias("host_size"), F.lit(0).alias("path_size"))
    return of_rules.union(of_urls).groupBy("key").agg(F.max("rule").alias("rule"), F.max("verdict").alias("verdict"), F.max("host_size").alias("host_size"), F.max("path_size").alias("path_size"))


def keys_of(host: Column, path: Column, url: Column, path_sizes: list[int], labels: int) -> Column:
    """The keys a URL asks for: suffixes of up to so many labels of its host with prefixes of path_sizes, and its canonical form."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - labels + 1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
    fitting = F.filter(F.array(*map(F.lit, path_sizes)).cast("array<int>"), lambda k: k <= F.length(path))
    rules = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda k: F.concat(F.lit("rule "), s, F.substring(path, F.lit(1), k)))))
    own = F.concat(F.lit("url "), canonical(url))
    return F.when(own.isNull(), F.array().cast("array<string>")).otherwise(F.concat(rules, F.array(own)))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """Four words of 64 bits with two bits set in each, from a hash of its own."""
    h = F.xxhash64(F.lit("bits"), key)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * j).bitwiseOR(bit(2 * j + 1)) for j in range(4)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 to w3): the filter of the keys of listed, one row a block that has any key."""
    masks = listed.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"w{j}") for j, m in enumerate(_masks(F.col("key")))])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(4)])


def filter_size(n_keys: int, bits: int = BITS_A_KEY, most: int = MOST_BLOCKS) -> int:
    """Blocks for so many keys, a power of two, most at most."""
    return min(most, 1 << max(0, (n_keys * bits - 1) // 256).bit_length())


def possible_hits(asked: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """The rows of asked (column key) whose key may be listed. filter_blocks has at most MOST_BLOCKS rows, so it is broadcast."""
    probe = asked.withColumn("block", _block(F.col("key"), blocks))
    met = probe.join(F.broadcast(filter_blocks), "block")
    for j, m in enumerate(_masks(F.col("key"))):
        met = met.where(F.col(f"w{j}").bitwiseAND(m) == m)
    return met.select(*asked.columns)


def judge(pages: DataFrame, rules: DataFrame, blocked: DataFrame, hot_share: int = HOT_SHARE, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, listed) of every row of pages (page_id, url)."""
    listed = materialize(url_list(rules, blocked), "url-list")
    n, labels, path_sizes = _shape(listed)
    rows = pages.select("page_id", "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    asked = rows.select("page_id", "url", host.alias("h"), path.alias("p"))
    asked = asked.select("page_id", "url", F.explode(keys_of(F.col("h"), F.col("p"), F.col("url"), path_sizes, labels)).alias("key"))
    blocks = filter_size(n, most=most_blocks)
    hits = materialize(possible_hits(asked, bloom_blocks(listed, blocks), blocks), "url-hits")
    found = materialize(hits.groupBy("key").agg(F.count("*").alias("hits")).join(listed, "key"), "url-found")  # exact: false positives end here
    total = found.agg(F.sum("hits")).first()[0] or 0
    hot = F.broadcast(found.where(F.col("hits") * hot_share > total))
    met = hits.join(hot, "key").unionByName(hits.join(hot.select("key"), "key", "left_anti").join(found.where(F.col("hits") * hot_share <= total), "key"))
    rank = F.when(F.col("rule").isNotNull(), F.struct((F.col("host_size") + F.col("path_size")).alias("size"), "host_size", "verdict", "rule"))
    best = met.groupBy("page_id", "url").agg(F.max(rank).alias("best"), F.bool_or(F.col("rule").isNull()).alias("listed"))
    best = best.select(F.col("page_id").alias("b_id"), F.col("url").alias("b_url"), "best", "listed")
    judged = rows.join(best, rows.page_id.eqNullSafe(best.b_id) & rows.url.eqNullSafe(best.b_url), "left")
    listed_too = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce(F.col("best.verdict"), F.when(listed_too, "block").otherwise("allow"))
    return judged.select("page_id", "url", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), verdict.alias("verdict"), listed_too.alias("listed"))


def _shape(listed: DataFrame) -> tuple[int, int, list[int]]:
    """Keys of the list, most labels of a rule's host, and the different lengths of rules' paths, as many as the longest path has at most."""
    of_host = F.substring("rule", F.lit(1), F.col("host_size"))
    n, labels, sizes = listed.agg(F.count("*"), F.max(F.size(F.split(of_host, r"\."))), F.collect_set(F.when(F.col("rule").isNotNull(), F.col("path_size")))).first()
    return n, max(labels or 0, 0), sorted(sizes)
