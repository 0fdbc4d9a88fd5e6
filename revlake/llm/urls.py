"""URL rules by host and path prefix: a blocked Bloom filter, then an exact hash join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block of the filter is four 64-bit words; a key sets one bit in each. So many keys share a block.
KEYS_PER_BLOCK = 8
#: Up to so many bytes, counted before, the filter or the rule table is broadcast; above, both are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to / ? # or end, A-Z lower-cased) and path (from there up to ? or #).

    Both are empty where the url is null or has no ``://``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = rest.substr(F.length(raw) + 1, F.length(rest))
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(after, "^[^?#]*", 0)


def canonical_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules as key (host and path prefix in one), host, verdict; of equal rules a block wins.

    ``rules`` has the columns rule (``host/prefix``) and verdict (allow or block). Null and host-less rules
    fit no url and are left out; a rule without a slash has the empty prefix.
    """
    rule = F.col("rule")
    slash = F.instr(rule, "/")
    host = F.when(slash > 0, rule.substr(F.lit(1), slash - 1)).otherwise(rule)
    prefix = F.when(slash > 0, rule.substr(slash, F.length(rule))).otherwise("")
    split = rules.filter("rule IS NOT NULL AND verdict IS NOT NULL").select(
        F.translate(host, UPPER, LOWER).alias("rule_host"), prefix.alias("prefix"), "verdict"
    )
    named = split.filter("rule_host != ''").withColumn("key", F.concat("rule_host", "prefix"))
    return named.groupBy("key", "rule_host", "prefix").agg(F.max("verdict").alias("verdict"))


def _bits(key: Column) -> list[Column]:
    """One bit in each of a block's four words."""
    spread = F.xxhash64(key, F.lit(7))
    places = [F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int") for i in range(4)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table: block number and its four words, for the strings in column ``key``."""
    words = [b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("key")))]
    at = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
    return keys.select(at, *words).groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(4)])


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Verdict on every page's url by the longest listed rule that fits it.

    A rule fits its host and all subdomains if the url's path starts with the rule's prefix. Each url's
    possible keys (host endings times path beginnings, of the lengths that occur in the list) pass the
    Bloom filter, a table of blocks joined by block number; what passes is joined with the rules by
    hash, which removes false positives. Of the rules that fit, the longest wins (then the longer host). An unlisted url gets ``default``.

    Returns page_id, host, path, rule (null if none) and verdict for each row of ``pages``. Null urls and such
    without ``://`` have an empty host and path and fit no rule. Null ids and repeated rows stay as they are;
    other columns are not read. Only lengths of rules (pairs of small numbers) reach the driver.
    """
    listed = canonical_rules(rules)
    labels = F.size(F.split("rule_host", "\\.", -1))
    shapes = listed.groupBy(labels.alias("labels"), F.length("prefix").alias("chars")).agg(F.count("*").alias("n"), F.sum(F.octet_length("key") + 40).alias("bytes")).collect()
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not shapes:
        return seen.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    total = sum(s["n"] for s in shapes)
    small = max(sum(s["bytes"] for s in shapes), total * 40) <= broadcast_bytes
    side = F.broadcast if small else (lambda df: df)
    blocks = max(1, math.ceil(total / KEYS_PER_BLOCK))

    known = F.array(*[F.struct(F.lit(s["labels"]).alias("labels"), F.lit(s["chars"]).alias("chars")) for s in shapes])
    depth = F.size(F.split("host", "\\.", -1))
    fitting = F.filter(known, lambda s: (s["labels"] <= depth) & (s["chars"] <= F.length("path")))
    key = F.transform(
        fitting,
        lambda s: F.struct(
            F.concat(
                F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]),
                F.col("path").substr(F.lit(1), s["chars"]),
            ).alias("key"),
            F.length(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"])).alias("host_chars"),
        ),
    )
    tried = seen.select("host", "path").filter("host != ''").distinct().select("host", "path", F.explode(key).alias("k"))
    tried = tried.select("host", "path", "k.*").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    bits = _bits(F.col("key"))
    possible = tried.join(side(bloom_blocks(listed, blocks)), "block")
    for i, bit in enumerate(bits):
        possible = possible.filter(F.col(f"w{i}").bitwiseAND(bit) != 0)
    exact = listed.select("key", F.length("rule_host").alias("host_chars"), "verdict")
    found = possible.select("host", "path", "key", "host_chars").join(side(exact), ["key", "host_chars"])
    best = found.groupBy("host", "path").agg(
        F.max(F.struct(F.length("key").alias("chars"), "host_chars", "verdict", F.col("key").alias("rule"))).alias("best")
    )
    judged = seen.join(best, ["host", "path"], "left")
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
