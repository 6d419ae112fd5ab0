"""URL filters: path rules first, then a blocked Bloom filter and an exact join against a list of URLs.

A URL is canonical as its host (A-Z in lower case) and path; scheme, query and fragment are ignored. A listed URL
covers its host's subdomains and everything below its path, so each URL is looked up by its host suffixes and path
prefixes, those of the lengths that listed hosts and paths have. The filter has a fixed number of blocks of 256 bits; a key sets one bit in each of the four words of its
block. It is broadcast, as its size is fixed whatever the length of the list; what passes goes to an exact hash join,
which removes false positives. The longest rule that fits decides before the list.

Null URLs and those without ``://`` have an empty host and path, fit no rule and are on no list. Repeated rows are
judged each. Columns of the input other than the URL don't take part. A URL is looked up as a whole, however long: by as many
keys at most as there are lengths of listed hosts times lengths of listed paths, however many labels and segments it has.
An empty table gives an empty result. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.shared import save

#: Blocks of the Bloom filter: 65,536 x 40 bytes, 2.6 MB at most.
BLOCKS = 1 << 16
PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PATTERN, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATTERN, 2), F.lit(""))


def fits(rule: str) -> Column:
    """Whether host and path fall under a rule such as example.com/en/."""
    name, _, below = rule.partition("/")
    return ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + below)


def lookups(hosts: Sequence[int], paths: Sequence[int]) -> Column:
    """Canonical URLs that would cover host and path, of the given lengths of hosts and paths: every host suffix with every path
    prefix that ends in a slash, and the path itself."""
    numbers = lambda x: F.array(*map(F.lit, sorted(x))).cast("array<int>")
    end, whole = F.length("host"), F.length("path")
    suffixes = F.filter(numbers(hosts), lambda n: (n == end) | ((n < end) & (F.substring("host", end - n, F.lit(1)) == ".")))
    prefixes = F.filter(numbers(paths), lambda n: (n == whole) | ((n > 0) & (n < whole) & (F.substring("path", n, F.lit(1)) == "/")))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(F.substring("host", end - h + 1, h), F.substring("path", F.lit(1), p)))))


def _bits(key: Column) -> tuple[Column, list[Column]]:
    """Block of a key, and its bit in each of the four words."""
    h, g = F.xxhash64(key), F.xxhash64(F.lit(1), key)
    return F.pmod(h, F.lit(BLOCKS)).cast("int").alias("block"), [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")) for k in range(4)]


def bloom(listed: DataFrame) -> DataFrame:
    """block, w0 .. w3 of the distinct column key; BLOCKS rows at most."""
    block, bits = _bits(F.col("key"))
    return listed.select(block, *(b.alias(f"b{k}") for k, b in enumerate(bits))).groupBy("block").agg(*(F.bit_or(f"b{k}").alias(f"w{k}") for k in range(4)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), listed_as (the longest listed URL that covers the page, or null).

    rules: (verdict, rule). listed: url column of URLs to block, of any length.
    """
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for word, r in sorted(rules, key=lambda x: len(x[1])):
        rule, verdict = F.when(fits(r), F.lit(r)).otherwise(rule), F.when(fits(r), F.lit(word)).otherwise(verdict)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    parts = listed.select(host(F.col("url")).alias("h"), path(F.col("url")).alias("p"))
    keys = save(parts.select(F.concat("h", "p").alias("key"), F.length("h").alias("h"), F.length("p").alias("p")).where("key <> ''").distinct())
    lengths = keys.agg(F.collect_set("h").alias("h"), F.collect_set("p").alias("p")).first()  # as many at most as the longest listed URL has characters
    keys = keys.select("key")
    block, bits = _bits(F.col("key"))
    probes = rows.where("rule IS NULL AND host <> ''").select("host", "path").distinct().select("host", "path", F.explode(lookups(lengths.h, lengths.p)).alias("key"))
    probes = probes.withColumns({"block": block} | {f"b{k}": b for k, b in enumerate(bits)}).join(F.broadcast(bloom(keys)), "block")
    for k in range(4):
        probes = probes.where(F.col(f"w{k}").bitwiseAND(F.col(f"b{k}")) != 0)
    hits = probes.select("host", "path", "key").join(keys, "key").groupBy("host", "path").agg(F.max_by("key", F.struct(F.length("key"), "key")).alias("listed_as"))
    out = rows.join(hits, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("rule").isNull() & F.col("listed_as").isNotNull(), "block").otherwise("allow")).alias("verdict"), "listed_as")
