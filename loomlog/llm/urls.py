"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Each listed URL sets eight bits within one block of 256; blocks are built by a grouped bitwise or.
A page whose block lacks a bit is certainly not listed. The few others are joined with the
list itself, which takes out the filter's false hits. Rules on host and path come first.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and
is allowed. Repeated pages are judged each. An empty list allows all that no rule blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_URL, BLOCK_BITS = 16, 256
# up to here the filter is broadcast: five longs a block
BROADCAST_BYTES = 8 << 20
_WORDS = ("w0", "w1", "w2", "w3")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# fixed values: the rules of the query
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
# parts of host names that put a page's URL on the query's list
HOST_TERMS = ("casino", "pills", "bets", "spam", "poker", "porn", "xxx")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One spelling for a page: no scheme, query, fragment, ``www.`` or ``m.``, ending or slash."""
    return F.concat(
        F.regexp_replace(host, r"^(www|m)\.", ""),
        F.regexp_replace(path, r"(/index)?(\.html?)?/*$", ""),
    )


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Name and verdict of the longest rule that fits, else null."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in reversed(ranked):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        one = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, one).otherwise(found)
    return found


def _masks(url: Column) -> list[Column]:
    """Four 64-bit words with two bits set in each."""
    bits = F.xxhash64(url, F.lit("bits"))

    def bit(k):
        return F.call_function(
            "shiftleft",
            F.lit(1).cast("long"),
            F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int"),
        )

    return [bit(2 * k).bitwiseOR(bit(2 * k + 1)) for k in range(4)]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("block")), F.lit(blocks))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter: ``(block, w0..w3)`` of the distinct URLs in ``listed``."""
    url = F.col("url")
    masks = dict(zip(_WORDS, _masks(url)))
    return (
        listed.select(_block(url, blocks).alias("block"), *(m.alias(w) for w, m in masks.items()))
        .groupBy("block")
        .agg(*(F.bit_or(w).alias(w) for w in _WORDS))
    )


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``; ``listed`` has one column of canonical URLs."""
    listed = listed.toDF("url").filter("url is not null").distinct()
    host, path = host_and_path(F.col("page_url"))
    ruled = (
        pages.select("page_id", F.col("url").alias("page_url"))
        .select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("url", canonical(F.col("host"), F.col("path")))
        .withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules))
        .select("page_id", "host", "path", "url", "found.rule", "found.verdict")
    )
    blocks = max(1, -(-listed.count() * BITS_PER_URL // BLOCK_BITS))
    filter_rows = bloom(listed, blocks)
    if blocks * 40 <= BROADCAST_BYTES:
        filter_rows = F.broadcast(filter_rows)
    misses = None
    for word, mask in zip(_WORDS, _masks(F.col("url"))):
        missing = F.coalesce(F.col(word).bitwiseAND(mask) != mask, F.lit(True))
        misses = missing if misses is None else misses | missing
    probed = (
        ruled.withColumn("block", _block(F.col("url"), blocks))
        .join(filter_rows, "block", "left")
        .withColumn("possible", F.col("verdict").isNull() & ~misses)
    )
    out = ["page_id", "host", "path", "rule"]
    settled = probed.filter("not possible").select(
        *out, F.coalesce("verdict", F.lit("allow")).alias("verdict")
    )
    exact = (
        probed.filter("possible")
        .select(*out, "url")
        .join(listed.withColumn("hit", F.lit(True)), "url", "left")
        .select(*out, F.when(F.col("hit"), "block").otherwise("allow").alias("verdict"))
    )
    return settled.unionByName(exact)


def listed_by_host(pages: DataFrame, terms=HOST_TERMS) -> DataFrame:
    """Canonical URLs of pages on hosts whose name holds one of the terms."""
    host, path = host_and_path(F.col("url"))
    return (
        pages.select(host.alias("host"), path.alias("path"))
        .filter(F.col("host").rlike("|".join(terms)))
        .select(canonical(F.col("host"), F.col("path")).alias("url"))
        .distinct()
    )
