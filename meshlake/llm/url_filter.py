"""URL filter [native]: host and path rules, then a blocked Bloom filter in front of an exact join with a list.

A URL's verdict is that of the longest rule that fits it. Where none fits, the list decides: a canonical URL on
the list blocks. The Bloom filter of the list has 512-bit blocks (eight 64-bit words, one bit in each), is bounded
by ``max_blocks`` and is therefore broadcast; its possible hits alone are shuffled to the exact join, which removes
the false positives. Rows that the filter clears are never shuffled.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is never listed.
Repeated rows are each judged. An empty list lists nothing. Columns beyond the URL ride along untouched; one that is called
like a result is kept as ``<name>_input``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import ascii_lower, durable, free_name, set_aside

WORDS = 8
#: Fixed bound of the broadcast: 65,536 blocks of 64 bytes and a key, 5 MB.
MAX_BLOCKS = 1 << 16
KEYS_A_BLOCK = 40
#: Query parameters that say where a visitor came from and not which page it is (fixed values).
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_of(url: Column) -> Column:
    """Host without ``www.``, path without a final slash, and the sorted query without tracking; null if no host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike(TRACKING) & (p != ""))), "&")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. A rule is ("block" | "allow", "host/path")."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, verdict)


def _address(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key and the bit of each of its words."""
    bits = F.xxhash64(url, F.lit(1))
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int"), [F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter as a table of at most ``blocks`` rows."""
    block, bits = _address(F.col(key), blocks)
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    return listed.select(block.alias("block"), *[one(b).alias(f"w{i}") for i, b in enumerate(bits)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def with_listed(df: DataFrame, url: str, listed: DataFrame, key: str, out: str = "listed", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``df`` with a boolean ``out``: whether its ``url`` column is in ``listed[key]`` exactly."""
    listed = durable(listed.select(F.col(key).alias("__key")).where("__key IS NOT NULL").distinct())
    blocks = max(1, min(max_blocks, math.ceil(listed.count() / KEYS_A_BLOCK)))
    bloom = bloom_blocks(listed, "__key", blocks)
    block, bits = _address(F.col(url), blocks)
    at, maybe = free_name(df, "block"), free_name(df, "maybe")
    bloom = bloom.withColumnsRenamed({"block": at, **{f"w{i}": f"{at}{i}" for i in range(WORDS)}})
    set_ = F.lit(True)
    for i, b in enumerate(bits):
        set_ = set_ & (F.call_function("shiftright", F.col(f"{at}{i}"), b).bitwiseAND(F.lit(1)) == 1)
    probed = df.withColumn(at, block).join(F.broadcast(bloom), at, "left").withColumn(maybe, F.coalesce(set_ & F.col(url).isNotNull(), F.lit(False)))
    kept = [F.col(f"`{c}`") for c in df.columns]
    exact = listed.select(F.col("__key").alias(at + "k"), F.lit(True).alias(at + "l"))
    hits = probed.where(F.col(maybe)).select(*kept).join(exact, F.col(url) == F.col(at + "k"), "left")
    return hits.select(*kept, F.coalesce(F.col(at + "l"), F.lit(False)).alias(out)).unionByName(probed.where(~F.col(maybe)).select(*kept, F.lit(False).alias(out)))


def filter_urls(df: DataFrame, url: str, rules: list[tuple[str, str]], listed: DataFrame, key: str) -> DataFrame:
    """``df`` with host, path, canonical, listed, rule and verdict."""
    given = free_name(df, "url")
    df = set_aside(df.withColumn(given, F.col(url)), "host", "path", "canonical", "listed", "rule", "verdict")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"host": host_of(F.col(given)), "path": path_of(F.col(given)), "canonical": canonical_of(F.col(given))}).drop(given)
    df = with_listed(df, "canonical", listed, key)
    return df.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")))
