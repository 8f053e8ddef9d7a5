"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits, each set if over half of the XXH64 hashes (seed 42) of a text's word shingles set it.
Documents are first grouped by fingerprint (map-side combined), so copies however many are one row from there on.
Distinct fingerprints that differ in at most ``distance`` bits share at least ``blocks - distance`` of their ``blocks``
equal blocks (4 of 16 bits unless said): each is dealt out under every choice of that many blocks, joined on the choice and its bits, and the
pairs are verified by Hamming distance. A pair is kept only at the first choice on which it agrees, so none repeats.
A group of more than ``CROWD`` fingerprints isn't joined with itself: what its fingerprints don't share yet is split into blocks
again, and so on. Each time that leaves fewer bits, so the last groups are small by themselves and no pair is lost.
Components come from alternating large-star and small-star steps over the links, which end in logarithmic rounds.

Edge cases: null and empty texts have fingerprint zero and are linked like any other. Repeated rows each get their
row. A group whose ids are all null has a null component. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import arrow_stage, durable

BITS, BLOCKS, SEED, CROWD = 64, 4, 42, 256


def hashes(text: str | bytes | None, words: int) -> np.ndarray:
    """Of each word shingle of a text; a text of fewer words is one shingle."""
    raw = text.encode() if isinstance(text, str) else text or b""
    w = raw.lower().split()  # of bytes: lower-cases A-Z and splits at the six ASCII white-space bytes only
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def fingerprint(text: str | bytes | None, words: int) -> int:
    """The fingerprint as a signed 64-bit integer."""
    return majority(hashes(text, words))


def majority(h: np.ndarray) -> int:
    """Of hashes: the bits that over half of them have, as a signed 64-bit integer."""
    if not len(h):
        return 0
    # Sums of 255 rows of bits at most fit a byte.
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, key: str, text: str, words: int = 5, out: str = "fp") -> DataFrame:
    """(key, out) for each row."""
    kind = df.schema[key].dataType.simpleString()
    return arrow_stage(
        df.select(F.col(key), F.col(text)),
        lambda b: {key: b.column(0), out: [fingerprint(x, words) for x in b.column(1).cast(pa.binary()).to_pylist()]},
        f"`{key}` {kind}, `{out}` bigint",
    )


def _part(v: Column, blocks: tuple[int, ...], size: int) -> Column:
    """The chosen blocks of ``size`` bits, side by side."""
    one = lambda i: F.shiftrightunsigned(v, i * size).bitwiseAND(F.lit((1 << size) - 1))
    out = F.lit(0).cast("long")
    for at, i in enumerate(blocks):
        out = out.bitwiseOR(F.shiftleft(one(i), at * size))
    return out


def links(prints: DataFrame, fp: str = "fp", distance: int = 2, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints that differ in 1 to ``distance`` bits. ``prints[fp]`` holds no value twice."""
    if BITS % blocks or not 0 <= distance < blocks:
        raise ValueError(f"blocks must divide {BITS} and distance be in 0..{blocks - 1}")
    choices = [(c, tuple(i for i in range(blocks) if i not in c)) for c in combinations(range(blocks), blocks - distance)]
    x = F.col("__x")
    # ``rest`` holds the ``width`` bits in which a group's fingerprints may differ.
    now, width, out = prints.select(F.col(fp).alias("fp"), F.lit(0).cast("long").alias("group"), F.col(fp).alias("rest")), BITS, None
    while now is not None:
        size = width // blocks
        rest, more = F.col("rest"), distance * size
        keys = [F.struct(F.lit(k).alias("choice"), F.xxhash64("group", F.lit(k), _part(rest, same, size)).alias("in"), _part(rest, other, size).alias("left")) for k, (same, other) in enumerate(choices)]
        dealt = now.select("fp", "rest", F.explode(F.array(*keys)).alias("k")).select("fp", "rest", "k.choice", F.col("k.in").alias("group"), "k.left")
        sizes = dealt.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
        dealt = durable(dealt.join(sizes, "group"))
        last = more % blocks != 0 or more == 0
        few = dealt if last else dealt.where(F.col("n") <= crowd)
        a, b = (few.select("group", "choice", F.col("fp").alias(c), F.col("rest").alias(f"rest_{c}")) for c in "ab")
        close = a.join(b, ["group", "choice"]).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).withColumn("__x", F.col("rest_a").bitwiseXOR(F.col("rest_b")))
        first = F.coalesce(*[F.when(_part(x, same, size) == 0, k) for k, (same, _) in enumerate(choices)])
        close = close.where(first == F.col("choice")).select("a", "b")
        out = close if out is None else out.union(close)
        many = None if last else dealt.where(F.col("n") > crowd).select("fp", "group", F.col("left").alias("rest"))
        now, width = (None, 0) if many is None or many.isEmpty() else (many, more)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for each node of ``edges(a, b)`` the smallest node of its component."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        # u's smallest neighbour m, itself included; large: v > u hangs on m, small: v <= u hangs on m
        both = e.union(e.select("b", "a")).toDF("u", "v") if large else e.toDF("v", "u")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        j = both.join(least, "u")
        if large:
            out = j.where("v > u").select("m", "v")
        else:
            out = j.where("v <> m").select("m", "v").union(least.where("u <> m").select("m", "u"))
        return out.toDF("a", "b").distinct()

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        return (r[0], r[1])  # no sum: that could overflow

    e = durable(edges.distinct())
    was = mark(e)
    for _ in range(rounds):
        if not was[0]:
            break
        e = durable(star(star(e, True), False))
        if (now := mark(e)) == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select("a", "a").distinct().toDF("node", "root"))


def classes(prints: DataFrame, key: str, fp: str = "fp", distance: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """(key, fp, component): ``component`` is the smallest key of all documents reachable over links."""
    prints = durable(prints.select(F.col(key).alias("k"), F.col(fp).alias("fp")))
    groups = durable(prints.groupBy("fp").agg(F.min("k").alias("least")))
    roots = durable(components(links(groups, "fp", distance, blocks)))
    member = groups.join(roots, groups.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    of = member.join(least, "root").select("fp", "component")
    return prints.join(of, "fp", "left").select(F.col("k").alias(key), F.col("fp"), "component")


def near_duplicates(df: DataFrame, key: str, text: str, words: int = 5, distance: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """(key, fp, component) for each row of ``df``. Of ``blocks`` equal blocks, close fingerprints share all but ``distance``."""
    return classes(with_fingerprint(df, key, text, words), key, "fp", distance, blocks)
