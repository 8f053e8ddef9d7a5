"""Near duplicates by the exact Jaccard similarity of word shingles: SimHash classes first, MinHash bands for what they can't reach.

A text's set is the distinct XXH64 hashes of its word shingles. Texts with equal sets are one node from there on, copies however
many. Nodes whose fingerprints the SimHash operator puts in one class are compared with the class's first node. That reaches pairs of
about 0.95 or more; pairs down to 0.8 differ in some ten bits of 64, for which no blocks of a fingerprint are both shared and
selective. A node is therefore dealt out as well to ``BANDS`` buckets, each keyed by ``ROWS`` minima of the set; two sets with a similarity s meet in
some bucket with a probability of 1 - (1 - s ** ROWS) ** BANDS, which is over 0.9999 at 0.8. Every pair that meets is settled:
first each node with the hub of its bucket, the one that meets most others, so that a large group of near copies needs few
comparisons. The nodes of the buckets that these links left in different components go into a prefix join:
two sets can only be similar enough if they share one of their rarest hashes, and its rank bounds what they can have in
common. That finds every such pair and leaves out nearly all that share but frequent hashes, however full their bucket is.
A pair is a link if its exact similarity is ``share`` or more.

Edge cases: null and empty texts have the empty set and are one node without links. Repeated rows each get their row. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import arrow_stage, durable, settle
from meshlake.llm.simhash import classes, components, hashes, majority

BANDS, ROWS, SEED = 20, 4, 42
_RNG = np.random.default_rng(SEED)
_TIMES, _PLUS, _MIX = (_RNG.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))


def shingle_set(text: str | bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(hashes(text, words))


def bands(found: np.ndarray) -> list[int]:
    """A key for each band, as signed 64-bit integers; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for a in range(0, len(found), 4096):
        np.minimum(least, (found[None, a : a + 4096] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    return (least * _MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def _marks(b: pa.RecordBatch, words: int) -> dict:
    all_ = [hashes(t, words) for t in b.column(1).cast(pa.binary()).to_pylist()]
    sets = [np.unique(h) for h in all_]
    node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
    return {"k": b.column(0), "node": node, "n": [len(s) for s in sets], "bands": [bands(s) for s in sets], "fp": [majority(h) for h in all_]}


def similar(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Of ``pairs(a, b)`` those whose ``sets(node, found)`` have a Jaccard similarity of ``share`` or more."""
    a, b = (sets.select(F.col("node").alias(x), F.col("found").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(a, "a").join(b, "b").where(both >= share * (F.size("of_a") + F.size("of_b") - both) - 1e-9).select("a", "b")


def apart(dealt: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, n, root): ``dealt(bucket, node, n)`` of those buckets whose nodes have different roots."""
    now = dealt.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    of = now.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return now.join(of.select("bucket"), "bucket")


def candidates(nodes: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """(a, b), a < b: of ``nodes(node, n, root)`` all pairs of different roots whose similarity may be ``share`` or more.

    Each set's hashes are ranked by how many of the sets hold them, the rarest first. If the first that two sets have in common
    has the ranks p and q, they share at most n_a - p and n_b - q of them, and need ``share / (1 + share)`` of n_a + n_b.
    """
    hashes_ = nodes.join(sets, "node").select("node", "n", "root", F.explode("found").alias("h"))
    held = hashes_.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")  # those of a single set rank first and match nothing
    ranked = hashes_.join(held, "h").groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("c", "h"))).alias("all"))
    # ``most``: so many hashes at most are shared with a set of which this is the first common one.
    prefix = ranked.select("node", "n", "root", F.size("all").alias("size"), F.posexplode("all").alias("rank", "of")).select("node", "n", "root", (F.col("size") - F.col("rank")).alias("most"), F.col("of.h").alias("h"))
    prefix = durable(prefix.where(F.col("most") >= share * F.col("n") - 1e-9))
    mixed = prefix.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    prefix = prefix.join(mixed, "h")
    a, b = (prefix.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "root", "most")]) for x in "ab")
    enough = f"least(most_a, most_b) >= {share / (1 + share)} * (n_a + n_b) - 1e-9"
    return a.join(b, "h").where(f"node_a < node_b AND root_a <> root_b AND {enough}").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_duplicates(df: DataFrame, key: str, text: str, words: int = 5, share: float = 0.8) -> DataFrame:
    """(key, component) for each row of ``df``: the smallest key of all documents reachable over links."""
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = docs.schema["k"].dataType.simpleString()
    rows = durable(arrow_stage(docs, lambda b: _marks(b, words), f"k {kind}, node bigint, n int, bands array<bigint>, fp bigint"))
    nodes = durable(rows.groupBy("node").agg(F.min("k").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp")))
    near = durable(classes(nodes, "node", "fp").where("component <> node").select(F.col("component").alias("a"), F.col("node").alias("b")))
    dealt = nodes.select("node", "n", F.posexplode("bands").alias("band", "bits")).select("node", "n", F.xxhash64("band", "bits").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("met")).where("met > 1")
    dealt = durable(dealt.join(shared, "bucket"))
    # Sets of those alone that are compared, from the text of one document each.
    asked = near.select("a").union(near.select("b")).union(dealt.select("node")).distinct().toDF("node")
    wanted = asked.join(nodes, "node").select("node", F.col("least").alias("k"))
    picked = docs.join(wanted, "k").select("node", "t")
    found = arrow_stage(picked, lambda b: {"node": b.column(0), "found": [shingle_set(t, words).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]}, "node bigint, found array<bigint>")
    sets = durable(found.groupBy("node").agg(F.first("found").alias("found")))

    def fits(x: str, y: str) -> str:
        return f"least({x}, {y}) >= {share} * greatest({x}, {y}) - 1e-9"

    settle(df.sparkSession)
    in_all = dealt.groupBy("node").agg(F.sum("met").alias("in_all"))
    hubs = dealt.join(in_all, "node").groupBy("bucket").agg(F.max_by("node", F.struct("in_all", "node")).alias("hub"))
    spokes = dealt.join(hubs, "bucket").where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    size = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"))
    stars = spokes.union(near).distinct().join(size.toDF("b", "n"), "b")
    links = durable(similar(stars.join(size, "a").where(fits("n_a", "n")).select("a", "b"), sets, share))
    roots = durable(components(links))
    settle(df.sparkSession)
    rest = durable(apart(dealt, roots).select("node", "n", "root").distinct())
    roots = durable(components(links.union(similar(candidates(rest, sets, share), sets, share))))
    member = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    of = member.join(least, "root").select("node", "component")
    return rows.join(of, "node", "left").select(F.col("k").alias(key), "component")
