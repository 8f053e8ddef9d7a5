"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets share the corpus's words by weight; none exceeds ``max_repeat`` times its source's words, and what that cuts
off is shared again by weight among the others. The targets are then filled with blocks of ``block`` words:
blocks go to sources one by one by the highest quotient target / (2 * given + 1), which a divisor search finds
without counting block by block, and each source's blocks go to its shards in the same way, in proportion to the
shards' words. A shard is a seeded hash class of a source's documents. Its documents, in seeded order, form one
stream that is cut into blocks; with n blocks and a quota of a * n + r, every block is taken a times and the r
that a seeded permutation of the block numbers puts first once more.

The driver holds a row for each source and at most ``max_shards`` shards; documents never leave the executors, and
the only shuffle carries ids and word counts. A shard has about ``shard_docs`` documents (more only if that bound
on the number of shards asks for it), so a hot source is dealt over many tasks.

Edge cases: null texts have size 0 and are taken 0 times; a null source is a source, after all others. Repeated
rows count each. If a source has no words, its target is 0. An empty table gives an empty result. No document is
taken more than ``max_repeat`` times its size.
"""

from __future__ import annotations

import heapq
import math
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlake.llm.common import arrow_column, durable, free_name, row_hash

SEED, MAX_REPEAT, SHARD_DOCS, MAX_SHARDS, MAX_BLOCK = 2024, 3, 512, 100_000, 256
SPACE = r"[^ \t-\r]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, total: float, max_repeat: float = MAX_REPEAT) -> dict:
    """Each source's target: ``total`` shared by weight, at most ``max_repeat`` times its size, the excess reshared."""
    out, open_, left = {}, set(sizes), float(total)
    while open_:
        share = left / w if (w := sum(weights[s] for s in open_)) else 0.0
        over = {s for s in open_ if weights[s] * share > max_repeat * sizes[s]}
        for s in over or open_:
            out[s] = float(max_repeat * sizes[s]) if over else weights[s] * share
        left -= sum(out[s] for s in over)
        open_ -= over or open_
    return out


def apportion(shares: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Sainte-Lague: ``seats`` to ``shares`` by the highest quotients, ties to the first; none gets over its ``most``."""
    top = lambda i, x: x if most is None else min(x, most[i])
    if most is not None:
        seats = min(seats, sum(m for m, s in zip(most, shares, strict=True) if s > 0))
    total = sum(shares)
    if total <= 0 or seats <= 0:
        return [0] * len(shares)
    given = lambda d: [top(i, math.floor(s / d + 0.5)) for i, s in enumerate(shares)]
    low, high = total / (seats + len(shares) + 1), total / max(1, seats) * 2 + max(shares) * 2
    while sum(given(low)) < seats:
        low /= 2
    for _ in range(60):  # a divisor that gives at most the seats
        mid = (low + high) / 2
        low, high = (low, mid) if sum(given(mid)) <= seats else (mid, high)
    out = given(high)
    heap = [(-s / (2 * out[i] + 1), i) for i, s in enumerate(shares) if s > 0 and top(i, out[i] + 1) > out[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if top(i, out[i] + 1) > out[i]:
            heapq.heappush(heap, (-shares[i] / (2 * out[i] + 1), i))
    return out


def turn(seed: int, source: int, shard: int, n: int) -> tuple[int, int]:
    """(stride, shift) of a shard's seeded permutation of its ``n`` block numbers: b becomes (b * stride + shift) modulo n."""
    rng = random.Random(f"{seed}-{source}-{shard}")
    stride = rng.randrange(1, n + 1)
    while math.gcd(stride, n) > 1:
        stride = rng.randrange(1, n + 1)
    return stride, rng.randrange(n)


def plan(docs: DataFrame, key: str, source: str, size: str, weights=None, budget: float = 1.0, block: int | None = None, max_repeat: int = MAX_REPEAT, shard_docs: int = SHARD_DOCS, max_shards: int = MAX_SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with source_size, target, shard, begin (of the document in its shard's stream), block, blocks, full, extra, stride and shift.

    ``weights`` gives a weight for each source in code-point order, nulls last; without it they are 1, 2, 3, 1, 2, 3, ...
    """
    spark = docs.sparkSession
    stats = docs.groupBy(source).agg(F.sum(size).alias("w"), F.count("*").alias("n")).collect()
    names = sorted((r[0] for r in stats if r[0] is not None), key=lambda s: s.encode()) + [None] * any(r[0] is None for r in stats)
    weight = {s: (weights or (lambda i, _: i % 3 + 1))(i, s) for i, s in enumerate(names)}
    words, n_docs = {r[0]: r.w for r in stats}, {r[0]: r.n for r in stats}
    total = sum(words.values())
    per_shard = max(shard_docs, math.ceil(sum(n_docs.values()) / max(1, max_shards - len(names))))
    block = block or max(1, min(MAX_BLOCK, total // (1000 * max(1, len(names)))))
    target = targets(words, weight, budget * total, max_repeat)
    s_type = docs.schema[source].dataType
    of_source = spark.createDataFrame([(s, words[s], target[s], math.ceil(n_docs[s] / per_shard)) for s in names], T.StructType([T.StructField("s", s_type), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("shards", T.IntegerType())]))
    held = docs.select("*", F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("order"))
    held = held.join(F.broadcast(of_source), F.col(source).eqNullSafe(F.col("s"))).withColumn("shard", F.pmod(F.xxhash64("order", F.lit(1)), F.col("shards")).cast("int")).drop("s", "shards")
    shards = held.groupBy(source, "shard").agg(F.sum(size).alias("w")).collect()
    by = {s: sorted((r for r in shards if r[0] == s), key=lambda r: r.shard) for s in names}
    n_blocks = {s: sum(-(-r.w // block) for r in by[s]) for s in names}
    seats = apportion([target[s] for s in names], round(sum(target.values()) / block), [max_repeat * n_blocks[s] for s in names])
    rows = []
    for i, (s, quota) in enumerate(zip(names, seats, strict=True)):
        n = [-(-r.w // block) for r in by[s]]
        for r, n_r, q in zip(by[s], n, apportion([float(r.w) for r in by[s]], quota, [max_repeat * x for x in n]), strict=True):
            rows.append((s, r.shard, n_r, q // max(1, n_r), q % max(1, n_r), *turn(seed, i, r.shard, max(1, n_r))))
    quotas = spark.createDataFrame(rows, T.StructType([T.StructField("s", s_type)] + [T.StructField(c, T.LongType()) for c in ("h", "blocks", "full", "extra", "stride", "shift")]))
    # The stream: a running sum of sizes in seeded order. Rows alike in key and size are alike in all that follows.
    stream = W.partitionBy(source, "shard").orderBy("order", F.col(key), F.col(size)).rowsBetween(W.unboundedPreceding, -1)
    held = held.withColumn("begin", F.coalesce(F.sum(size).over(stream), F.lit(0)))
    held = held.join(F.broadcast(quotas), F.col(source).eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h"))).drop("s", "h", "order")
    return held.withColumn("block", F.lit(int(block)).cast("long"))


def taken(size: Column) -> Column:
    """Words that the mix takes of a document, repeats counted, from the columns of ``plan``."""
    begin, block, end = F.col("begin"), F.col("block"), F.col("begin") + size
    first, last = F.floor(begin / block), F.floor((end - 1) / block)
    part = lambda b: F.least(end, (b + 1) * block) - F.greatest(begin, b * block)
    extra = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda acc, b: acc + F.when((b * F.col("stride") + F.col("shift")) % F.col("blocks") < F.col("extra"), part(b)).otherwise(0))
    return F.when(size > 0, F.col("full") * size + F.when(F.col("extra") > 0, extra).otherwise(0)).otherwise(0).cast("long")


def mixed_sizes(docs: DataFrame, key: str, source: str, text: str, **how) -> DataFrame:
    """(key, source, size, source_size, target, shard, begin, block, blocks, full, extra, stride, shift, taken) for each document."""
    sized = durable(docs.select(F.col(key), F.col(source), n_words(F.col(text)).alias("size")))
    return plan(sized, key, source, "size", **how).withColumn("taken", taken(F.col("size")))


def mix(docs: DataFrame, key: str, source: str, text: str, **how) -> DataFrame:
    """The mixed corpus, in the columns of ``docs``: a row for each pass over a document, with the words of the blocks
    that the pass takes, joined by spaces; a pass over a whole document keeps its text as it is."""
    parts = ("begin", "block", "blocks", "full", "extra", "stride", "shift")
    names = {c: free_name(docs, c) for c in ("size", "rid", "plan", "part", "pass")}
    n = {k: F.col(v) for k, v in names.items()}
    held = docs.withColumns({names["rid"]: row_hash(docs), names["size"]: n_words(F.col(text))})
    sized = durable(held.select(F.col(names["rid"]).alias("rid"), F.col(key).alias("k"), F.col(source).alias("src"), F.col(names["size"]).alias("size")))
    # One plan row for each content: rows alike in every column are taken alike, the first of them in the stream leads.
    of = plan(sized, "k", "src", "size", **how).groupBy("rid").agg(F.min_by(F.struct(*parts), "begin").alias("p"))
    got = held.join(of.select(F.col("rid").alias(names["rid"]), F.col("p").alias(names["plan"])), names["rid"]).where(n["size"] > 0)
    p = n["plan"]
    # Only texts of which the last pass takes a part go to Python; whole passes repeat the text where it is.
    some = F.when(p["extra"] > 0, F.col(text))
    got = arrow_column(got, names["part"], _cuts, "string", some, *[p[c].cast("long") for c in parts if c != "full"])
    last = F.when((p["extra"] > 0) & (n["part"] != ""), F.array(n["part"])).otherwise(F.array().cast("array<string>"))
    passes = F.explode(F.concat(F.array_repeat(F.col(text), p["full"].cast("int")), last))
    return got.withColumn(names["pass"], passes).select(*[(n["pass"] if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def _cuts(text: pa.Array, *how: pa.Array) -> pa.Array:
    """``cut`` of each text; texts are read one at a time, so no array of all words is held."""
    rows = zip((x.as_py() for x in text), *(x.to_pylist() for x in how), strict=True)
    return pa.array([None if t is None else cut(t, *h) for t, *h in rows], pa.string())


def cut(text: str, begin: int, block: int, blocks: int, extra: int, stride: int, shift: int) -> str:
    """The words of the blocks that the last pass takes, joined by spaces; the text as it is if it takes all of them."""
    words = text.encode().split()  # of bytes: at the six ASCII white-space bytes only
    chosen, n = [], len(words)
    for b in range(begin // block, (begin + n - 1) // block + 1):
        if (b * stride + shift) % blocks < extra:
            chosen += words[max(0, b * block - begin) : (b + 1) * block - begin]
    return text if len(chosen) == n else b" ".join(chosen).decode()
