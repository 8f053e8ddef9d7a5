"""Vector search and the hybrid pipeline: text and vector anchors, residual query, diffusion, diversity, top k.

Anchors are lazy plans that end in top-k operators, so no more than a bounded number of rows (``max(top_k, 15)``
seeds, ``3 * top_k`` for diversity) reaches the driver for the numeric steps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshlake.errors import DimensionMismatch, StoreError
from meshlake.functions import numeric
from meshlake.functions import vectors as V
from meshlake.operators import graph, text


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 5
    expand_depth: int = 2
    min_score: float = 0.1
    teleport_alpha: float = 0.0
    enable_advanced_pipeline: bool = False
    enable_sparse_residual: bool = False
    fista_lambda: float = 0.1
    fista_threshold: float = 0.30
    enable_dpp: bool = False
    dpp_quality_weight: float = 1.0
    enable_inverse_inhibition: bool = False
    lateral_inhibition_threshold: int = 0
    enable_bq_coarse_search: bool = False
    bq_candidate_ratio: float = 0.1
    text_boost: float = 1.5
    enable_text_hybrid_search: bool = False
    bm25_k1: float = 1.2
    bm25_b: float = 0.75

    def clamped(self) -> SearchConfig:
        within = lambda x, a, b: min(max(x, a), b)
        return replace(
            self, top_k=max(self.top_k, 1), fista_lambda=within(self.fista_lambda, 1e-5, 100.0), teleport_alpha=within(self.teleport_alpha, 0.0, 1.0),
            dpp_quality_weight=within(self.dpp_quality_weight, 0.0, 10.0), fista_threshold=max(self.fista_threshold, 0.0), bq_candidate_ratio=within(self.bq_candidate_ratio, 0.0, 1.0),
        )


def check_query(query: Sequence[float], dim: int | None = None) -> None:
    if dim is not None and len(query) != dim:
        raise DimensionMismatch(dim, len(query))
    if not all(math.isfinite(x) for x in query):
        raise StoreError("a query vector holds NaN or infinity")


def top(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("score"), F.asc("id")).limit(k)


def scored(nodes: DataFrame, query: Sequence[float], min_score: float | None, dtype: str = "f32") -> DataFrame:
    similarity, literal = V.SIMILARITY[dtype]
    got = nodes.select("id", similarity(F.col("vector"), literal(query)).alias("score"))
    return got if min_score is None else got.where(F.col("score") >= min_score)


def knn(nodes: DataFrame, query: Sequence[float], k: int, min_score: float | None = None, dtype: str = "f32") -> DataFrame:
    """(id, score) of the most similar nodes, ties to smaller ids."""
    check_query(query)
    return top(scored(nodes, query, min_score, dtype), k)


def knn_two_stage(nodes: DataFrame, query: Sequence[float], k: int, ratio: float, min_score: float | None = None) -> DataFrame:
    """As ``knn``, of the ``ratio`` of nodes (``k`` at least) whose signatures are nearest, all at the last distance included.

    The distance that admits so many comes from a histogram of at most 513 rows, so no stage sorts the candidates.
    """
    check_query(query)
    signed = F.array(*[F.lit(w) for w in signature_of(query)])
    far = nodes.withColumn("far", V.hamming(V.signature(F.col("vector")), signed))
    steps = sorted(far.groupBy("far").count().collect())
    need, cut, have = max(math.ceil(sum(r["count"] for r in steps) * ratio), k), -1, 0
    for r in steps:
        if have >= need:
            break
        cut, have = r.far, have + r["count"]
    return knn(far.where(F.col("far") <= cut), query, k, min_score)


def signature_of(query: Sequence[float]) -> list[int]:
    words = [sum(1 << j for j, x in enumerate(query[64 * w : 64 * w + 64]) if x > 0) for w in range(V.SIGNATURE_WORDS)]
    return [w - (1 << 64) if w >> 63 else w for w in words]


def knn_batch(queries: DataFrame, nodes: DataFrame, k: int, block_rows: int = 2048) -> DataFrame:
    """(query_id, id, score): the ``k`` best nodes of each row of ``queries(query_id, query)``, a stated query set, by cosine.

    Queries are dealt into blocks of about ``block_rows``, each a bounded broadcast. A block meets all nodes in one pass of matrix
    products; a task keeps its own ``k`` best of a query, which alone are shuffled. Null vectors and those of another length than a
    query's take no part; a vector of length zero scores 0. Ties go to the smaller id.
    """
    spark, out = nodes.sparkSession, None
    sizes = queries.where("query IS NOT NULL").groupBy(F.size("query").alias("dim")).count().collect()
    for dim, n in sorted((r[0], r[1]) for r in sizes):
        blocks, own = math.ceil(n / block_rows), queries.where(F.size("query") == dim)
        for b in range(blocks):
            got = own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
            if got:
                shared = spark.sparkContext.broadcast(([r.query_id for r in got], _directions(np.array([r.query for r in got], np.float64))))
                kept = nodes.where(F.size("vector") == dim).select("id", "vector").mapInArrow(_best_of_block(shared, dim, k), "query_id long, id long, score double")
                out = kept if out is None else out.unionByName(kept)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _directions(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, or 0 where they were so."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _best_of_block(shared, dim: int, k: int):
    def run(batches):
        names, asked = shared.value
        ids, scores = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                at = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                found = asked @ _directions(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)).T
                ids = np.concatenate([ids, np.broadcast_to(at, found.shape)], axis=1)
                scores = np.concatenate([scores, found], axis=1)
                best = np.lexsort((ids, -scores), axis=1)[:, :k]
                ids, scores = np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1)
        of = np.repeat(np.array(names, np.int64), ids.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(ids.ravel()), pa.array(scores.ravel())], names=["query_id", "id", "score"])

    return run


def search(nodes: DataFrame, edges: DataFrame, query: Sequence[float] | None, config: SearchConfig, query_text: str | None = None, texts: DataFrame | None = None, keywords: DataFrame | None = None, dtype: str = "f32") -> DataFrame:
    """(id, score), at most ``top_k`` rows. ``texts``: id, text; ``keywords``: id, keyword."""
    c = config.clamped()
    sources = []
    if c.enable_text_hybrid_search and query_text is not None:
        if keywords is not None:
            sources.append(text.keyword_hits(keywords, query_text).select("id", (F.col("score") * c.text_boost).alias("score")))
        if texts is not None:
            share = F.least(F.greatest(F.col("score") / 10, F.lit(0.0)), F.lit(1.0))
            sources.append(text.bm25(texts, query_text, k1=c.bm25_k1, b=c.bm25_b).select("id", (share * c.text_boost).alias("score")))
    if query is not None:
        check_query(query)
        if c.enable_bq_coarse_search and dtype != "u64":
            sources.append(knn_two_stage(nodes, query, c.top_k, c.bq_candidate_ratio, c.min_score))
        else:
            sources.append(knn(nodes, query, c.top_k, c.min_score, dtype))
    if not sources:
        return nodes.select("id", F.lit(0.0).alias("score")).where(F.lit(False))

    def fuse(parts: list[DataFrame]) -> DataFrame:
        both = parts[0]
        for p in parts[1:]:
            both = both.union(p)
        return both.groupBy("id").agg(F.sum("score").alias("score"))

    seeds = fuse(sources)
    if c.enable_advanced_pipeline and c.enable_sparse_residual and query is not None:
        # The residual is taken over the seeds that can still be anchors, a bounded number.
        rows = vectors_of(top(seeds, max(c.top_k, 15)), nodes)
        _, rest, size = (None, None, 0.0) if not rows else numeric.fista(np.array([r.vector for r in rows], float).reshape(len(rows), -1), np.array(query, float), c.fista_lambda)
        if rows and size > c.fista_threshold:
            if dtype == "u64":
                rest = [min(max(int(x), 0), (1 << 64) - 1) for x in rest]
            shadow = knn(nodes, list(rest), c.top_k, c.min_score, dtype)
            seeds = fuse([*sources, shadow.select("id", (F.col("score") * 0.8).alias("score"))])
    live = nodes.select("id")
    seeds = top(seeds.where(F.col("score") >= c.min_score).join(live, "id", "left_semi"), max(c.top_k, 15))
    if c.expand_depth > 0:
        got = graph.diffuse(seeds, edges, c.expand_depth, c.teleport_alpha, c.enable_inverse_inhibition, c.lateral_inhibition_threshold).join(live, "id", "left_semi")
    else:
        got = seeds
    if c.enable_advanced_pipeline and c.enable_dpp:
        rows = sorted(vectors_of(top(got, 3 * c.top_k), nodes), key=lambda r: (-r.score, r.id))
        if len(rows) > c.top_k:
            pick = numeric.dpp_greedy(np.array([r.vector for r in rows], float), np.array([r.score for r in rows]), c.top_k, c.dpp_quality_weight)
            got = nodes.sparkSession.createDataFrame([(rows[i].id, rows[i].score) for i in pick], "id long, score double")
    return top(got, c.top_k)


def vectors_of(few: DataFrame, nodes: DataFrame) -> list:
    """Rows (id, score, vector) of a bounded number of ids."""
    return few.join(nodes.select("id", "vector"), "id").collect()


