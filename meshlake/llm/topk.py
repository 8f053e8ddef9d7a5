"""Exact top-k inner products, norm-sorted and pruned by Cauchy-Schwarz bounds.

Each task walks its vectors by descending length. For a query q with k-th best score t so far, no later vector v of
length |v| can enter once |q||v| < t; of the others, the first ``head`` coordinates after a rotation by the singular
vectors of a sample give a partial sum, and partial + |rest of q||rest of v| < t rules v out. Only survivors get the
whole inner product, in the given coordinates, so integer vectors score exactly. The ``seed_rows`` longest vectors
(a bounded top-n) give the rotation and each query's first t; both only steer the pruning, never the result.

Queries are dealt into blocks of at most ``block_rows``; each block, a bounded broadcast, meets all vectors in one
pass, and the tasks' lists of k merge by a window that each task has limited beforehand.

Edge cases: null vectors, vectors that hold null or non-finite components and null ids take no part. A query meets
every row but those of its own id. A vector of another length than the query's is no candidate. Repeated rows are
candidates each; a query id that repeats is asked once (the vector that is first by dimension and bytes). Ties go to the smaller id. Fewer than k candidates: all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshlake.llm.common import arrow_stage, bounded_batches, durable

SEED_ROWS, BLOCK_ROWS = 4096, 4096


def packed(df: DataFrame, key: str, vector: str, scale: float | None = None) -> DataFrame:
    """(id, dim, norm, v): the valid vectors as binary doubles; with ``scale`` each x becomes floor(scale * x)."""

    def run(b: pa.RecordBatch) -> dict:
        ids, norms, dims, out = [], [], [], []
        for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k is None or v is None or None in v:
                continue
            x = np.array(v, np.float64)
            if scale is not None:
                x = np.floor(scale * x)
            if np.isfinite(x).all():
                ids.append(k)
                dims.append(len(x))
                norms.append(math.sqrt(float(x @ x)))
                out.append(x.tobytes())
        return {"id": ids, "dim": dims, "norm": norms, "v": out}

    return arrow_stage(df.select(F.col(key).cast("long"), F.col(vector)), run, "id bigint, dim int, norm double, v binary")


def _matrix(rows: list, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(r.v) for r in rows), np.float64).reshape(len(rows), dim)


class Lists:
    """Each query's best k so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.best[q][0], scores]), np.concatenate([self.best[q][1], ids])
        top = np.lexsort((i, -s))[: self.k]
        self.best[q] = (s[top], i[top])
        if len(top) == self.k:
            self.floor[q] = max(self.floor[q], s[top[-1]])


def _walk(batches, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, turn: np.ndarray, k: int, head: int):
    """The lists of one task, from batches of (id, norm, v) by descending norm."""
    lists, dim = Lists(len(q), k, floor.copy()), q.shape[1]
    q_norm, q_turned = np.sqrt((q * q).sum(axis=1)), q @ turn
    q_head, q_rest = q_turned[:, :head], np.sqrt((q_turned[:, head:] ** 2).sum(axis=1))
    for ids, norms, v in batches:
        slack = 1e-9 * (1 + q_norm * norms[0])
        alive = np.flatnonzero(q_norm * norms[0] + slack >= lists.floor)
        if not len(alive):
            return lists  # the rest is shorter still
        turned = v @ turn
        rest = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
        for a in range(0, len(alive), 512):
            qs = alive[a : a + 512]
            bound = q_head[qs] @ turned[:, :head].T + np.outer(q_rest[qs], rest) + slack[qs, None]
            rows, cols = np.nonzero(bound >= lists.floor[qs][:, None])
            if not len(rows):
                continue
            cuts = np.flatnonzero(np.diff(rows)) + 1
            for g in np.split(np.arange(len(rows)), cuts):
                i, c = qs[rows[g[0]]], cols[g]
                c = c[ids[c] != q_ids[i]]
                if len(c):
                    s = v[c] @ q[i]
                    keep = s >= lists.floor[i]
                    lists.add(i, s[keep], ids[c][keep])
    return lists


def _block(vectors: DataFrame, queries: list, dim: int, k: int, head: int, seeds: list) -> DataFrame:
    """(query_id, vec_id, score): each task's lists for one block of queries."""
    q, q_ids = _matrix(queries, dim), np.array([r.id for r in queries], np.int64)
    floor, turn = np.full(len(q), -np.inf), np.eye(dim)
    if seeds:
        s, s_ids = _matrix(seeds, dim), np.array([r.id for r in seeds], np.int64)
        turn = np.linalg.svd(s.T @ s)[0]
        for a in range(0, len(q), 512):
            scores = np.where(q_ids[a : a + 512, None] == s_ids[None, :], -np.inf, q[a : a + 512] @ s.T)
            if scores.shape[1] >= k:
                floor[a : a + 512] = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        floor -= 1e-9 * np.abs(floor, where=np.isfinite(floor), out=np.zeros(len(floor)))
    shared = vectors.sparkSession.sparkContext.broadcast((q, q_ids, floor, turn))

    def run(batches):
        def numbers():
            for b in batches:
                if b.num_rows:
                    v = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float64).reshape(b.num_rows, dim)
                    yield b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), v

        lists = _walk(numbers(), *shared.value, k, head)
        for a in range(0, len(lists.best), 512):
            part = lists.best[a : a + 512]
            n = [len(x[0]) for x in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(shared.value[1][a : a + 512], n)), pa.array(np.concatenate([x[1] for x in part])), pa.array(np.concatenate([x[0] for x in part]))],
                names=["query_id", "vec_id", "score"],
            )

    walk = vectors.where(F.col("dim") == dim).select("id", "norm", "v").sortWithinPartitions(F.desc("norm"))
    return bounded_batches(walk).mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def top_k(df: DataFrame, key: str, vector: str, asked: Column, k: int, scale: float | None = None, head: int | None = None, block_rows: int = BLOCK_ROWS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``asked`` (of column ``id``) holds, its k largest inner products."""
    if k < 1:
        raise ValueError("k must be positive")
    vectors = durable(packed(df, key, vector, scale))
    queries = vectors.where(asked).groupBy("id").agg(F.min_by(F.struct("dim", "v"), F.struct("dim", "v")).alias("q")).select("id", "q.dim", "q.v")
    out = None
    for dim, n in sorted((r[0], r[1]) for r in queries.groupBy("dim").count().collect()):
        own, blocks = queries.where(F.col("dim") == dim), math.ceil(n / (block_rows * 0.9))
        seeds = vectors.where(F.col("dim") == dim).orderBy(F.desc("norm"), "id").limit(seed_rows).select("id", "v").collect()
        for b in range(blocks):
            block = own.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)) == b).orderBy("id").select("id", "v").collect()
            if block:
                got = _block(vectors, block, dim, k, head or max(1, dim // 4), seeds)
                out = got if out is None else out.unionByName(got)
    if out is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
