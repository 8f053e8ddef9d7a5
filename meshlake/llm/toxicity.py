"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct lower-cased words and their beginnings of four and five letters, which stand for
inflected forms, hashed to ``2**bits`` columns. The score is the logistic of a
bias, a weight for each term and, for each pair of terms, the inner product of their factors: a word that insults
only next to the mention of a group is learnt as such a pair, which no sum of single weights can express.

The machine is fitted on the driver by AdaGrad with proximal L1 (weights) and L2 (factors) on at most ``per_class``
labelled rows of each class, those with the smallest seeded hash of their id; terms in fewer than ``min_rows`` of
them are left out, and of the rest the ``max_terms`` with the largest chi-square stay. The bias is then shifted from the
sample's log-odds of the classes to those of all training labels, so the cap doesn't move the scores. The model is therefore bounded whatever the corpus; scoring is one Arrow stage without a shuffle.

Edge cases: null and empty texts have no terms and score the bias. Repeated label rows of an id count once, the
larger label wins, and null labels are left out. With labels of one class or none, every score is that class's
share (0 without labels). Repeated documents each get their row; of differing texts of one id, training takes the
one with the smaller term list. An empty table gives an empty result. A column called like the score is kept as ``score_input``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import arrow_column, arrow_stage, free_name, release, set_aside

WORD = re.compile(r"[^\W_]+")
PER_CLASS, BITS, RANK, EPOCHS, SEED, CACHE = 4000, 18, 6, 12, 11, 200_000
STEMS = (4, 5)
THRESHOLD = 0.3


def held_out(key: str) -> Column:
    """Rows never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


class Terms:
    """Distinct hashed terms of a text; words seen before are looked up in a bounded cache."""

    def __init__(self, bits: int, columns: np.ndarray | None = None):
        self.bits, self.cache = bits, {}
        self.of = None if columns is None else {int(c): i for i, c in enumerate(columns)}

    def __call__(self, text: str | None) -> np.ndarray:
        cache, out = self.cache, []
        if len(cache) > CACHE:
            cache.clear()
        for w in set(WORD.findall((text or "").lower())):
            found = cache.get(w)
            if found is None:
                found = cache[w] = self._columns(w)
            if found:
                out += found
        return np.unique(np.array(out, np.int32))

    def _columns(self, word: str) -> tuple[int, ...]:
        forms = [word, *(f"^{word[:n]}" for n in STEMS if len(word) >= n)]
        got = [xxhash.xxh64_intdigest(x, SEED) & (1 << self.bits) - 1 for x in forms]
        return tuple(got if self.of is None else (self.of[i] for i in got if i in self.of))


@dataclass
class Machine:
    bits: int
    columns: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of rows whose terms are ``flat[starts[i]:starts[i + 1]]``."""
        n = len(starts) - 1
        row = np.repeat(np.arange(n), np.diff(starts))
        out = self.bias + np.bincount(row, self.weights[flat], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[flat, f]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out

    def scores(self, texts: list[str | None], terms: Terms) -> np.ndarray:
        got = [terms(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
        m = self.margins(np.concatenate([*got, np.zeros(0, np.int32)]).astype(np.int64), starts)
        return 1 / (1 + np.exp(-np.clip(m, -40, 40)))


def fit(rows: list[np.ndarray], labels: list[int], bits: int = BITS, rank: int = RANK, epochs: int = EPOCHS, min_rows: int = 5, max_terms: int = 512, rate: float = 0.1, l1: float = 2e-5, l2: float = 1e-4) -> Machine:
    """A machine fitted to rows of hashed terms and their labels."""
    y = np.array(labels, np.float64)
    none = Machine(bits, np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, rank)))
    if not len(y) or y.min() == y.max():
        none.bias = 40.0 if len(y) and y[0] else -40.0
        return none
    n_rows, hits = np.zeros(1 << bits, np.int64), np.zeros(1 << bits)
    for a in range(0, len(rows), 256):  # in parts: the driver never holds all terms twice
        part = rows[a : a + 256]
        flat = np.concatenate(part)
        n_rows += np.bincount(flat, minlength=1 << bits)
        hits += np.bincount(flat, np.repeat(y[a : a + 256], [len(r) for r in part]), 1 << bits)
    columns = np.flatnonzero(n_rows)
    n_rows, hits = n_rows[columns], hits[columns]
    n, n1 = len(y), y.sum()
    spread = np.maximum(n1 * (n - n1) * n_rows * (n - n_rows), 1)
    chi = n * (hits * (n - n1) - (n_rows - hits) * n1) ** 2 / spread
    chi[n_rows < min(min_rows, 1 + n // 50)] = -1
    best = np.lexsort((columns, -chi))[:max_terms]
    columns = np.sort(columns[best[chi[best] >= 0]])
    at = np.full(1 << bits, -1, np.int64)
    at[columns] = np.arange(len(columns))
    rows = [(i := at[r])[i >= 0] for r in rows]
    rng = np.random.default_rng(SEED)
    m = Machine(bits, columns, float(np.log(y.mean() / (1 - y.mean()))), np.zeros(len(columns)), rng.normal(0, 0.01, (len(columns), rank)))
    gw, gv, gb = np.full(len(columns), 1e-3), np.full((len(columns), rank), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 32):
            pick = order[a : a + 32]
            part = [rows[i] for i in pick]
            size = np.array([len(x) for x in part])
            flat = np.concatenate(part)
            starts = np.concatenate([[0], np.cumsum(size)])
            row = np.repeat(np.arange(len(pick)), size)
            err = 1 / (1 + np.exp(-np.clip(m.margins(flat, starts), -40, 40))) - y[pick]
            used, where = np.unique(flat, return_inverse=True)
            gb += err.mean() ** 2
            m.bias -= rate * err.mean() / np.sqrt(gb)
            g = np.bincount(where, err[row], len(used)) / len(pick)
            gw[used] += g * g
            step = rate / np.sqrt(gw[used])
            w = m.weights[used] - step * g
            m.weights[used] = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            for f in range(rank):
                v = m.factors[flat, f]
                total = np.bincount(row, v, len(pick))
                g = np.bincount(where, err[row] * (total[row] - v), len(used)) / len(pick) + l2 * m.factors[used, f]
                gv[used, f] += g * g
                m.factors[used, f] -= 0.3 * rate * g / np.sqrt(gv[used, f])
    return m


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int = PER_CLASS, bits: int = BITS, **how) -> Machine:
    """Fit on labelled rows that aren't held out; see the module for the bound."""
    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("y IS NOT NULL AND k IS NOT NULL")
    known = known.where(~held_out("k")).groupBy("k").agg(F.max("y").alias("y"))
    count = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = [r for c in (0, 1) for r in known.where(F.col("y") == c).orderBy(F.xxhash64("k", F.lit(SEED)), "k").limit(per_class).collect()]
    sample = spark.createDataFrame([(r.k, r.y) for r in picked], known.schema)
    terms = Terms(bits)
    kind = known.schema["k"].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k").select("k", "y", "t")
    found = arrow_stage(rows, lambda b: {"k": b.column(0), "y": b.column(1), "terms": [terms(t).astype("<i4").tobytes() for t in b.column(2).to_pylist()]}, f"k {kind}, y int, terms binary")
    got = found.groupBy("k").agg(F.min("y").alias("y"), F.min("terms").alias("terms")).toArrow().sort_by("k")
    y = got.column("y").to_pylist()
    machine = fit([np.frombuffer(x.as_buffer(), "<i4") for x in got.column("terms")], y, bits, **how)
    del got
    release()
    if len(set(y)) == 2:
        taken = [min(count[c], per_class) for c in (0, 1)]
        machine.bias += float(np.log(count[1] / taken[1]) - np.log(count[0] / taken[0]))
    return machine


def score(docs: DataFrame, text: str, machine: Machine, out: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1; a column that is called like it is kept as ``score_input``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    state: dict = {}

    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        if "terms" not in state:
            state["terms"] = Terms(m.bits, m.columns)
        return pa.array(m.scores(texts.to_pylist(), state["terms"]), pa.float64())

    name = free_name(docs, out)
    return set_aside(arrow_column(docs, name, run, "double", F.col(text)), out).withColumnRenamed(name, out)
