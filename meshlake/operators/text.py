"""Text retrieval: BM25 over character bigrams and keyword anchors.

A query is a literal, so BM25 needs no index: one pass counts each of its grams within a document, and the corpus's
statistics are one row. ``postings`` gives the index form for those who keep one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def grams(text: Column) -> Column:
    """Lower-cased pairs of neighbouring characters; a text of one character is its own gram."""
    chars = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), lambda c: c != "")
    n = F.size(chars)
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(chars, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.when(n < 2, chars).otherwise(pairs)


def query_grams(text: str) -> list[str]:
    t = text.lower()
    return [t] if len(t) == 1 else list(dict.fromkeys(t[i : i + 2] for i in range(len(t) - 1)))


def postings(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(term, key, tf, dl)."""
    g = docs.select(key, grams(F.col(text)).alias("g")).select(key, F.size("g").alias("dl"), F.explode("g").alias("term"))
    return g.groupBy("term", key, "dl").agg(F.count("*").alias("tf")).select("term", key, "tf", "dl")


def bm25(docs: DataFrame, query: str, key: str = "id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of the documents that share a gram with the query; empty texts aren't part of the corpus."""
    terms = query_grams(query)
    none = docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    if not terms:
        return none
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    # A gram's occurrences overlap, so its second character is looked ahead for. Native counting, without an array of grams.
    count = lambda g: F.regexp_count("t", F.lit(f"(?s)\\Q{g[0]}\\E(?=\\Q{g[1]}\\E)")) if len(g) == 2 else (F.col("t") == g).cast("int")
    g = docs.select(F.col(key), low.alias("t")).where("t <> ''")
    tf = g.select(key, F.greatest(F.length("t") - 1, F.lit(1)).alias("dl"), F.array(*map(count, terms)).alias("tf"))
    stats = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))])
    row = stats.select("n", "avg", F.array(*[F.col(f"df{i}") for i in range(len(terms))]).alias("df"))
    idf = F.transform("df", lambda d: F.log((F.col("n") - d + 0.5) / (d + 0.5) + 1))
    row = row.select("avg", idf.alias("idf"))
    dl = F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avg")
    part = F.zip_with("tf", "idf", lambda t, w: w * t * (k1 + 1) / (t + k1 * dl))
    hit = tf.where(F.exists("tf", lambda t: t > 0))
    # The statistics are one row.
    return hit.join(F.broadcast(row)).select(key, F.aggregate(part, F.lit(0.0), lambda a, x: a + x).alias("score"))


def keyword_hits(keywords: DataFrame, query: str, key: str = "id", keyword: str = "keyword") -> DataFrame:
    """(key, score): how often the query holds keywords of a node, longest first from the left, without overlap.

    Only the keywords that the query contains reach the driver, fewer than the query has substrings.
    """
    q = query.lower()
    lower = F.lower(F.col(keyword))
    inside = keywords.where((lower != "") & F.contains(F.lit(q), lower))
    found = sorted((r[0] for r in inside.select(lower).distinct().collect()), key=lambda k: (-len(k), k))
    counts: dict[str, int] = {}
    if found:
        for m in re.finditer("|".join(map(re.escape, found)), q):
            counts[m[0]] = counts.get(m[0], 0) + 1
    times = F.lit(0)
    for k, n in counts.items():
        times = F.when(lower == k, n).otherwise(times)
    return inside.select(key, times.alias("n")).where("n > 0").groupBy(key).agg(F.sum("n").cast("double").alias("score"))
