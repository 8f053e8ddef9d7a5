"""Queries over the driver's tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.functions import numeric
from meshlake.functions import vectors as V
from meshlake.operators import graph, paths, predicates, search, text
from meshlake.plans import replay
from meshlake.session import table
from meshlake.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The query vector, one row."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()
    return list(row.embedding) if row else [0.0]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"))


# Vector search

Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
COSINE = f"SELECT vec_id + 1 AS id, list_cosine_similarity(embedding::DOUBLE[], {Q}) AS score FROM embeddings"
add("knn_cosine", lambda s, d: _rounded(search.knn(T.vector_nodes(s, d), _vector(s, d), 10)), f"SELECT id, round(score, 6) AS score FROM ({COSINE}) ORDER BY score DESC, id LIMIT 10")
add("knn_min_score", lambda s, d: _rounded(search.knn(T.vector_nodes(s, d), _vector(s, d), 20, 0.2)), f"SELECT id, round(score, 6) AS score FROM ({COSINE}) WHERE score >= 0.2 ORDER BY score DESC, id LIMIT 20")


def _batch(s: SparkSession, d: str) -> DataFrame:
    nodes = T.vector_nodes(s, d)
    got = search.knn_batch(nodes.where("label = 3").select(F.col("id").alias("query_id"), F.col("vector").alias("query")), nodes, 5)
    return got.select("query_id", "id", F.round("score", 6).alias("score"))


add("knn_batch_topk", _batch, """
WITH s AS (SELECT q.vec_id + 1 AS query_id, e.vec_id + 1 AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.label = 3)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 5""")  # fmt: skip

HAM = "list_sum(list_transform(list_zip(embedding, q), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END))"
HAM_FROM = "FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
add("bq_hamming", lambda s, d: T.vector_nodes(s, d).select("id", V.hamming(V.signature(F.col("vector")), F.array(*map(F.lit, search.signature_of(_vector(s, d))))).cast("long").alias("distance")),
    f"SELECT vec_id + 1 AS id, CAST({HAM} AS BIGINT) AS distance {HAM_FROM}")
add("bq_two_stage", lambda s, d: _rounded(search.knn_two_stage(T.vector_nodes(s, d), _vector(s, d), 10, 0.1)), f"""
WITH h AS (SELECT vec_id + 1 AS id, {HAM} AS far, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS score {HAM_FROM}),
r AS (SELECT *, rank() OVER (ORDER BY far) AS n FROM h) SELECT id, round(score, 6) AS score FROM r WHERE n <= (SELECT greatest(ceil(count(*) * 0.1), 10) FROM h) ORDER BY score DESC, id LIMIT 10""")  # fmt: skip
add("bitmatch_u64", lambda s, d: T.vector_nodes(s, d).select("id", V.matching_bits(F.slice(V.signature(F.col("vector")), 1, 1), F.array(F.lit(search.signature_of(_vector(s, d))[0]))).alias("score")),
    f"SELECT vec_id + 1 AS id, CAST(64 - {HAM} AS DOUBLE) AS score {HAM_FROM}")


def _math(s: SparkSession, d: str) -> DataFrame:
    v, q = F.col("vector"), V.literal(_vector(s, d))
    r = lambda c: F.round(c, 6)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return T.vector_nodes(s, d).select(
        "id", r(V.dot(v, q)).alias("dot"), r(V.l2_norm(v)).alias("norm"), r(total(V.add(v, q))).alias("added"), r(total(V.sub(v, q))).alias("subtracted"),
        r(total(V.scale(v, F.lit(2.5)))).alias("scaled"), r(total(V.soft_threshold(v, 0.1))).alias("softened"), r(V.mat_vec(F.array(v, q), q)[0]).alias("product"),
    )


add("vector_math", _math, f"""
WITH e AS (SELECT vec_id + 1 AS id, embedding::DOUBLE[] AS v, {Q} AS q FROM embeddings)
SELECT id, round(list_dot_product(v, q), 6) AS dot, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_sum(v) + list_sum(q), 6) AS added, round(list_sum(v) - list_sum(q), 6) AS subtracted,
round(list_sum(v) * 2.5, 6) AS scaled, round(list_sum(list_transform(v, lambda x: sign(x) * greatest(abs(x) - 0.1, 0))), 6) AS softened, round(list_dot_product(v, q), 6) AS product FROM e""")  # fmt: skip

# Predicates over payloads

FILTERS = {
    "eq": ({"type": "click"}, "event_type = 'click'"),
    "eq_int": ({"k": {"$eq": 7}}, "k = 7"),
    "eq_null": ({"opt": None}, "event_id % 9 = 0"),
    "ne": ({"opt": {"$ne": 7}}, "NOT (event_id % 3 = 0 AND event_id % 9 <> 0)"),
    "gt": ({"value": {"$gt": 20}}, "value > 20"),
    "gte": ({"k": {"$gte": 50}}, "k >= 50"),
    "lt": ({"value": {"$lt": 5.5}}, "value < 5.5"),
    "lte": ({"opt": {"$lte": 7}}, "event_id % 3 = 0 AND event_id % 9 <> 0"),
    "in": ({"type": {"$in": ["view", "error", 3]}}, "event_type IN ('view', 'error')"),
    "nin": ({"opt": {"$nin": [7]}}, "NOT (event_id % 3 = 0 AND event_id % 9 <> 0)"),
    "exists": ({"opt": {"$exists": True}}, "event_id % 3 = 0"),
    "not_exists": ({"opt": {"$exists": False}}, "event_id % 3 <> 0"),
    "size": ({"tags": {"$size": 2}}, "event_id % 4 = 2"),
    "all": ({"tags": {"$all": ["a", "click"]}}, "event_id % 4 >= 2 AND event_type = 'click'"),
    "all_empty": ({"tags": {"$all": []}}, "true"),
    "type": ({"opt": {"$type": "null"}}, "event_id % 9 = 0"),
    "type_array": ({"tags": {"$type": "array"}}, "true"),
    "and": ({"$and": [{"flag": True}, {"k": {"$lt": 10}}]}, "event_id % 2 = 0 AND k < 10"),
    "or": ({"$or": [{"type": "purchase"}, {"k": {"$gt": 95}}]}, "event_type = 'purchase' OR k > 95"),
    "range": ({"k": {"$gte": 20, "$lt": 30}, "flag": False}, "k >= 20 AND k < 30 AND event_id % 2 = 1"),
    "empty": ({}, "false"),
}
for _name, (_condition, _sql) in FILTERS.items():
    add(f"filter_{_name}", lambda s, d, c=_condition: predicates.filter_where(T.event_nodes(s, d), c).select("id"),
        f"SELECT event_id + 1 AS id FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE {_sql}")

# Lookups

SQL_ID = {k: f"{n}000000000000 + 1 + " for k, n in T.KINDS.items()}
EDGES = f"""edges AS (SELECT {SQL_ID["nation"]}n_nationkey AS src, {SQL_ID["region"]}n_regionkey AS dst, 'in_region' AS label, 1.0::DOUBLE AS weight FROM nation
UNION ALL SELECT {SQL_ID["customer"]}c_custkey, {SQL_ID["nation"]}c_nationkey, 'from_nation', 1.0 FROM customer UNION ALL SELECT {SQL_ID["supplier"]}s_suppkey, {SQL_ID["nation"]}s_nationkey, 'from_nation', 1.0 FROM supplier
UNION ALL SELECT {SQL_ID["customer"]}o_custkey, {SQL_ID["order"]}o_orderkey, 'placed', 1.0 FROM orders UNION ALL SELECT {SQL_ID["order"]}l_orderkey, {SQL_ID["part"]}l_partkey, 'contains', l_quantity / 50 FROM lineitem
UNION ALL SELECT DISTINCT {SQL_ID["part"]}l_partkey, {SQL_ID["supplier"]}l_suppkey, 'supplied_by', 1.0 FROM lineitem)"""
add("node_get", lambda s, d: T.star_nodes(s, d, ["nation"]).where(F.col("id") == 2 * 10**12 + 3).select("id", F.to_json("payload").alias("payload")),
    "SELECT 2000000000003 AS id, '{\"kind\":\"nation\",\"name\":\"' || n_name || '\"}' AS payload FROM nation WHERE n_nationkey = 2")
add("node_count", lambda s, d: T.star_nodes(s, d).agg(F.count("*").alias("nodes")), "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS nodes")
add("num_edges", lambda s, d: T.star_edges(s, d).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("num_edges")), f"WITH {EDGES} SELECT src AS id, count(*) AS num_edges FROM edges GROUP BY src")
add("in_degree", lambda s, d: graph.in_degree(T.star_edges(s, d)), f"WITH {EDGES} SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY dst")

# Path queries


def _path(query: str, out: dict[str, str], kinds: list[str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        got = paths.run(query, T.star_nodes(s, d, kinds), T.star_edges(s, d))
        return got.select(*[F.expr(e).alias(n) for n, e in out.items()])

    return run


C, N, R, O, P_ = (SQL_ID[k] for k in ("customer", "nation", "region", "order", "part"))
add("cypher_scan", _path('MATCH (n {kind: "customer"}) RETURN n', {"id": "n.id"}), f"SELECT {C}c_custkey AS id FROM customer")
add("cypher_props", _path('MATCH (n {kind: "part", size: 5}) RETURN n', {"id": "n.id"}), f"SELECT {P_}p_partkey AS id FROM part WHERE p_size = 5")
add("cypher_id", _path("MATCH (n {id: 2000000000003})-[:in_region]->(r) RETURN n, r", {"n": "n.id", "edges": "n.num_edges", "r": "r.id"}), f"SELECT {N}n_nationkey AS n, 1 AS edges, {R}n_regionkey AS r FROM nation WHERE n_nationkey = 2")
add("cypher_one_hop", _path('MATCH (c {kind: "customer"})-[:from_nation]->(n {name: "NATION_3"}) RETURN c', {"id": "c.id", "orders": "c.num_edges - 1"}),
    f"SELECT {C}c_custkey AS id, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' GROUP BY c_custkey")
add("cypher_two_hop", _path('MATCH (c)-[:from_nation]->(n)-[:in_region]->(r) WHERE c.acctbal > 5000 AND r.name == "EUROPE" AND c.kind == "customer" RETURN c, r', {"c": "c.id", "r": "r.id"}),
    f"SELECT {C}c_custkey AS c, {R}r_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000 AND r_name = 'EUROPE'")
add("cypher_three_hop", _path('MATCH (c {segment: "BUILDING"})-[:placed]->(o {status: "F"})-[:contains]->(p)-[:supplied_by]->(s) WHERE p.size < 5 AND o.total > 300000 RETURN c, s', {"c": "c.id", "s": "s.id"}),
    f"""SELECT {C}c_custkey AS c, {SQL_ID["supplier"]}x.l_suppkey AS s FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN part ON p_partkey = l.l_partkey
JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) x ON x.l_partkey = p_partkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND p_size < 5 AND o_totalprice > 300000""")  # fmt: skip
add("cypher_where_num", _path("MATCH (n) WHERE n.size >= 48 RETURN n", {"id": "n.id"}), f"SELECT {P_}p_partkey AS id FROM part WHERE p_size >= 48")
add("cypher_where_str", _path("MATCH (n) WHERE n.segment < 'C' RETURN n", {"id": "n.id"}), f"SELECT {C}c_custkey AS id FROM customer WHERE c_mktsegment < 'C'")
add("cypher_and_or_leftassoc", _path('MATCH (p) WHERE p.size == 1 OR p.size == 2 AND p.type == "SMALL" RETURN p', {"id": "p.id"}), f"SELECT {P_}p_partkey AS id FROM part WHERE (p_size = 1 OR p_size = 2) AND p_type = 'SMALL'")
add("cypher_wildcard", _path('MATCH (x {kind: "supplier"})-[]->(y) RETURN x, y', {"x": "x.id", "y": "y.id"}), f"SELECT {SQL_ID['supplier']}s_suppkey AS x, {N}s_nationkey AS y FROM supplier")
add("cypher_multi_edge", _path('MATCH (o {priority: "1-URGENT"})-[:contains]->(p {size: 7}) RETURN o, p', {"o": "o.id", "p": "p.id"}),
    f"SELECT {O}o_orderkey AS o, {P_}p_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderpriority = '1-URGENT' AND p_size = 7")
add("cypher_type_mismatch", _path('MATCH (n) WHERE n.name != 5 RETURN n', {"id": "n.id"}), "SELECT 0::BIGINT AS id WHERE false")

# Graph operators

RING = """ring AS (WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT vec_id + 1 AS src, (7 * vec_id + 1) % n + 1 AS dst, 'related' AS label, 0.8::DOUBLE AS weight FROM embeddings, n
UNION ALL SELECT vec_id + 1, (13 * vec_id + 5) % n + 1, 'related', 0.5 FROM embeddings, n UNION ALL SELECT vec_id + 1, (3 * vec_id + 2) % n + 1, 'inhibition', 0.3 FROM embeddings, n WHERE vec_id % 5 = 0)"""
for _depth in (1, 2, 3):
    add(f"neighbors_{_depth}", lambda s, d, n=_depth: graph.neighbors(T.ring_edges(s, d), 1, n),
        f"WITH RECURSIVE {RING}, w(id, h) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, h + 1 FROM w JOIN ring ON src = id WHERE h < {_depth}) SELECT DISTINCT id FROM w WHERE id <> 1")


def _diffusion_sql(depth: int, alpha: float = 0.0, inverse: bool = False, lateral: int = 0) -> str:
    factor = " / (1 + log10(greatest(coalesce(max(c), 0), 1)))" if inverse else ""
    hops, parts = [], ["SELECT id, score FROM t0"]
    for i in range(1, depth + 1):
        tier = f"(SELECT * FROM t{i - 1} WHERE score > 0" + (f" ORDER BY score DESC, id LIMIT {lateral}" if lateral and i > 1 else "") + ")"
        hops.append(f"t{i} AS (SELECT dst AS id, sum(score * {1 - alpha} * weight * CASE label WHEN 'inhibition' THEN -1 ELSE 1 END){factor} AS score FROM {tier} JOIN ring ON src = id LEFT JOIN deg ON deg.node = dst GROUP BY dst)")
        parts.append(f"SELECT id, score FROM t{i}")
    return f"WITH {RING}, deg AS (SELECT dst AS node, count(*) AS c FROM ring GROUP BY dst), t0 AS (SELECT vec_id + 1 AS id, 1.0 / (label + 1) AS score FROM embeddings WHERE label <= 2), {', '.join(hops)} SELECT id, round(sum(score), 6) AS score FROM ({' UNION ALL '.join(parts)}) GROUP BY id"


def _diffusion(depth: int, **how) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        seeds = T.vector_nodes(s, d).where("label <= 2").select("id", (1.0 / (F.col("label") + 1)).alias("score"))
        return _rounded(graph.diffuse(seeds, T.ring_edges(s, d), depth, **how))

    return run


add("diffuse_1", _diffusion(1), _diffusion_sql(1))
add("diffuse_2", _diffusion(2), _diffusion_sql(2))
add("diffuse_teleport", _diffusion(2, alpha=0.25), _diffusion_sql(2, 0.25))
add("diffuse_indegree", _diffusion(2, inverse_inhibition=True), _diffusion_sql(2, inverse=True))
add("diffuse_lateral", _diffusion(2, lateral=20), _diffusion_sql(2, lateral=20))
add("unlink_all", lambda s, d: graph.unlink(T.ring_edges(s, d), 1, 2).select("src", "dst", "label"), f"WITH {RING} SELECT src, dst, label FROM ring WHERE NOT (src = 1 AND dst = 2)")


def _cascade(s: SparkSession, d: str) -> DataFrame:
    return graph.delete(T.star_nodes(s, d, ["nation"]), T.star_edges(s, d), 2 * 10**12 + 1)[1].select("src", "dst", "label")


add("delete_cascade", _cascade, f"WITH {EDGES} SELECT src, dst, label FROM edges WHERE src <> 2000000000001 AND dst <> 2000000000001")
add("migrate_dim", lambda s, d: graph.migrate(T.vector_nodes(s, d), T.ring_edges(s, d), 8)[0].select("id", F.size("vector").alias("dim"), V.l2_norm(F.col("vector")).alias("norm")),
    "SELECT vec_id + 1 AS id, 8 AS dim, 0.0::DOUBLE AS norm FROM embeddings")

# Replay of a mutation log


def _replayed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = T.order_log(s, d)
    none = s.createDataFrame([], "id long, vector array<double>, payload string")
    nodes = replay.nodes_after(none, log)
    return nodes, replay.edges_after(s.createDataFrame([], "eid long, src long, dst long, label string, weight double"), log, nodes)


add("log_replay_nodes", lambda s, d: _replayed(s, d)[0].select("id", "payload"),
    f"""SELECT {O}o_orderkey AS id, CASE WHEN o_orderkey % 49 = 0 THEN 'again' WHEN o_orderkey % 3 = 0 THEN 'updated' ELSE o_orderstatus END AS payload FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 49 = 0
UNION ALL SELECT {C}c_custkey, 'customer' FROM customer""")  # fmt: skip
add("log_replay_edges", lambda s, d: _replayed(s, d)[1].select("src", "dst", "label"), f"SELECT {C}o_custkey AS src, {O}o_orderkey AS dst, 'placed' AS label FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0")

# Text


def _bm25_sql(query: str, k: int) -> str:
    terms = ", ".join(f"('{g}')" for g in text.query_grams(query))
    # Bigrams by zipping the characters with themselves: linear in the text.
    chars = "string_split(t, '')"
    grams = f"CASE WHEN len({chars}) = 1 THEN {chars} ELSE list_transform(list_zip({chars}[:-2], {chars}[2:]), lambda p: p[1] || p[2]) END"
    return f"""WITH q(term) AS (VALUES {terms}), d AS (SELECT doc_id + 1 AS id, lower(coalesce(text, '')) AS t FROM documents), g AS (SELECT id, {grams} AS g FROM d WHERE t <> ''),
s AS (SELECT count(*) AS n, avg(len(g)) AS a FROM g), tf AS (SELECT id, len(g) AS dl, term, count(*) AS tf FROM (SELECT id, g, unnest(g) AS x FROM g) JOIN q ON x = term GROUP BY id, len(g), term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM tf JOIN df USING (term), s GROUP BY id ORDER BY sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) DESC, id LIMIT {k}"""


def _texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select((F.col("doc_id") + 1).alias("id"), "text")


add("bm25_topk", lambda s, d: _rounded(search.top(text.bm25(_texts(s, d), "licenze xylo"), 10)), _bm25_sql("licenze xylo", 10))
add("bm25_single_char", lambda s, d: _rounded(search.top(text.bm25(_texts(s, d), "x"), 10)), _bm25_sql("x", 10))
ANCHORS = ["rust", "rusty", "query engine"]


def _keywords(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select((F.col("doc_id") + 1).alias("id"), F.element_at(F.array(*map(F.lit, ANCHORS)), (F.col("doc_id") % 3 + 1).cast("int")).alias("keyword"))


add("keyword_anchor", lambda s, d: text.keyword_hits(_keywords(s, d), "Rust and rusty RUST"), "SELECT doc_id + 1 AS id, CASE WHEN doc_id % 3 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS score FROM documents WHERE doc_id % 3 < 2")

# The pipeline of search


def _expand2(s: SparkSession, d: str) -> DataFrame:
    return _rounded(search.search(T.vector_nodes(s, d), T.ring_edges(s, d), _vector(s, d), search.SearchConfig(top_k=5, expand_depth=2, min_score=0.0)))


add("search_expand2", _expand2, f"""WITH {RING}, t0 AS (SELECT * FROM ({COSINE}) WHERE score >= 0 ORDER BY score DESC, id LIMIT 5),
t1 AS (SELECT dst AS id, sum(score * weight * CASE label WHEN 'inhibition' THEN -1 ELSE 1 END) AS score FROM t0 JOIN ring ON src = id GROUP BY dst),
t2 AS (SELECT dst AS id, sum(score * weight * CASE label WHEN 'inhibition' THEN -1 ELSE 1 END) AS score FROM (SELECT * FROM t1 WHERE score > 0) JOIN ring ON src = id GROUP BY dst)
SELECT id, round(sum(score), 6) AS score FROM (FROM t0 UNION ALL FROM t1 UNION ALL FROM t2) GROUP BY id ORDER BY sum(score) DESC, id LIMIT 5""")  # fmt: skip


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    config = search.SearchConfig(top_k=10, expand_depth=0, min_score=0.0, text_boost=0.9, enable_text_hybrid_search=True)
    return _rounded(search.search(T.vector_nodes(s, d), T.ring_edges(s, d), _vector(s, d), config, "rusty rust", None, _keywords(s, d)))


add("hybrid_text_vector", _hybrid, f"""WITH v AS (SELECT * FROM ({COSINE}) WHERE score >= 0 ORDER BY score DESC, id LIMIT 10), k AS (SELECT doc_id + 1 AS id, 0.9::DOUBLE AS score FROM documents WHERE doc_id % 3 < 2),
f AS (SELECT id, sum(score) AS score FROM (FROM v UNION ALL FROM k) WHERE id IN (SELECT vec_id + 1 FROM embeddings) GROUP BY id) SELECT id, round(score, 6) AS score FROM f ORDER BY score DESC, id LIMIT 10""")  # fmt: skip


def _advanced(s: SparkSession, d: str) -> DataFrame:
    config = search.SearchConfig(top_k=10, expand_depth=2, min_score=0.1, teleport_alpha=0.2, enable_advanced_pipeline=True, enable_sparse_residual=True, fista_threshold=0.2, enable_dpp=True, enable_inverse_inhibition=True)
    return search.search(T.vector_nodes(s, d), T.ring_edges(s, d), _vector(s, d), config)


add("search_advanced", _advanced)


def _fista(s: SparkSession, d: str) -> DataFrame:
    q = _vector(s, d)
    rows = search.vectors_of(search.knn(T.vector_nodes(s, d).where("id > 1"), q, 5), T.vector_nodes(s, d))
    a, _, size = numeric.fista(np.array([r.vector for r in rows]), np.array(q), 0.05)
    return s.createDataFrame([(r.id, float(x), size) for r, x in zip(rows, a, strict=True)], "id long, coefficient double, residual double")


add("fista_residual", _fista)


def _dpp(s: SparkSession, d: str) -> DataFrame:
    rows = sorted(search.vectors_of(search.knn(T.vector_nodes(s, d), _vector(s, d), 30), T.vector_nodes(s, d)), key=lambda r: (-r.score, r.id))
    pick = numeric.dpp_greedy(np.array([r.vector for r in rows]), np.array([r.score for r in rows]), 10)
    return s.createDataFrame([(n, rows[i].id, rows[i].score) for n, i in enumerate(pick)], "place int, id long, score double")


add("dpp_diverse", _dpp)


def _nmf(s: SparkSession, d: str) -> DataFrame:
    means = T.vector_nodes(s, d).select("label", F.posexplode("vector")).groupBy("label", "pos").agg(F.avg(F.abs("col")).alias("m"))
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v")).orderBy("label").collect()
    _, h = numeric.nmf(np.array([[x.m for x in r.v] for r in rows]), 4)
    got = numeric.nmf_topics(np.array(_vector(s, d)), h)
    return s.createDataFrame([(float(got["depth"]), got["coverage"], float(got["novelty"]))], "depth double, coverage int, novelty double")


add("nmf_topics", _nmf)
