import numpy as np

from meshlake.functions import numeric
from meshlake.operators import graph, text


def test_fista_and_dpp():
    a, rest, size = numeric.fista(np.array([[1, 0, 0, 0], [0, 1, 0, 0]]), np.array([0.8, 0.6, 0, 0]), 0.01)
    assert np.allclose(a, [0.79, 0.59], atol=1e-3) and size < 0.02 and len(rest) == 4
    assert numeric.dpp_greedy(np.array([[1, 0], [1, 0.01], [0, 1]]), np.array([1, 0.9, 0.8]), 2) == [0, 2]
    assert numeric.dpp_greedy(np.eye(2), np.ones(2), 5) == [0, 1]


def test_nmf():
    v = np.array([[1, 2, 3, 4], [2, 4, 6, 8], [4, 3, 2, 1.0]])
    w, h = numeric.nmf(v, 2, 500)
    assert np.linalg.norm(v - w @ h) / np.linalg.norm(v) < 0.05 and (w >= 0).all()
    assert abs(numeric.nmf_topics(v[0], h)["topics"].sum() - 1) < 1e-9


def test_diffusion_rules(spark):
    edges = spark.createDataFrame([(1, 2, "r", 0.5), (2, 1, "r", 1.0), (1, 3, "inhibition", 1.0), (3, 4, "r", 1.0)], "src long, dst long, label string, weight double")
    seeds = spark.createDataFrame([(1, 1.0)], "id long, score double")
    got = lambda *a, **k: {r.id: r.score for r in graph.diffuse(seeds, edges, *a, **k).collect()}
    assert got(0) == {1: 1.0}
    assert got(2) == {1: 1.5, 2: 0.5, 3: -1.0}
    assert got(2, alpha=1.0) == {1: 1.0}
    assert {r.id for r in graph.neighbors(edges, 1, 3).collect()} == {2, 3, 4} and graph.neighbors(edges, 1, 0).count() == 0


def test_text(spark):
    docs = spark.createDataFrame([(1, "Aba"), (2, ""), (3, None), (4, "x"), (5, "bab ab")], "id long, text string")
    assert {r.id for r in text.bm25(docs, "ab").collect()} == {1, 5}
    assert [r.id for r in text.bm25(docs, "X").collect()] == [4] and text.bm25(docs, "").count() == 0
    words = spark.createDataFrame([(1, "Rust"), (2, "rusty"), (2, "rust")], "id long, keyword string")
    assert {r.id: r.score for r in text.keyword_hits(words, "rust and RUSTY rust").collect()} == {1: 2.0, 2: 3.0}
