import numpy as np
import pytest

from meshlake.errors import DimensionMismatch, NodeNotFound, StoreError
from meshlake.operators import search
from meshlake.operators.search import SearchConfig
from meshlake.sources.store import GraphStore
from meshlake.streaming.compaction import start_compaction


def state(store):
    nodes = sorted((r.id, tuple(r.vector), r.payload) for r in store.raw_nodes().collect())
    return nodes, sorted((r.src, r.dst, r.label, r.weight) for r in store.edges().collect())


def test_life_of_a_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"), dim=2)
    a, b = store.batch_insert([[1, 0], [0, 1]], [{"name": "a"}, {"name": "b"}])
    store.insert_with_id(10, [1, 1], {"name": "c", "n": 1})
    assert (a, b, store.insert([0.5, 0], {})) == (1, 2, 11)
    store.link(1, 2)
    store.link(1, 2, "again", 0.5)
    store.link(2, 10)
    store.update_payload(2, {"name": "B"})
    store.update_vector([0, 2], 2)
    store.delete(11)
    with pytest.raises(NodeNotFound):
        store.link(1, 99)
    with pytest.raises(DimensionMismatch):
        store.insert([1], {})
    with pytest.raises(StoreError):
        store.insert_with_id(10, [1, 1], {})
    before = state(store)
    store.flush()
    again = GraphStore(spark, str(tmp_path / "s"))
    assert state(again) == before == state(store)
    assert again.get(2)["payload"] == {"name": "B"} and again.get_edges(1)[1] == {"target_id": 2, "label": "again", "weight": 0.5}
    assert [r.id for r in again.filter_where({"n": 1}).collect()] == [10]
    assert [r.id for r in again.search([1, 0], 2, 0, 0.1).collect()] == [1, 10]
    assert {r.id for r in again.neighbors(1, 2).collect()} == {2, 10}
    assert [r.b.id for r in again.query("MATCH (a {id: 1})-[:again]->(b) RETURN b").collect()] == [2]
    assert dict(again.texts().collect()) == {1: "a", 2: "B", 10: "c"}
    again.unlink(1, 2)
    again.delete(10)
    assert state(again)[1] == [] and len(again) == 2 and 10 not in again and again.insert([0, 0], {}) == 12
    assert again.migrate(str(tmp_path / "m"), 3) == [1, 2, 12]
    assert GraphStore(spark, str(tmp_path / "m")).dim() == 3


def test_transactions(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"), dim=1)
    tx = store.begin_tx()
    tx.insert([1], {})
    tx.link(1, 7)
    with pytest.raises(NodeNotFound):
        tx.commit()
    assert store.node_count() == 0
    tx = store.begin_tx()
    tx.insert_with_id(7, [1], {"v": 1})
    tx.delete(7)
    tx.insert_with_id(7, [2], {"v": 2})
    tx.update_payload(7, {"v": 3})
    assert tx.pending_count() == 4 and tx.commit() == [7, 7]
    assert store.get_payload(7) == {"v": 3}
    assert store.begin_tx().commit() == []
    start_compaction(store, str(tmp_path / "c"), None).awaitTermination()
    assert GraphStore(spark, str(tmp_path / "s"))._watermark == 4 and store.get_payload(7) == {"v": 3}


def test_bits_and_halves(spark, tmp_path):
    bits = GraphStore(spark, str(tmp_path / "b"), dim=1, dtype="u64")
    bits.batch_insert([[(1 << 64) - 1], [1]], [{}, {}])
    assert [(r.id, r.score) for r in bits.search([(1 << 64) - 2], 2, 0, 0).collect()] == [(1, 63.0), (2, 0.0)]
    half = GraphStore(spark, str(tmp_path / "h"), dim=1, dtype="f16")
    half.insert([0.1], {})
    assert half.get(1)["vector"] == [0.0999755859375]


def test_hybrid(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"), dim=2)
    store.batch_insert([[1, 0], [0, 1], [-1, 0]], [{"t": "rust engine"}, {"t": "query plan"}, {"t": "zzz"}])
    got = store.search_hybrid([1, 0], "query", store.texts(), top_k=2, expand_depth=0).collect()
    assert {r.id for r in got} == {1, 2}
    config = SearchConfig(top_k=2, expand_depth=1, min_score=0.0, enable_advanced_pipeline=True, enable_sparse_residual=True, enable_dpp=True)
    assert len(store.search_advanced([0.6, 0.8], config).collect()) == 2


def test_of_two_writers_one_is_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    one, two = GraphStore(spark, path, dim=1), GraphStore(spark, path, dim=1)
    one.batch_insert([[1], [2]], [{}, {}])
    with pytest.raises(StoreError, match="open the store again"):
        two.batch_insert([[i] for i in range(5)], [{}] * 5)
    assert sorted(r.id for r in GraphStore(spark, path).raw_nodes().collect()) == [1, 2]
    one.flush()  # which takes the claims away
    with pytest.raises(StoreError, match="open the store again"):
        two.insert([9], {})
    again = GraphStore(spark, path)
    assert again.batch_insert([[i] for i in range(5)], [{}] * 5) == [3, 4, 5, 6, 7] and again.node_count() == 7


def test_batch_of_queries(spark):
    nodes = spark.createDataFrame([(i, [float(i % 5), float(i % 3)] if i != 7 else None) for i in range(40)] + [(99, [1.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.5]), (2, [0.0, 0.0]), (3, [2.0])], "query_id long, query array<double>")
    for block in (1, 100):
        got = sorted((r.query_id, r.id, round(r.score, 9)) for r in search.knn_batch(asked, nodes, 3, block).collect())
        want = []
        for q in asked.collect():
            a = np.array(q.query)
            s = []
            for n in nodes.collect():
                if n.vector is not None and len(n.vector) == len(a):
                    b = np.array(n.vector)
                    norm = np.linalg.norm(a) * np.linalg.norm(b)
                    s.append((-round(float(a @ b / norm) if norm else 0.0, 12), n.id))
            want += [(q.query_id, i, round(-x, 9)) for x, i in sorted(s)[:3]]
        assert got == sorted(want)
