import pytest
from pyspark.sql import functions as F

from meshlake.errors import QueryParseError
from meshlake.operators import paths, predicates

PEOPLE = [(1, '{"name": "Ann", "age": 30, "tags": ["a", 1], "x": null}'), (2, '{"name": "Bob", "age": 25.0, "ok": true}'), (3, '{"name": "Cid", "age": "25", "a.b": 1}'), (4, "[1]")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(PEOPLE, "id long, payload string").withColumn("payload", F.parse_json("payload")).cache()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, 2, "knows"), (1, 2, "knows"), (2, 3, "likes"), (3, 1, "knows"), (3, 3, "knows")], "src long, dst long, label string").cache()


@pytest.mark.parametrize(
    ("condition", "ids"),
    [
        ({"age": 25}, []), ({"age": 25.0}, [2]), ({"age": "25"}, [3]), ({"age": {"$gt": 20}}, [1, 2]), ({"age": {"$ne": 30}}, [2, 3, 4]), ({"x": None}, [1]), ({"x": {"$exists": True}}, [1]),
        ({"tags": {"$all": ["a", 1]}}, [1]), ({"tags": {"$all": []}}, [1]), ({"tags": {"$size": 2}}, [1]), ({"tags": ["a", 1]}, [1]), ({"ok": {"$type": "boolean"}}, [2]), ({"ok": {"$type": "what"}}, []), ({"a.b": 1}, [3]),
        ({"name": {"$in": []}}, []), ({"name": {"$nin": ["Ann"]}}, [2, 3, 4]), ({"$and": []}, [1, 2, 3, 4]), ({"$or": []}, []), ({}, []), ({"$or": [{"age": 30}, {"ok": True}]}, [1, 2]), ({"name": {"$gt": 1}}, []),
    ],
)
def test_filter(nodes, condition, ids):
    assert sorted(r.id for r in predicates.filter_where(nodes, condition).collect()) == ids


@pytest.mark.parametrize("condition", [{"a": {"$gt": "x"}}, {"a": {"$in": 1}}, {"a": {"$exists": 1}}, {"a": {"$size": -1}}, {"a": {"$what": 1}}, {"$and": 1}, {"$what": []}])
def test_bad_filter(nodes, condition):
    with pytest.raises(ValueError):
        predicates.filter_where(nodes, condition)


def rows(query, nodes, edges):
    got = paths.run(query, nodes, edges)
    return sorted(tuple(r[c].id for c in got.columns) for r in got.collect())


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("MATCH (a)-[:knows]->(b) RETURN a, b", [(1, 2), (1, 2), (3, 1), (3, 3)]),
        ("match (a {id: 1})-[]->(b)-[:likes]->(c) return c, nobody", [(3,), (3,)]),
        ("MATCH (a) WHERE a.age == 25 RETURN a", [(2,)]),
        ("MATCH (a {age: 25}) RETURN a", []),
        ("MATCH (a {age: 25.0}) RETURN a", [(2,)]),
        ("MATCH (a) WHERE a.age != 1 RETURN a", [(1,), (2,)]),
        ("MATCH (a) WHERE a.ok == true RETURN a", [(2,)]),
        ("MATCH (a) WHERE a.ok > false RETURN a", []),
        ("MATCH (a) WHERE a.name == Bob OR a.id == 1 AND a.age < 28 RETURN a", [(2,)]),
        ("MATCH (a)-[]->(b)-[]->(a) RETURN a", [(1,), (1,), (2,), (3,), (3,), (3,), (3,)]),
    ],
)
def test_paths(nodes, edges, query, want):
    got = rows(query, nodes, edges)
    if "(a)-[]->(b)-[]->(a)" in query:
        by = {}
        for s, t in [(1, 2), (1, 2), (2, 3), (3, 1), (3, 3)]:
            by.setdefault(s, []).append(t)
        want = sorted((c,) for s in by for b in by[s] for c in by.get(b, []))
    assert got == want


@pytest.mark.parametrize("query", ["MATCH (a)", "MATCH (a)-[]->() RETURN a", "MATCH (a) WHERE a.x = 1 RETURN a", "MATCH (a) RETURN a LIMIT 3", "MATCH (a) WHERE a.x == -1 RETURN a", "FIND (a)"])
def test_bad_path(nodes, edges, query):
    with pytest.raises(QueryParseError):
        paths.run(query, nodes, edges)
