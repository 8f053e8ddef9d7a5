import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.llm import licenses, mixing, queries, secrets, topk, toxicity, warc
from meshlake.llm.url_filter import filter_urls


def test_warc(spark):
    tag = lambda t: f"ETag: {t}\r\nX: 1\r\nContent-Length: 5"
    rows = [
        (1, "http://a.org/x", 10, 200, tag('"1"')), (2, "http://a.org/x", 20, 200, tag('"2"')), (3, "https://www.a.org/x?utm_a=1", 30, 304, 'etag: W/"2"\nContent-Length: 0\nX: 2'),
        (4, "http://a.org/x", 15, 304, tag('"2"')), (5, "http://a.org/x", 5, 304, tag('"1"')), (6, None, 50, 304, None), (7, "http://a.org/x", 40, 304, None), (8, "http://a.org/x", None, 304, tag('"2"')),
        (9, "http://a.org/x", 20, 304, tag('"2"')), (9, "http://a.org/x", 20, 304, tag('"2"')), (10, "http://a.org/x", 45, 404, tag('"9"')), (11, "no url", 1, 304, ""),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, time long, status int, headers string").withColumn("STATE", F.lit("clash"))
    got = sorted((r.record_id, r.state, r.response_id) for r in warc.resolve(df).collect())
    assert got == [(3, "resolved", 2), (4, "mismatch", None), (5, "no_response", None), (6, "no_response", None), (7, "no_validator", None), (8, "no_response", None), (9, "resolved", 2), (9, "resolved", 2), (11, "no_response", None)]
    merged = {h.name: h.value for h in warc.resolve(df).where("record_id = 3").first().headers}
    assert merged == {"content-length": "5", "etag": 'W/"2"', "x": "2"}
    assert warc.resolve(df.limit(0)).count() == 0


def test_warc_of_one_hot_url(spark):
    rows = spark.range(3000).select("id", F.lit("http://h.org/").alias("url"), F.col("id").alias("time"), F.when(F.col("id") % 7 == 0, 200).otherwise(304).alias("status"), F.lit('ETag: "1"').alias("headers"))
    got = warc.resolve(rows, "id").collect()
    assert len(got) == 3000 - 429 and all(r.response_id == r.record_id // 7 * 7 for r in got)


def test_url_filter(spark):
    rows = [(1, "http://A.net/x"), (2, "http://m.example.net/en/9"), (3, "https://example.com/de/"), (4, "http://x.org/fr/1"), (5, None), (6, "nothing"), (7, "http://bad.io/p/?utm_x=1#f"), (8, "http://notnet/x"), (1, "http://A.net/x")]
    listed = spark.createDataFrame([("bad.io/p",)], "canonical string")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in filter_urls(pages, "url", queries.URL_RULES, listed, "canonical").collect())
    assert got[0] == got[1] == (1, "net/", "block")
    assert [g[1:] for g in got[2:]] == [("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow")]


def test_licences(spark):
    name, body = next(iter(licenses.TEMPLATES.items()))
    df = spark.createDataFrame([(1, f"Some words.\n\n{body.upper()}\n\nmore"), (2, "nothing here"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: [f.licence for f in r.licences] for r in licenses.scan(df, "text").collect()}
    assert name in got[1] and got[2] == got[3] == got[4] == []


def test_secrets(spark):
    forest = secrets.train(secrets.labelled_findings(spark))
    texts = ['a token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" b', "token = your_token_here", "see commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", None, "", "plain words only"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("Findings", F.lit(1))
    got = {r.id: r for r in secrets.scan(df, "text", None, forest).collect()}
    assert got[0].redacted == 'a token = "[SECRET]" b'
    assert [got[i].redacted for i in range(1, 6)] == texts[1:]
    assert secrets.scan(df.limit(0), "text", None, forest).count() == 0


def test_toxicity_learns_pairs():
    rng = np.random.default_rng(1)
    y, rows = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        y.append(int(a and b))
        rows.append(np.array([1 if a else 2, 3 if b else 4, 10 + rng.integers(0, 5)], np.int32))
    m = toxicity.fit(rows, y, bits=8)
    at = lambda *t: float(m.margins(np.array([np.searchsorted(m.columns, x) for x in t if x in m.columns], np.int64), np.array([0, sum(x in m.columns for x in t)]))[0])
    assert at(1, 3) > 0 > max(at(1, 4), at(2, 3), at(2, 4))


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.QUERIES["op2_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    hits = [r.predicted for r in got if r.toxic]
    assert len(hits) > 100 and np.mean(hits) > 0.8 and np.mean([r.predicted for r in got if not r.toxic]) < 0.02


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES)))
def test_against_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS FROM '{d}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    rows = [dict(zip([c[0] for c in want.description], r, strict=True)) for r in want.fetchall()]
    got = [r.asDict() for r in queries.QUERIES[name](spark, d).collect()]
    key = lambda r: str([r[c] for c in columns])
    assert sorted(map(key, got)) == sorted(map(key, rows))


def test_top_k_ties_and_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [-1.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("id") == 0, k=2, scale=1024.0)
    assert sorted((r["rank"], r.vec_id) for r in got.collect()) == [(1, 1), (2, 2)]


def test_apportion_and_mix(spark):
    assert mixing.apportion([53.0, 24.0, 23.0], 7) == [3, 2, 2]
    docs = spark.createDataFrame([(i, "w " * (i % 30 + 1), f"s{i % 3}") for i in range(300)] + [(None, None, None), (300, "", "s0"), (1, "w w", "s1")], "doc_id long, text string, source string")
    got = mixing.mixed_sizes(docs, "doc_id", "source", "text").collect()
    assert len(got) == 303 and all(r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(a - t) <= max(64, t * 0.05) for a, t in by.values())


def test_mix_takes_what_the_plan_says(spark):
    docs = spark.createDataFrame([(i, " ".join(f"é{j}" for j in range(i % 400)) or None, f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    want = {r.doc_id: r.taken for r in mixing.mixed_sizes(docs, "doc_id", "source", "text", block=16).collect()}
    got = {}
    for r in mixing.mix(docs, "doc_id", "source", "text", block=16).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert sum(want.values()) > 0 and all(abs(got.get(i, 0) - n) == 0 for i, n in want.items())


def test_columns_called_like_results_are_kept(spark):
    df = spark.createDataFrame([(1, "http://a.net/x", "Licensed under the MIT License.", "p")], "id long, path string, text string, PATH2 string")
    for n in ("score", "licences", "findings", "redacted", "host", "rule"):
        df = df.withColumn(n, F.lit(n))
    forest = [secrets.Tree(share=0.1)]
    machine = toxicity.fit([], [])
    for got, names in (
        (toxicity.score(df, "text", machine), ["score"]), (licenses.scan(df, "text"), ["licences"]), (secrets.scan(df, "text", "path", forest), ["findings", "redacted"]),
        (filter_urls(df, "path", queries.URL_RULES, spark.createDataFrame([], "c string"), "c"), ["host", "rule"]),
    ):
        row = got.first().asDict()
        assert len(got.columns) == len(set(got.columns)) and all(row[f"{n}_input"] == n for n in names), got.columns
    assert (row["path_input"], row["host"], row["path"]) == ("http://a.net/x", "a.net", "/x")


def test_mix_tells_rows_apart_by_where_they_are_null(spark):
    docs = spark.createDataFrame([(1, "x y", None, "s"), (1, "x y", "s", None)], "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, "doc_id", "source", "text", max_repeat=1, block=1)
    assert sorted((r.lang or "", r.source or "") for r in got.collect()) == [("", "s"), ("s", "")]


def test_mix_blocks_are_a_seeded_permutation():
    for n in (1, 2, 7, 12, 331):
        stride, shift = mixing.turn(5, 1, 3, n)
        assert sorted((b * stride + shift) % n for b in range(n)) == list(range(n)) and mixing.turn(5, 1, 3, n) == (stride, shift)
    assert len({mixing.turn(seed, 0, 0, 331) for seed in range(9)}) > 5
