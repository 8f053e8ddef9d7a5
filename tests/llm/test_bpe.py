import hashlib
import os
import random

import numpy as np
import pytest

from meshlake.llm import bpe, queries

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def vocab():
    return queries.byte_vocabulary()


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


TEXTS = [
    None, "", " ", "\n", "a", "don't I'll we'VE", "  two  spaces \t\n end ", "x y z　 \x85w\x1cq​u", "héllo wörld ñ 你好，世界 مرحبا 🙂🙂👩‍👩‍👧",
    "12345 6.7e8 ½ ²", "<|endoftext|>", "a" * 3000, "\n" * 500, "é" * 400, "word " * 50_000, "%%%&&&$$$" * 40, "x" * 127, "x" * 128, "x" * 129, "\u0000\u0007",
]


def run(spark, vocab, texts, decoded=False, staged=False):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    got = bpe.encode(df, "doc_id", "text", vocab, decoded=decoded, staged=staged)
    got = got if decoded else bpe.decode(got, "doc_id", "ids", vocab)
    return {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got.collect()}


@pytest.mark.parametrize("decoded, staged", [(True, False), (False, False), (True, True)])
def test_as_the_library(spark, vocab, library, decoded, staged):
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice(" abcdefgh\n.,é🙂1") for _ in range(r.randrange(60))) for _ in range(60)]
    got = run(spark, vocab, texts, decoded, staged)
    for i, t in enumerate(texts):
        assert got[i] == (library.encode_ordinary(t or ""), (t or "").encode()), repr(t)[:80]


def test_heap_merges(vocab, library):
    for word in (b"a" * 3000, os.urandom(300).hex().encode(), ("é" * 900).encode(), b"ab"):
        assert vocab.merge(word) == library._encode_single_piece(word)


def test_rank_map_holds_every_pair(vocab):
    offset, cells, ranks = vocab.rank_map()
    for t, r in list(vocab.ranks.items())[::97]:
        for i in range(1, len(t)):
            a, b = vocab.ranks.get(t[:i]), vocab.ranks.get(t[i:])
            if a is not None and b is not None:
                at = offset[a] + b
                assert cells[at] == a and ranks[at] == r


def test_query_and_empty_table(spark, tmp_path, library):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(1, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op1_bpe(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        t = TEXTS[r.doc_id] or ""
        ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/e/documents.parquet")
    assert queries.op1_bpe(spark, f"{tmp_path}/e").collect() == []


def test_unpacked_ids_and_bad_ids(spark, vocab):
    df = bpe.encode(spark.createDataFrame([(1, "hello world"), (2, None)], "k long, t string"), "k", "t", vocab)
    got = {r.k: r.i for r in df.select("k", bpe.ids_of(df.ids).alias("i")).collect()}
    assert got == {1: [31373, 995], 2: []}
    bad = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x00"))], "k long, ids binary")
    with pytest.raises(Exception, match="no such id"):
        bpe.decode(bad, "k", "ids", vocab).collect()


def test_runs_over_batches(spark, vocab, library):
    r = random.Random(8)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "délta"]) + str(r.randrange(50)) for _ in range(r.randrange(40))) for _ in range(300)]
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(limit)
    spark.conf.set(limit, "7")
    try:
        got = run(spark, vocab, texts, True)
    finally:
        spark.conf.set(limit, was)
    assert all(got[i] == (library.encode_ordinary(t), t.encode()) for i, t in enumerate(texts))
