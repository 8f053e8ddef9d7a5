import corpus_pipeline as C
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(1000, body, "en", "a", 1), (1001, body, "en", "a", 1), (1001, body, "en", "a", 1), (1002, body + " end", "en", "b", 1), (1003, None, None, None, None), (1004, "", "en", "b", 0), (1005, 'my token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" ok', "en", "b", 5)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return spark.read.parquet(f"{SF}/documents.parquet").unionByName(more).withColumn("Score", F.lit(1)).withColumn("fp", F.lit("x"))


def test_stages(spark, docs, tmp_path):
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "tokens"]
    now, seen = docs, {}
    for name, stage in C.STAGES:
        got = stage(spark, now, SF)
        if name != "tokens":
            assert got.columns == docs.columns
        got.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now.collect()
    kept = [r.doc_id for r in seen["near_duplicates"]]
    assert len(kept) == len(set(kept)) and 1000 in kept and not {1001, 1002} & set(kept) and len({1003, 1004} & set(kept)) == 1
    assert [r.text for r in seen["secrets"] if r.doc_id == 1005] == ['my token = "[SECRET]" ok'] and len(seen["secrets"]) == len(kept)
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted(r.n_tokens for r in seen["tokens"]) == sorted(len(own.encode_ordinary(r.text)) for r in seen["mixing"])


def test_empty(spark, docs):
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
