"""A training corpus out of ``documents``: toxicity, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and, but for the last, returns the
columns of ``documents``. ``run`` writes each result as Parquet in the shared checkpoint folder and reads it again,
so a lost executor costs no more than a stage.

Edge cases: null and empty texts are scored by the bias, count as one group of near duplicates, hold no secret and
are taken no words of by the mix. Repeated rows are one group. Columns beyond those of ``documents`` ride along to
the last stage, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm import bpe, jaccard, mixing, secrets, toxicity
from meshlake.llm.common import row_hash, settle
from meshlake.session import checkpoint_dir, table

#: SQL can't express the classifier, the forest or the tokenizer: tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None
#: Near copies have this Jaccard similarity of their five-word shingles or more.
SHARE, WORDS = 0.8, 5


def _sized(df: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold."""
    settle(spark)
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    packed = docs.select(F.col("text").alias("t"), F.struct("*").alias("doc"))
    return toxicity.score(packed, "t", machine).where(F.col("score") < toxicity.THRESHOLD).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id; of rows alike in all columns one."""
    settle(spark)
    row = F.struct("doc_id", row_hash(docs).alias("hash"))
    packed = docs.select(row.alias("row"), F.col("text").alias("t"), F.struct("*").alias("doc"))
    got = jaccard.near_duplicates(packed, "row", "t", WORDS, SHARE)
    first = got.where(F.col("row") == F.col("component")).select("row").distinct()
    # The join has dealt the rows by the same key: dropping repeated rows needs no further shuffle.
    return packed.join(first, "row", "left_semi").dropDuplicates(["row"]).select("doc.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    settle(spark)
    forest = secrets.train(secrets.labelled_findings(spark))
    packed = docs.select(F.col("text").alias("t"), F.col("source").alias("s"), F.struct("*").alias("doc"))
    got = secrets.scan(packed, "t", "s", forest)
    return _sized(got.select(F.col("doc").withField("text", F.col("redacted")).alias("doc")).select("doc.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that a document, or blocks of it, are taken."""
    settle(spark)
    return _sized(mixing.mix(docs, "doc_id", "source", "text"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) for each row; ids are little-endian unsigned 32-bit integers."""
    settle(spark)
    vocab = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = bpe.encode(docs, "doc_id", "text", vocab, decoded=True, staged=True)
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("mixing", mix_sources), ("tokens", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
