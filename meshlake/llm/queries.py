"""The queries of the corpus operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: The contract's rules (fixed values).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Host labels of advertisers whose URLs make up the query's list (fixed values).
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list: canonical URLs of pages on hosts with a listed label."""
    from meshlake.llm.url_filter import canonical_of, host_of

    return pages.where(F.arrays_overlap(F.split(host_of(F.col("url")), r"\."), F.array(*map(F.lit, LISTED_LABELS)))).select(canonical_of(F.col("url")).alias("canonical")).distinct()


@query(
    "op5_url_filter",
    r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u),
l AS (SELECT *, list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS listed FROM r)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow'
  WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict, listed FROM l
""",
)
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.url_filter import filter_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, "url", URL_RULES, listed_urls(pages), "canonical").select("page_id", "host", "path", "rule", "verdict", "listed")


@query("op7_media_ts")
def op7_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm import mpegts

    got = mpegts.read(mpegts.store(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    units = F.col("units")
    random = F.filter(units, lambda u: u.random_access)
    return got.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("pes="), F.size(units), F.lit(";rap="), F.size(random), F.lit(";last_pts="), F.element_at(units, -1).pts, F.lit(";last_rap="), F.element_at(random, -1).offset, F.lit(";cc_errors="), F.col("continuity_errors")).alias("feature"),
    )


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.simhash import near_duplicates

    got = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", words=3, distance=2)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    got = toxicity.score(docs, "text", machine)
    return got.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query(
    "op10_topk",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
)
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.topk import top_k

    got = top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0, k=10, scale=1024.0)
    return got.withColumn("score", F.col("score").cast("long"))


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.mixing import mixed_sizes

    got = mixed_sizes(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return got.select("doc_id", "size", "source_size", "target", "taken")


def byte_vocabulary():
    import public_tokenizers

    from meshlake.llm import bpe

    return bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm import bpe

    vocab = byte_vocabulary()
    got = bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", vocab, decoded=True)
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _licence_sql() -> str:
    from meshlake.llm.licenses import TEMPLATES, bigrams

    rows = ", ".join(f"('{k}', [{', '.join(repr(p) for p in bigrams(t))}])" for k, t in TEMPLATES.items())
    return rf"""
WITH t(licence, pairs) AS (VALUES {rows}),
d AS (SELECT doc_id, rid, list_distinct(list_transform(list_distinct(list_concat([x], regexp_split_to_array(x, '\n[ \t\r]*\n'), regexp_split_to_array(x, '[\n\r]+'),
    string_split(regexp_replace(x, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)), regexp_split_to_array(regexp_replace(x, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), '[\n\r]+|' || chr(1)))),
    lambda u: list_filter(regexp_split_to_array(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> ''))) AS units
  FROM (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS x FROM documents)),
u AS (SELECT doc_id, rid, unnest(units) AS w FROM d),
b AS (SELECT *, row_number() OVER () AS uid, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM u WHERE len(w) BETWEEN 3 AND 150),
s AS (SELECT doc_id, rid, uid, w, licence, 2.0 * list_sum(list_transform(list_distinct(pairs), lambda p: least(len(list_filter(g, lambda x: x = p)), len(list_filter(pairs, lambda x: x = p))))) / (len(g) + len(pairs)) AS dice
  FROM b JOIN t ON len(g) BETWEEN ceil(len(pairs) * 0.8 / 1.2 - 1e-9) AND floor(len(pairs) * 1.2 / 0.8 + 1e-9)),
m AS (SELECT rid, uid, arg_min(licence, (-dice, licence)) AS licence, max(dice) AS dice FROM s GROUP BY rid, uid HAVING max(dice) >= 0.8 - 1e-12),
a AS (SELECT rid, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, max(dice) AS dice FROM m GROUP BY rid)
SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_matches, coalesce(licences, '') AS licences, round(dice, 6) AS best_dice FROM d LEFT JOIN a USING (rid)
"""


@query("op3_licenses", _licence_sql())
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.licenses import scan

    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    found = F.col("licences")
    return got.select(
        "doc_id", F.size(found).alias("n_matches"), F.array_join(F.array_distinct(found["licence"]), ",").alias("licences"), F.round(F.array_max(found["dice"]), 6).alias("best_dice")
    )


@query("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm import secrets

    forest = secrets.train(secrets.labelled_findings(spark))
    got = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", "source", forest)
    found = F.col("findings")
    true = F.filter(found, lambda f: f["secret"])
    return got.select(
        "doc_id", F.size(found).alias("n_candidates"), F.size(true).alias("n_secrets"), F.array_join(F.array_sort(F.array_distinct(true["kind"])), ",").alias("kinds"),
        F.round(F.array_max(found["probability"]), 6).alias("max_probability"), F.sha2("redacted", 256).alias("redacted_sha256"),
    )


#: Start of the derived captures, in seconds (fixed value).
CAPTURED = 1_700_000_000


def captures(pages: DataFrame) -> DataFrame:
    """Two records for each page: a full response, and a not-modified revisit half a minute later; of every fifth page the revisit has another tag."""
    tag = lambda c: F.concat(F.lit('"'), F.md5(F.coalesce(F.col(c), F.lit(""))), F.lit('"'))
    i, at = F.col("page_id"), F.lit(CAPTURED) + F.col("page_id") * 60
    size = F.octet_length(F.coalesce(F.col("html"), F.lit(""))).cast("string")
    full = F.concat(F.lit("Content-Type: text/html\r\nContent-Length: "), size, F.lit("\r\nETag: "), tag("html"), F.lit("\r\nDate: "), at.cast("string"))
    again = F.concat(F.lit("Content-Length: 0\r\nCache-Control: max-age="), (i % 100).cast("string"), F.lit("\r\nETag: W/"), F.when(i % 5 == 0, tag("url")).otherwise(tag("html")), F.lit("\r\nDate: "), (at + 30).cast("string"))
    record = lambda n, t, status, h: F.struct((i * 2 + n).alias("record_id"), t.alias("time"), F.lit(status).alias("status"), h.alias("headers"))
    return pages.select("url", F.explode(F.array(record(0, at, 200, full), record(1, at + 30, 304, again))).alias("r")).select("url", "r.*")


@query(
    "op8_warc",
    r"""
WITH h AS (SELECT page_id, html, url, regexp_replace(translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', '') AS host,
  regexp_replace(coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), ''), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), ''), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&') AS kept FROM pages),
c AS (SELECT page_id, CASE WHEN host <> '' THEN host || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical, 1700000000 + page_id * 60 AS t, '"' || md5(coalesce(html, '')) || '"' AS tag,
  '"' || md5(coalesce(url, '')) || '"' AS other, octet_length(encode(coalesce(html, ''))) AS n FROM h),
v AS (SELECT page_id * 2 + 1 AS record_id, canonical, t + 30 AS t, CASE WHEN page_id % 5 = 0 THEN other ELSE tag END AS tag, page_id % 100 AS age FROM c),
j AS (SELECT v.*, c.page_id * 2 AS found, c.tag AS theirs, c.n FROM v ASOF LEFT JOIN c ON v.canonical = c.canonical AND v.t > c.t)
SELECT record_id, canonical, CASE WHEN found IS NULL THEN 'no_response' WHEN tag = theirs THEN 'resolved' ELSE 'mismatch' END AS state, CASE WHEN tag = theirs THEN found END AS response_id,
  CASE WHEN tag = theirs THEN 'cache-control: max-age=' || age || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || t || chr(10) || 'etag: W/' || tag END AS headers FROM j
""",
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meshlake.llm.warc import resolve

    got = resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return got.select("record_id", "canonical", "state", "response_id", F.array_join(lines, "\n").alias("headers"))


from corpus_pipeline import run as _pipeline  # noqa: E402

QUERIES["pipeline"] = _pipeline
