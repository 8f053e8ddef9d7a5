"""WARC revisits: not-modified records resolved to the full response that they stand for.

Records are captures of a URL at a time: full responses (status 200) and not-modified revisits (status 304). A
revisit is joined as of its time to the latest earlier full response of its canonical URL. Its validator must agree
with the response's: the entity tags by weak comparison if both have one, else the Last-Modified texts if both have
one. A revisit that agrees gets the response's headers, in which it replaces those that a 304 may update.

The as-of join sorts once: records are dealt by ranges of (URL, time, record), so a URL with a third of all rows is
spread over many tasks, and a window finds the response within a range. What a URL brings in from earlier ranges is
one row for each range that starts within a URL, fewer than there are partitions, which bounds the broadcast.

Edge cases: a null URL, one without a host or a null time has no response (``no_response``). Equal times are ordered
by record id. Records of other statuses are neither sources nor results. Without a validator on both sides the state is
``no_validator``; where they differ, ``mismatch``: the latest earlier response only is asked, not those before it.
Null headers are empty. Repeated revisits each get their row. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshlake.llm.common import durable
from meshlake.llm.url_filter import canonical_of

FULL, NOT_MODIFIED = 200, 304
#: Headers that a 304 doesn't replace: they describe the body or the connection (fixed values, HTTP caching standard).
KEPT_HEADERS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]


def parse_headers(block: Column) -> Column:
    """array<struct<name, value>> of a header block: names in lower case, lines without a colon left out."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: F.instr(x, ":") > 1)
    at = lambda x: F.instr(x, ":")
    return F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring(x, F.lit(1), at(x) - 1))).alias("name"), F.trim(F.substring(x, at(x) + 1, F.length(x))).alias("value")))


def header(headers: Column, name: str) -> Column:
    """The first value of a header; null if there is none."""
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def merge_headers(stored: Column, update: Column) -> Column:
    """The stored headers with those of the update that are permitted, in order of name and value."""
    new = F.filter(update, lambda h: ~h["name"].isin(KEPT_HEADERS))
    names = F.transform(new, lambda h: h["name"])
    return F.array_sort(F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["name"])), new))


def as_of(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the last value that isn't null of the rows of the same key that come before in ``order``."""
    ranged = durable(df.repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id()))
    ends = ranged.groupBy(key, "__range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__end"))
    before = W.partitionBy(key).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    brought = ends.withColumn("__brought", F.last("__end", ignorenulls=True).over(before)).where("__brought IS NOT NULL").select(F.col(key).alias("__key"), F.col("__range").alias("__in"), "__brought")
    within = W.partitionBy(key, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    got = ranged.withColumn("__own", F.last(value, ignorenulls=True).over(within))
    got = got.join(F.broadcast(brought), (F.col(key) == F.col("__key")) & (F.col("__range") == F.col("__in")), "left")
    return got.withColumn(out, F.coalesce("__own", "__brought")).drop("__own", "__brought", "__key", "__in", "__range")


def resolve(records: DataFrame, record: str = "record_id", url: str = "url", time: str = "time", status: str = "status", headers: str = "headers") -> DataFrame:
    """(record_id, canonical, time, state, response_id, headers) of each not-modified record; ``headers`` is an array."""
    r = records.select(F.col(record).alias("record_id"), canonical_of(F.col(url)).alias("canonical"), F.col(time).alias("time"), F.col(status).cast("int").alias("status"), F.coalesce(F.col(headers), F.lit("")).alias("block"))
    r = r.where(F.col("status").isin(FULL, NOT_MODIFIED))
    known = F.col("canonical").isNotNull() & F.col("time").isNotNull()
    full = F.when(F.col("status") == FULL, F.struct(F.col("record_id").alias("id"), F.col("block").alias("block")))
    joined = as_of(r.where(known).withColumn("full", full), "canonical", ["time", "record_id", "status", "block"], "full", "found").drop("full")
    alone = r.where(~known).withColumn("found", F.lit(None).cast(joined.schema["found"].dataType))
    got = joined.unionByName(alone).where(F.col("status") == NOT_MODIFIED)
    got = got.withColumns({"own": parse_headers(F.col("block")), "theirs": parse_headers(F.col("found.block"))})
    tag = lambda h: F.regexp_replace(header(F.col(h), "etag"), "^W/", "")
    same = F.coalesce(tag("own") == tag("theirs"), header(F.col("own"), "last-modified") == header(F.col("theirs"), "last-modified"))
    state = F.when(F.col("found").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
    got = got.withColumn("state", state)
    ok = F.col("state") == "resolved"
    return got.select("record_id", "canonical", "time", "state", F.when(ok, F.col("found.id")).alias("response_id"), F.when(ok, merge_headers(F.col("theirs"), F.col("own"))).alias("headers"))
