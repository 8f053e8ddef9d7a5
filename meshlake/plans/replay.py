"""Replay of an ordered mutation log over a snapshot, as set operations.

A mutation is (seq, op, id, dst, label, weight, vector, payload). Aggregates with map-side combine find each node's
last deletion, the insertion after it and the latest values since, so a node with very many mutations costs no
task more than its own partial rows. Insertions of live nodes and operations on missing ones have no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MUTATION = "seq long, op string, id long, dst long, label string, weight double, vector array<double>, payload string"


def _when(ops: tuple[str, ...], value, also=None):
    ok = F.col("op").isin(*ops)
    return F.when(ok if also is None else ok & also, value)


def nodes_after(base: DataFrame, log: DataFrame) -> DataFrame:
    """(id, vector, payload)."""
    start = base.select(F.lit(-1).cast("long").alias("seq"), F.lit("insert").alias("op"), "id", "vector", "payload")
    events = start.unionByName(log.where(F.col("op").isin("insert", "delete", "update_payload", "update_vector")).select("seq", "op", "id", "vector", "payload"))
    ends = events.groupBy("id").agg(F.max(_when(("delete",), F.col("seq"))).alias("gone"))
    since = events.join(ends, "id").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))

    def latest(column: str, op: str) -> list:
        v = F.struct(F.col(column).alias("v"))
        return [F.min_by(v, _when(("insert",), F.col("seq"))).alias(f"{column}0"), F.max_by(v, _when((op,), F.col("seq"))).alias(f"{column}1"), F.max(_when((op,), F.col("seq"))).alias(f"{column}_at")]

    got = since.groupBy("id").agg(F.min(_when(("insert",), F.col("seq"))).alias("born"), *latest("vector", "update_vector"), *latest("payload", "update_payload")).where("born IS NOT NULL")
    pick = lambda c: F.when(F.col(f"{c}_at") > F.col("born"), F.col(f"{c}1.v")).otherwise(F.col(f"{c}0.v")).alias(c)
    return got.select("id", pick("vector"), pick("payload"))


def edges_after(base: DataFrame, log: DataFrame, nodes: DataFrame) -> DataFrame:
    """(eid, src, dst, label, weight): links that no later unlink or deletion of an end removed."""
    linked = log.where("op = 'link'").select(F.col("seq").alias("eid"), F.col("id").alias("src"), "dst", "label", "weight", "seq")
    all_ = base.select("eid", "src", "dst", "label", "weight", F.lit(-1).cast("long").alias("seq")).unionByName(linked)
    cut = log.where("op = 'unlink'").groupBy(F.col("id").alias("src"), "dst").agg(F.max("seq").alias("cut"))
    gone = log.where("op = 'delete'").groupBy("id").agg(F.max("seq").alias("at"))
    live = all_.join(cut, ["src", "dst"], "left").where(F.col("cut").isNull() | (F.col("cut") < F.col("seq")))
    for end in ("src", "dst"):
        live = live.join(gone.select(F.col("id").alias(end), "at"), end, "left").where(F.col("at").isNull() | (F.col("at") < F.col("seq"))).drop("at")
        live = live.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return live.select("eid", "src", "dst", "label", "weight")
