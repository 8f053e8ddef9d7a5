"""Graphs, payloads and logs out of the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.session import table

#: Node kinds by number; an id is ``kind * 10**12 + key + 1`` (fixed values).
KINDS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6}


def node_id(kind: str, key: Column | str) -> Column:
    return (F.lit(KINDS[kind]) * F.lit(10**12).cast("long") + (F.col(key) if isinstance(key, str) else key).cast("long") + 1).cast("long")


#: kind: (table, key, payload field: column)
NODES = {
    "region": ("region", "r_regionkey", {"name": "r_name"}),
    "nation": ("nation", "n_nationkey", {"name": "n_name"}),
    "customer": ("customer", "c_custkey", {"name": "c_name", "segment": "c_mktsegment", "acctbal": "c_acctbal"}),
    "supplier": ("supplier", "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal"}),
    "part": ("part", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"}),
    "order": ("orders", "o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority", "total": "o_totalprice"}),
}


def star_nodes(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    """(id, payload) of the star schema's rows."""

    def of(kind: str) -> DataFrame:
        name, key, fields = NODES[kind]
        payload = F.to_json(F.struct(F.lit(kind).alias("kind"), *[F.col(c).alias(f) for f, c in fields.items()]), {"ignoreNullFields": "false"})
        return table(spark, sf_dir, name).select(node_id(kind, key).alias("id"), F.parse_json(payload).alias("payload"))

    return reduce(DataFrame.unionByName, map(of, kinds or KINDS))


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, label, weight)."""

    def of(name: str, src: Column, dst: Column, label: str, weight: Column | None = None, once: bool = False) -> DataFrame:
        e = table(spark, sf_dir, name).select(src.alias("src"), dst.alias("dst"), F.lit(label).alias("label"), (F.lit(1.0) if weight is None else weight).alias("weight"))
        return e.distinct() if once else e

    return reduce(
        DataFrame.unionByName,
        [
            of("nation", node_id("nation", "n_nationkey"), node_id("region", "n_regionkey"), "in_region"),
            of("customer", node_id("customer", "c_custkey"), node_id("nation", "c_nationkey"), "from_nation"),
            of("supplier", node_id("supplier", "s_suppkey"), node_id("nation", "s_nationkey"), "from_nation"),
            of("orders", node_id("customer", "o_custkey"), node_id("order", "o_orderkey"), "placed"),
            of("lineitem", node_id("order", "l_orderkey"), node_id("part", "l_partkey"), "contains", F.col("l_quantity") / 50),
            of("lineitem", node_id("part", "l_partkey"), node_id("supplier", "l_suppkey"), "supplied_by", once=True),
        ],
    )


def vector_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, label) of the embeddings."""
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("id"), F.col("embedding").alias("vector"), "label")


def ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, label, weight): two edges from each embedding, and an inhibition from every fifth."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"))
    n = e.count()
    to = lambda a, b: F.pmod(F.col("i") * a + b, F.lit(max(n, 1))) + 1
    made = F.array(
        F.struct(to(7, 1).alias("dst"), F.lit("related").alias("label"), F.lit(0.8).alias("weight")),
        F.struct(to(13, 5).alias("dst"), F.lit("related").alias("label"), F.lit(0.5).alias("weight")),
        F.when(F.col("i") % 5 == 0, F.struct(to(3, 2).alias("dst"), F.lit("inhibition").alias("label"), F.lit(0.3).alias("weight"))),
    )
    return e.select((F.col("i") + 1).alias("src"), F.explode(made).alias("e")).where("e IS NOT NULL").select("src", "e.*")


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, payload): k, type, value, flag, tags (0 to 3 of them) and opt, which is missing, null or a number."""
    i = F.col("event_id")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    tags = F.slice(F.array(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')), F.lit('"a"'), F.lit('"b"')), F.lit(1), F.coalesce(i % 4, F.lit(0)).cast("int"))
    opt = F.when(i % 9 == 0, ',"opt":null').when(i % 3 == 0, ',"opt":7').otherwise("")
    json = F.concat(
        F.lit('{"k":'), text(F.get_json_object("props", "$.k")), F.lit(',"type":"'), text(F.col("event_type")), F.lit('","value":'), text(F.col("value")),
        F.lit(',"flag":'), text(i % 2 == 0), F.lit(',"tags":['), F.array_join(tags, ","), F.lit("]"), opt, F.lit("}"),
    )
    return table(spark, sf_dir, "events").select((i + 1).alias("id"), F.parse_json(json).alias("payload"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations of orders: inserted, every third updated, every seventh deleted and every 49th inserted again; linked from their customers."""
    k = F.col("o_orderkey")
    customers = table(spark, sf_dir, "customer").select(node_id("customer", "c_custkey").alias("id"))
    orders = table(spark, sf_dir, "orders")
    op = lambda seq, name, node, when=None, dst=None, payload=None, label=None: F.when(F.lit(True) if when is None else when, F.struct(
        F.lit(seq).cast("long").alias("seq") if isinstance(seq, int) else seq.cast("long").alias("seq"), F.lit(name).alias("op"), node.alias("id"),
        (F.lit(None).cast("long") if dst is None else dst).alias("dst"), F.lit(label).cast("string").alias("label"), F.lit(1.0).alias("weight"),
        F.lit(None).cast("array<double>").alias("vector"), (F.lit(None).cast("string") if payload is None else payload).alias("payload")))
    stage = lambda n: F.lit(n * 10**12).cast("long") + k
    me, who = node_id("order", "o_orderkey"), node_id("customer", "o_custkey")
    steps = F.array(
        op(stage(1), "insert", me, payload=F.col("o_orderstatus")), op(stage(2), "link", who, dst=me, label="placed"), op(stage(3), "update_payload", me, k % 3 == 0, payload=F.lit("updated")),
        op(stage(4), "unlink", who, k % 11 == 0, dst=me), op(stage(5), "delete", me, k % 7 == 0), op(stage(6), "insert", me, k % 49 == 0, payload=F.lit("again")),
    )
    first = customers.select(op(1, "insert", F.col("id"), payload=F.lit("customer")).alias("m"))
    return first.union(orders.select(F.explode(steps).alias("m"))).where("m IS NOT NULL").select("m.*")
