"""A store of nodes and edges: Parquet snapshots, an append-only mutation log and a manifest that is claimed atomically.

``<path>/snapshots/N/{nodes,edges}`` hold a state, ``<path>/manifests/N`` (created once, never overwritten) names the
last mutation in it, and ``<path>/log`` has one Parquet folder for each transaction, which counts once ``<path>/commits`` has its
claim: a file named by its first mutation, created once. Of two writers that go on from the same state one is therefore refused. A
state is the newest snapshot with the mutations after its watermark replayed; a crash between any two steps leaves the state as it
was. All files are reached through Spark and its file systems, so a store can be wherever Spark can write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.errors import DimensionMismatch, NodeNotFound, StoreError
from meshlake.operators import graph, paths, predicates, search
from meshlake.plans import replay

NODE, EDGE = "id long, vector array<double>, payload string", "eid long, src long, dst long, label string, weight double"
SYNC_MODES, STORAGE_MODES, DTYPES = ("full", "normal", "off"), ("mmap", "rom"), ("f32", "f16", "u64")


class Files:
    """What a store needs of a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def create(self, file: str, text: str) -> bool:
        """False if the file is there."""
        p = self._path(file)
        if self.fs.exists(p):
            return False
        try:
            out = self.fs.create(p, False)
        except Exception:
            if self.fs.exists(p):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


class Transaction:
    """Operations that take effect together on ``commit``, or not at all."""

    def __init__(self, store: GraphStore):
        self.store, self.ops, self.done = store, [], False

    def _add(self, op: str, **row) -> None:
        if self.done:
            raise StoreError("the transaction is over")
        self.ops.append({"op": op, **row})

    def insert(self, vector: Sequence[float], payload: dict) -> None:
        self._add("insert", id=None, vector=list(vector), payload=json.dumps(payload))

    def insert_with_id(self, node: int, vector: Sequence[float], payload: dict) -> None:
        self._add("insert", id=node, vector=list(vector), payload=json.dumps(payload))

    def link(self, src: int, dst: int, label: str = "related", weight: float = 1.0) -> None:
        self._add("link", id=src, dst=dst, label=label, weight=float(weight))

    def unlink(self, src: int, dst: int) -> None:
        self._add("unlink", id=src, dst=dst)

    def delete(self, node: int) -> None:
        self._add("delete", id=node)

    def update_payload(self, node: int, payload: dict) -> None:
        self._add("update_payload", id=node, payload=json.dumps(payload))

    def update_vector(self, node: int, vector: Sequence[float]) -> None:
        self._add("update_vector", id=node, vector=list(vector))

    def pending_count(self) -> int:
        return len(self.ops)

    def rollback(self) -> None:
        self.ops, self.done = [], True

    def commit(self) -> list[int]:
        """The ids of its insertions, in their order."""
        ids = self.store._commit(self.ops)
        self.ops, self.done = [], True
        return ids


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, dim: int = 1536, dtype: str = "f32", sync_mode: str = "normal", storage_mode: str = "mmap"):
        if dtype not in DTYPES or storage_mode not in STORAGE_MODES:
            raise ValueError(f"dtype is one of {DTYPES}, storage_mode of {STORAGE_MODES}")
        self.spark, self.path, self.dtype = spark, path.rstrip("/"), dtype
        self.set_sync_mode(sync_mode)
        self.files = Files(spark, path)
        if not self.files.names(f"{self.path}/manifests"):
            self._snapshot(spark.createDataFrame([], self._ddl(NODE)), spark.createDataFrame([], EDGE), 0, {"dim": dim, "dtype": dtype, "next_id": 1, "seq": 0})
        self._open()

    # state

    def _ddl(self, schema: str) -> str:
        """Words of 64 bits are stored as their two's complement."""
        return schema.replace("array<double>", "array<long>") if self.dtype == "u64" else schema

    def _open(self) -> None:
        self.version = max(int(n) for n in self.files.names(f"{self.path}/manifests") if n.isdigit())
        meta = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{self.version}").collect()))
        self._dim, self.dtype, self._next, self._seq, self._watermark = meta["dim"], meta["dtype"], meta["next_id"], meta["seq"], meta["seq"]
        log = self.log(known=False)
        last = log.agg(F.max("seq"), F.max(F.when(F.col("op") == "insert", F.col("id")))).first()
        self._seq, self._next = max(self._seq, last[0] or 0), max(self._next, (last[1] or 0) + 1)

    def _snapshot(self, nodes: DataFrame, edges: DataFrame, version: int, meta: dict) -> None:
        folder = f"{self.path}/snapshots/{version}"
        self.files.remove(folder)
        nodes.select("id", "vector", "payload").write.parquet(f"{folder}/nodes")
        edges.write.parquet(f"{folder}/edges")
        if not self.files.create(f"{self.path}/manifests/{version}", json.dumps(meta)):
            raise StoreError(f"snapshot {version} was written by another process")

    def log(self, known: bool = True) -> DataFrame:
        """The mutations after the snapshot, up to the last one that this store knows of or to the last one there is."""
        claims = [f"{self.path}/commits/{n}" for n in self.files.names(f"{self.path}/commits") if n.isdigit() and int(n) > self._watermark and (not known or int(n) <= self._seq)]
        commits = [r[0] for r in self.spark.read.text(claims).collect()] if claims else []
        if not commits:
            return self.spark.createDataFrame([], self._ddl(replay.MUTATION))
        return self.spark.read.schema(self._ddl(replay.MUTATION)).parquet(*[f"{self.path}/log/{n}" for n in commits])

    def _publish(self, rows: list[tuple]) -> None:
        """Write a commit and claim its first sequence number; of two writers that start from the same state one is refused."""
        first, last = rows[0][0], rows[-1][0]
        name, claim = f"{first}-{last}-{uuid.uuid4().hex}", f"{self.path}/commits/{first}"
        self.spark.createDataFrame(rows, self._ddl(replay.MUTATION)).coalesce(1).write.parquet(f"{self.path}/log/{name}")
        mine = self.files.create(claim, name)
        # A snapshot of another process takes claims away after its manifest is there.
        if not mine or any(n.isdigit() and int(n) > self.version for n in self.files.names(f"{self.path}/manifests")):
            for x in [f"{self.path}/log/{name}"] + [claim] * mine:
                self.files.remove(x)
            raise StoreError(f"another writer has gone on from mutation {first - 1}: open the store again")

    def _read(self, what: str) -> DataFrame:
        return self.spark.read.schema(self._ddl(NODE) if what == "nodes" else EDGE).parquet(f"{self.path}/snapshots/{self.version}/{what}")

    def raw_nodes(self) -> DataFrame:
        """(id, vector, payload as JSON text)."""
        return self._read("nodes") if self._seq == self._watermark else replay.nodes_after(self._read("nodes"), self.log())

    def nodes(self) -> DataFrame:
        """(id, vector, payload as a variant)."""
        return self.raw_nodes().withColumn("payload", F.parse_json("payload"))

    def edges(self) -> DataFrame:
        return self._read("edges") if self._seq == self._watermark else replay.edges_after(self._read("edges"), self.log(), self.raw_nodes())

    # mutations

    def _existing(self, ids: Iterable[int]) -> set[int]:
        wanted = sorted(set(ids))
        return {r[0] for r in self.raw_nodes().where(F.col("id").isin(wanted)).select("id").collect()} if wanted else set()

    def _round(self, v: Sequence[float]) -> list[float]:
        if len(v) != self._dim:
            raise DimensionMismatch(self._dim, len(v))
        if self.dtype == "f16":
            import numpy as np

            return [float(x) for x in np.asarray(v, np.float16)]
        if self.dtype == "u64":
            return [int(x) - (1 << 64) if int(x) >> 63 else int(x) for x in v]
        return [float(x) for x in v]

    def _commit(self, ops: list[dict]) -> list[int]:
        """Check the operations in order against the state that they lead to, then write them as one commit."""
        if not ops:
            return []
        alive = self._existing(i for o in ops for i in (o.get("id"), o.get("dst")) if i is not None)
        next_id, ids, rows, new = self._next, [], [], set()
        known = lambda i: i in alive or i in new
        for o in ops:
            o = dict(o)
            if o.get("vector") is not None:
                o["vector"] = self._round(o["vector"])
            if o["op"] == "insert":
                if o["id"] is None:
                    o["id"] = next_id
                elif known(o["id"]):
                    raise StoreError(f"node {o['id']} exists")
                elif not 0 < o["id"] < 1 << 63:
                    raise StoreError(f"no valid id: {o['id']}")
                next_id = max(next_id, o["id"] + 1)
                new.add(o["id"])
                ids.append(o["id"])
            else:
                for end in ("id", "dst") if o["op"] in ("link",) else ("id",):
                    if not known(o[end]):
                        raise NodeNotFound(o[end])
                if o["op"] == "delete":
                    alive.discard(o["id"])
                    new.discard(o["id"])
            self_seq = self._seq + len(rows) + 1
            rows.append((self_seq, o["op"], o["id"], o.get("dst"), o.get("label"), o.get("weight"), o.get("vector"), o.get("payload")))
        self._publish(rows)
        self._seq, self._next = rows[-1][0], next_id
        return ids

    def begin_tx(self) -> Transaction:
        return Transaction(self)

    def _one(self, op: str, *args) -> list[int]:
        tx = self.begin_tx()
        getattr(tx, op)(*args)
        return tx.commit()

    def insert(self, vector: Sequence[float], payload: dict) -> int:
        return self._one("insert", vector, payload)[0]

    def insert_with_id(self, node: int, vector: Sequence[float], payload: dict) -> None:
        self._one("insert_with_id", node, vector, payload)

    def batch_insert(self, vectors: Sequence[Sequence[float]], payloads: Sequence[dict]) -> list[int]:
        if len(vectors) != len(payloads):
            raise ValueError("vectors and payloads differ in length")
        tx = self.begin_tx()
        for v, p in zip(vectors, payloads, strict=True):
            tx.insert(v, p)
        return tx.commit()

    def batch_insert_with_ids(self, ids: Sequence[int], vectors: Sequence[Sequence[float]], payloads: Sequence[dict]) -> None:
        if not len(ids) == len(vectors) == len(payloads):
            raise ValueError("ids, vectors and payloads differ in length")
        tx = self.begin_tx()
        for i, v, p in zip(ids, vectors, payloads, strict=True):
            tx.insert_with_id(i, v, p)
        tx.commit()

    def update_payload(self, node: int, payload: dict) -> None:
        self._one("update_payload", node, payload)

    def update_vector(self, vector: Sequence[float], node: int) -> None:
        self._one("update_vector", node, vector)

    def delete(self, node: int) -> None:
        self._one("delete", node)

    def link(self, src: int, dst: int, label: str = "related", weight: float = 1.0) -> None:
        self._one("link", src, dst, label, weight)

    def unlink(self, src: int, dst: int) -> None:
        self._one("unlink", src, dst)

    def flush(self) -> None:
        """Write a snapshot, then drop what it has replaced."""
        if self._seq == self._watermark:
            return
        old, watermark = self.version, self._seq
        self._snapshot(self.raw_nodes(), self.edges(), old + 1, {"dim": self._dim, "dtype": self.dtype, "next_id": self._next, "seq": watermark})
        for folder, last in (("commits", 0), ("log", 1)):
            for n in self.files.names(f"{self.path}/{folder}"):
                if (x := n.split("-"))[0].isdigit() and int(x[last]) <= watermark:
                    self.files.remove(f"{self.path}/{folder}/{n}")
        self.version, self._watermark = old + 1, watermark
        self.files.remove(f"{self.path}/snapshots/{old}")

    compact = flush

    def close(self) -> None:
        self.flush()

    def __enter__(self) -> GraphStore:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def migrate(self, path: str, dim: int) -> list[int]:
        """A store of another dimension with zero vectors; its ids."""
        nodes, edges = graph.migrate(self.raw_nodes(), self.edges(), dim)
        other = GraphStore(self.spark, path, dim, self.dtype)
        other._snapshot(nodes.withColumn("vector", F.col("vector").cast("array<long>" if self.dtype == "u64" else "array<double>")), edges, other.version + 1, {"dim": dim, "dtype": self.dtype, "next_id": self._next, "seq": self._seq})
        return [r[0] for r in nodes.select("id").orderBy("id").collect()]

    # reads

    def get(self, node: int) -> dict | None:
        row = self.raw_nodes().where(F.col("id") == node).first()
        return row and {"id": row.id, "vector": list(row.vector), "payload": json.loads(row.payload), "edges": self.get_edges(node)}

    def get_payload(self, node: int) -> dict | None:
        row = self.raw_nodes().where(F.col("id") == node).select("payload").first()
        return row and json.loads(row.payload)

    def get_edges(self, node: int) -> list[dict]:
        rows = self.edges().where(F.col("src") == node).orderBy("eid").collect()
        return [{"target_id": r.dst, "label": r.label, "weight": r.weight} for r in rows]

    def neighbors(self, node: int, depth: int = 1) -> DataFrame:
        return graph.neighbors(self.edges(), node, depth)

    def all_node_ids(self) -> DataFrame:
        return self.raw_nodes().select("id")

    def node_count(self) -> int:
        return self.raw_nodes().count()

    __len__ = node_count

    def contains(self, node: int) -> bool:
        return bool(self._existing([node]))

    __contains__ = contains

    def dim(self) -> int:
        return self._dim

    def filter(self, key: str, value: object) -> DataFrame:
        return predicates.filter_where(self.nodes(), {key: {"$eq": value}})

    def filter_where(self, condition: dict) -> DataFrame:
        return predicates.filter_where(self.nodes(), condition)

    def query(self, text: str) -> DataFrame:
        return paths.run(text, self.nodes().select("id", "payload"), self.edges())

    def texts(self) -> DataFrame:
        """(id, text): the top-level strings of each payload, in order of their keys."""
        entries = F.array_sort(F.map_entries(F.from_json("payload", "map<string,string>")))
        # Only values that are strings in the payload: quoted, as JSON text, unlike numbers or objects.
        typed = F.map_entries(F.try_variant_get(F.parse_json("payload"), "$", "map<string,variant>"))
        strings = F.transform(F.filter(typed, lambda e: F.schema_of_variant(e["value"]) == "STRING"), lambda e: e["key"])
        kept = F.filter(entries, lambda e: F.array_contains(strings, e["key"]))
        return self.raw_nodes().select("id", F.array_join(F.transform(kept, lambda e: e["value"]), " ").alias("text"))

    def search(self, query: Sequence[float], top_k: int = 5, expand_depth: int = 0, min_score: float = 0.5) -> DataFrame:
        return self.search_advanced(query, search.SearchConfig(top_k=top_k, expand_depth=expand_depth, min_score=min_score))

    def search_advanced(self, query: Sequence[float] | None, config: search.SearchConfig, query_text: str | None = None, texts: DataFrame | None = None, keywords: DataFrame | None = None) -> DataFrame:
        """(id, score, payload)."""
        if query is not None:
            search.check_query(query, self._dim)
        nodes = self.raw_nodes()
        got = search.search(nodes, self.edges(), query, config, query_text, texts, keywords, self.dtype)
        return got.join(nodes.select("id", F.parse_json("payload").alias("payload")), "id").orderBy(F.desc("score"), "id")

    def search_hybrid(self, query: Sequence[float], query_text: str, texts: DataFrame, top_k: int = 5, expand_depth: int = 2, min_score: float = 0.1, hybrid_alpha: float = 0.7, keywords: DataFrame | None = None) -> DataFrame:
        boost = max(1 - hybrid_alpha, 0.1) * 3
        config = search.SearchConfig(top_k=top_k, expand_depth=expand_depth, min_score=min_score, text_boost=boost, enable_text_hybrid_search=True)
        return self.search_advanced(query, config, query_text, texts, keywords)

    def set_sync_mode(self, mode: str) -> None:
        """Checked only: a commit is always durable once written."""
        if mode not in SYNC_MODES:
            raise ValueError(f"sync_mode is one of {SYNC_MODES}")
        self.sync_mode = mode

    def __repr__(self) -> str:
        return f"GraphStore({self.path!r}, dim={self._dim}, dtype={self.dtype!r})"
