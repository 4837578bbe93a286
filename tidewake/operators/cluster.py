"""Membership, quorum settings and what follows from them: configuration, fingerprints, placement reports, routing."""

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import quorum, ring

VNODES, CAPACITY = 64, 1000
#: Limits of a placement preview: nodes and replicas, virtual nodes, bytes of a request.
PREVIEW_NODES, PREVIEW_VNODES, PREVIEW_BYTES = 32, 128, 32 << 10
_ORIGIN = re.compile(r"https?://[^/?#@\s]+/?")


def _compact(value) -> str:
    """Compact JSON with <, > and & escaped, as fingerprints are taken of."""
    text = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


@dataclass(frozen=True)
class Cluster:
    """A node's view of a cluster. Quorums follow from the replicas where unset; what can't work raises ValueError."""

    node: str
    peers: dict
    n: int | None = None
    r: int | None = None
    w: int | None = None
    timeout_ms: int = 2000
    vnodes: int = VNODES
    capacity: int = CAPACITY
    nodes: tuple = field(init=False)

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        own = quorum.defaults(len(self.peers), self.n)
        for k in ("n", "r", "w"):
            if getattr(self, k) is None:
                put(k, own[k])
        quorum.validate(len(self.peers), self.n, self.r, self.w, self.timeout_ms)
        if not self.node or self.node not in self.peers:
            raise ValueError("the local node must be in the membership")
        for origin in self.peers.values():
            if not _ORIGIN.fullmatch(origin):
                raise ValueError(f"not a bare HTTP origin: {origin!r}")
        if "" in self.peers or self.vnodes <= 0:
            raise ValueError("ids must not be empty, virtual nodes positive")
        put("nodes", tuple((k, self.peers[k].rstrip("/")) for k in sorted(self.peers, key=lambda k: k.encode())))

    @property
    def members(self) -> list[str]:
        return [n for n, _ in self.nodes]

    def fingerprint(self) -> str:
        """SHA-256 of what all replicas must agree on; the deadline isn't part of it."""
        nodes = [{"id": k, "address": a} for k, a in self.nodes]
        return hashlib.sha256(_compact({"Protocol": 1, "Nodes": nodes, "Vnodes": self.vnodes, "N": self.n, "R": self.r, "W": self.w}).encode()).hexdigest()

    def owner_fingerprint(self) -> str:
        """The same of the single-owner protocol."""
        nodes = [{"id": k, "address": a} for k, a in self.nodes]
        return hashlib.sha256(_compact({"Nodes": nodes, "VirtualNodes": self.vnodes}).encode()).hexdigest()

    @classmethod
    def from_env(cls, env: dict) -> "Cluster":
        """From CACHE_* settings: an own membership needs CACHE_PEERS unless the listen address is the default."""
        node = env.get("CACHE_NODE_ID") or "node-a"
        peers = {node: "http://localhost:8080"}
        if raw := env.get("CACHE_PEERS"):
            peers = json.loads(raw)
            if not isinstance(peers, dict) or not all(isinstance(a, str) for a in peers.values()):
                raise ValueError("CACHE_PEERS must be an object of addresses")
        elif (env.get("CACHE_LISTEN_ADDR") or ":8080") != ":8080":
            raise ValueError("a listen address of one's own needs CACHE_PEERS")
        own = {}
        for name, key in (("CACHE_REPLICAS", "n"), ("CACHE_READ_QUORUM", "r"), ("CACHE_WRITE_QUORUM", "w")):
            if raw := env.get(name):
                if not re.fullmatch(r"[+-]?\d+", raw, re.ASCII):
                    raise ValueError(f"{name} must be an integer")
                own[key] = int(raw)
        return cls(node, peers, **own)


def report(spark: SparkSession, keys: DataFrame, cluster: Cluster) -> DataFrame:
    """Where keys (key) lie: key, mode, receiving_node, owner, key_position, replicas, virtual_nodes, read_quorum, write_quorum."""
    placed = ring.place(keys.select("key"), ring.points(spark, cluster.members, cluster.vnodes), cluster.n)
    return placed.select("key", F.lit("replicated").alias("mode"), F.lit(cluster.node).alias("receiving_node"), F.col("nodes")[0].alias("owner"), ring.position_number(F.col("pos")).alias("key_position"), F.col("nodes").alias("replicas"), F.lit(cluster.vnodes).alias("virtual_nodes"), F.lit(cluster.r).alias("read_quorum"), F.lit(cluster.w).alias("write_quorum"))


def preview(spark: SparkSession, request: str) -> tuple[int, DataFrame | None]:
    """(200, rows of node, idx, position, and the key's position and replicas) for a JSON request {key, nodes,
    virtual_nodes, replicas} about a membership that needn't exist, or (400, None)."""
    kinds = {"key": str, "nodes": list, "virtual_nodes": int, "replicas": int}
    try:
        if len(request.encode()) > PREVIEW_BYTES:
            return 400, None
        r = json.loads(request)
    except ValueError:
        return 400, None
    if not isinstance(r, dict) or not set(r) <= set(kinds) or not all(isinstance(v, kinds[k]) and not isinstance(v, bool) for k, v in r.items()):
        return 400, None
    nodes, vnodes, n = r.get("nodes", []), r.get("virtual_nodes", 0), r.get("replicas", 0)
    if not (1 <= len(nodes) <= PREVIEW_NODES and 1 <= vnodes <= PREVIEW_VNODES and 1 <= n <= PREVIEW_NODES) or not all(isinstance(x, str) for x in nodes):
        return 400, None
    try:
        points = ring.points(spark, nodes, vnodes)
    except ValueError:
        return 400, None
    key = spark.range(1).select(F.lit(r.get("key", "")).alias("key"))
    placed = ring.place(key, points, n).select(ring.position_number(F.col("pos")).alias("key_position"), F.col("nodes").alias("replicas"))
    return 200, ring.positions(points).join(F.broadcast(placed), F.lit(True)).orderBy("position", "node", "idx")


def fan_out(requests: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """requests (key, ...) with a row for each of the key's n replicas: node, rank from 1."""
    placed = ring.place(requests, points, n).drop("pos")
    return placed.select(*requests.columns, F.posexplode("nodes").alias("at", "node")).withColumn("rank", F.col("at") + 1).drop("at")


def owner_routing(requests: DataFrame, points: DataFrame, fingerprint: str) -> DataFrame:
    """The single-owner protocol: requests (node, key, internal, config, reachable, local_status) with owner, served_by, status.

    An internal call is refused with 409 unless its node owns the key and its config is the fingerprint. A public one is
    served where it arrives if that is the owner, else by the owner, or 503 if that can't be reached."""
    routed = ring.place(requests, points, 1).withColumn("owner", F.col("nodes")[0]).drop("pos", "nodes")
    own = F.col("owner") == F.col("node")
    refused = F.col("internal") & ~(own & F.coalesce(F.col("config") == fingerprint, F.lit(False)))
    lost = ~F.col("internal") & ~own & ~F.col("reachable")
    served = F.when(refused | lost, None).otherwise(F.col("owner"))
    return routed.withColumn("served_by", served).withColumn("status", F.when(refused, 409).when(lost, 503).otherwise(F.col("local_status")))


def replica_status(member: Column, config: Column, fingerprint: str, method: Column, records: Column, stored: Column) -> Column:
    """What a replica answers: 409 if it isn't one of the key's replicas or the caller's config differs; 503 if its store
    fails; 400 for a write without records or with records that can't be merged; else 200 for a read, 204 for a write.
    records: array of struct(id, clock, value, deleted, expires_us)."""
    bad = F.exists(records, lambda r: record_fault(r["id"], r["clock"], r["value"], r["deleted"], r["expires_us"]).isNotNull())
    reused = F.size(F.array_distinct(records)) != F.size(F.array_distinct(F.transform(records, lambda r: r["id"])))
    empty = records.isNull() | (F.size(records) == 0)
    refused = ~member | ~F.coalesce(config == fingerprint, F.lit(False))
    write = method == "PUT"
    return F.when(refused, 409).when(write & (empty | bad | reused), 400).when(~stored, 503).when(write, 204).otherwise(200)


def record_fault(id_: Column, clock: Column, value: Column, deleted: Column, expires_us: Column) -> Column:
    """Why a record is invalid, or null."""
    none = F.coalesce(id_, F.lit("")) == ""
    return (
        F.when(none, "id").when(~F.coalesce(F.array_contains(clock, id_), F.lit(False)), "clock")
        .when(deleted & ((F.coalesce(value, F.lit("")) != "") | expires_us.isNotNull()), "tombstone").when(F.array_contains(clock, ""), "context")
    )
