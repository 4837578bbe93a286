"""Operators on small fixtures: rings, merges, folds, quorums, configuration, files, streams."""

import json
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tidewake.operators import causal, cluster, fold, quorum, requests, ring, validate
from tidewake.sources import shared, wal
from tidewake.streaming import siblings

RECORD = "key string, id string, clock array<string>, value string, deleted boolean, expires_us long"


def records(spark, rows):
    return spark.createDataFrame([(k, i, sorted(c), v, v is None, x) for k, i, c, v, x in rows], RECORD)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_ring(spark):
    for members, vnodes in (([""], 1), (["a", "a"], 1), (["a"], 0), (["a"], -1)):
        with pytest.raises(ValueError):
            ring.points(spark, members, vnodes)
    bare = spark.createDataFrame([("x", 0, "20"), ("y", 0, "50"), ("z", 0, "80")], "node string, idx int, pos string")
    prefs = {r["rn"]: (r["lo"], r["hi"], r["nodes"]) for r in ring.preferences(bare).collect()}
    assert prefs == {1: (None, "20", ["x", "y", "z"]), 2: ("20", "50", ["y", "z", "x"]), 3: ("50", "80", ["z", "x", "y"])}
    keys = spark.createDataFrame([(f"key-{i}",) for i in range(300)], "key string")
    empty = ring.points(spark, ["a"]).limit(0)
    assert ring.place(keys, empty).count() == 0
    one = ring.place(keys, ring.points(spark, ["solo"]), 3).collect()
    assert len(one) == 300 and all(r["nodes"] == ["solo"] for r in one)
    assert all(r["nodes"] == [] for r in ring.place(keys, ring.points(spark, ["a", "b"]), 0).collect())
    sides = [{r["key"]: r["nodes"] for r in ring.place(keys, ring.points(spark, m), 2).collect()} for m in (["a", "b", "c"], ["c", "a", "b"])]
    assert sides[0] == sides[1] and all(len(set(n)) == 2 for n in sides[0].values())
    moved = ring.movement(keys, ring.points(spark, ["a", "b", "c"]), ring.points(spark, ["a", "b", "c", "d"])).collect()
    assert moved and all(r["new"] == "d" for r in moved)
    assert all(r["old"] == "b" for r in ring.movement(keys, ring.points(spark, ["a", "b", "c"]), ring.points(spark, ["a", "c"])).collect())


def test_merge(spark):
    a, b, c = ("k", "a", ["a"], "1", None), ("k", "b", ["a", "b"], "2", None), ("k", "c", ["a", "c"], "3", None)
    d, e = ("k", "d", ["a", "b", "c", "d"], None, None), ("k", "e", ["a", "b", "c", "d", "e"], "4", None)
    for rows, want in (([a, b, c], ["b", "c"]), ([c, b, a, a], ["b", "c"]), ([a, b, c, d], ["d"]), ([d, e, a], ["e"]), ([], [])):
        assert ids(causal.maximal(records(spark, rows))) == want
    # An expired record still bars what it has seen; a partial context bars nothing that it doesn't hold.
    assert ids(causal.maximal(records(spark, [a, ("k", "x", ["a", "x"], "old", 1)]))) == ["x"]
    assert ids(causal.maximal(records(spark, [b, ("k", "y", ["b", "y"], "5", None)]))) == ["b", "y"]
    for odd in (("k", "a", ["a"], "other", None), ("k", "a", ["a"], "1", 5), ("k", "a", ["a", "z"], "1", None), ("k", "a", ["a"], None, None)):
        both = records(spark, [a, odd])
        with pytest.raises(Exception, match="reused with different contents"):
            causal.maximal(both).collect()
        assert [(r["id"], r["versions"]) for r in causal.conflicts(both).collect()] == [("a", 2)]
        one, two = causal.maximal(both, strict=False).collect(), causal.maximal(records(spark, [odd, a]), strict=False).collect()
        assert one == two and len(one) == 1


def test_merge_is_algebra(spark):
    rng = random.Random(3)
    for _ in range(4):
        rows = [("k", f"r{i}", [f"r{i}", *{f"r{rng.randrange(12)}" for _ in range(rng.randrange(4))}], "v", None) for i in range(12)]
        part = [r for r in rows if rng.random() < 0.6]
        whole = ids(causal.maximal(records(spark, rows)))
        merged = causal.maximal(records(spark, part)).unionByName(causal.maximal(records(spark, [r for r in rows if r not in part])))
        assert ids(causal.maximal(merged)) == whole
        want = [r[1] for r in rows if not any(len(set(o[2])) > len(set(r[2])) and set(r[2]) <= set(o[2]) for o in rows)]
        assert whole == sorted(want)


def test_deliveries(spark):
    rows = [(0, 1, "k", "a", ["a"]), (0, 2, "k", "a", ["a"]), (0, 3, "k", "b", ["a", "b"]), (0, 4, "k", "a", ["a"]), (0, 5, "n", "c", ["c"]), (0, 6, "n", "c", ["c"]), (0, 7, "k", "d", ["d"]), (0, 7, "k", "a", ["a"]), (1, 1, "n", "c", ["c"])]
    log = spark.createDataFrame(rows, "store long, seq long, key string, id string, clock array<string>")
    got = {(r["store"], r["seq"]): r["outcome"] for r in causal.deliveries(log, 1).collect()}
    assert got == {(0, 1): "stored", (0, 2): "unchanged", (0, 3): "stored", (0, 4): "unchanged", (0, 5): "rejected", (0, 6): "rejected", (0, 7): "stored", (1, 1): "stored"}
    assert {r["outcome"] for r in causal.deliveries(log.where("key = 'n'")).collect()} == {"stored", "unchanged"}


def trace(spark, kind, capacity, *ops):
    rows = [(0, i, op, key, at, ttl) for i, (op, key, at, ttl) in enumerate(ops)]
    log = spark.createDataFrame(rows, "store long, seq long, op string, key string, at_us long, ttl_us long")
    return [(r["outcome"], r["size"], r["status"]) for r in fold.responses(kind(log, capacity)).orderBy("seq").collect()]


def test_bounded_stores(spark):
    got = trace(spark, fold.durable, 1, ("put", "a", 0, 0), ("put", "b", 1, 0), ("put", "a", 2, 5), ("get", "b", 7, 0), ("put", "b", 7, 0), ("delete", "z", 8, 0))
    assert got == [("stored", 1, 204), ("rejected", 1, 507), ("stored", 1, 204), ("miss", 1, 404), ("stored", 1, 204), ("absent", 1, 204)]
    # A get drops its own key only; a key that was put again isn't dropped by its earlier expiry.
    got = trace(spark, fold.durable, 0, ("put", "a", 0, 5), ("put", "b", 0, 5), ("get", "a", 9, 0), ("put", "c", 9, 0), ("put", "c", 9, 1), ("put", "c", 9, 0), ("put", "d", 20, 0))
    assert [s for _, s, _ in got] == [1, 2, 1, 1, 1, 1, 2]
    got = trace(spark, fold.lru, 2, ("put", "a", 0, 0), ("put", "b", 1, 0), ("get", "a", 2, 0), ("put", "c", 3, 0), ("get", "b", 4, 0), ("get", "a", 5, 0))
    assert [o for o, *_ in got] == ["stored", "stored", "hit", "evicted", "miss", "hit"]


def gets_and_puts(spark, n):
    """A log of 2 stores, out of order, and its rows."""
    rng = random.Random(3)
    rows = [(i % 2, i, rng.choice(["get", "get", "put", "delete"]), f"k{rng.randrange(6)}", i, rng.choice([0, 0, 4])) for i in range(n)]
    return spark.createDataFrame(rng.sample(rows, n), "store long, seq long, op string, key string, at_us long, ttl_us long"), rows


def folded(rows, step, capacity):
    held, out = [OrderedDict(), OrderedDict()], {}
    for store, seq, op, key, at, ttl in rows:
        out[seq] = (step(held[store], op, key, at, at + ttl if ttl else None, capacity), len(held[store]) - (None in held[store]))
    return out


@pytest.mark.parametrize("kind, step", [(fold.lru, fold._lru), (fold.durable, fold._durable)])
def test_folds_are_streams(spark, kind, step):
    log, rows = gets_and_puts(spark, 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a store goes on from batch to batch
    try:
        got = kind(log, 3)
        assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r["seq"]: (r["outcome"], r["size"]) for r in got.collect()} == folded(rows, step, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hit_rate_is_of_a_stream(spark, tmp_path):
    from tidewake.plans import queries

    spark.sql("select id as event_id, timestamp_micros(id * 1000) as ts, id % 8 as user_id, case when id % 5 = 0 then 'signup' else 'view' end as event_type from range(500)").write.parquet(f"{tmp_path}/events.parquet")
    got = queries.lru_hit_rate(spark, f"file://{tmp_path}")
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["store"], r["gets"]) for r in got.collect()) == [(s, 100) for s in range(4)]


def test_expiries_of_a_durable_store_are_bounded():
    held = OrderedDict()
    for i in range(10_000):
        assert fold._durable(held, "put", f"k{i % 3}", i, i + 10**9, 3) == "stored"
    assert len(held[None]) < 100 and fold._durable(held, "put", "new", 2 * 10**9, None, 3) == "stored" and len(held) == 2


def test_reads_and_writes(spark):
    r, s, t = ("k", "r", ["r"], "one", 100), ("k", "s", ["s"], "two", None), ("gone", "t", ["t"], None, None)
    state = records(spark, [r, s, t]).withColumn("rank", F.when(F.col("id") == "s", 2).otherwise(1))
    replies = lambda *ok: spark.createDataFrame([(k, i, i * 10, i in ok) for k in ("k", "gone", "new") for i in (1, 2, 3)], "key string, rank int, arrival_ms int, ok boolean")
    status = lambda now, *ok: {x["key"]: (x["status"], x["value"]) for x in quorum.read(state, replies(*ok), 2, now).collect()}
    assert status(99, 1, 2) == {"k": (409, None), "gone": (404, None), "new": (404, None)}
    assert status(99, 1, 3) == {"k": (200, "one"), "gone": (404, None), "new": (404, None)}
    assert status(100, 1, 3)["k"] == (404, None)
    assert status(100, 1, 2)["k"] == (409, None)  # a live value beside an expired one is still a conflict
    assert {x[0] for x in status(0, 3).values()} == {503}
    bodies = [("k", "{}", 400), ("k", '{"value":"x"}', 409), ("k", '{"value":"x","context":{}}', 204), ("k", '{"value":"x","context":{"r":1,"s":1},"ttl_ms":2}', 204), ("new", '{"value":"x","context":null}', 204), ("gone", '{"value":"x"}', 204)]
    asked = spark.createDataFrame([(i, "a", k, "PUT", b, 1000) for i, (k, b, _) in enumerate(bodies)], "req_id long, node string, key string, method string, body string, at_us long")
    got = {x["req_id"]: x for x in requests.apply_mutations(asked, state, replies(1, 2), replies(1, 3), 2, 2).collect()}
    assert [got[i]["status"] for i in range(6)] == [w for *_, w in bodies]
    assert got[2]["clock"] == [got[2]["id"]] and set(got[3]["clock"]) == {"r", "s", got[3]["id"]} and got[3]["expires_us"] == 3000 and got[2]["expires_us"] is None
    assert set(got[5]["clock"]) == {"t", got[5]["id"]} and got[0]["id"] is None and got[1]["stored"] is None and got[2]["stored"] == [1, 3]
    failed = requests.apply_mutations(asked, state, replies(1, 2), replies(3), 2, 2)
    assert {x["status"] for x in failed.where("req_id = 2").collect()} == {503}
    left = requests.effects(failed)
    assert {(x["key"], x["rank"]) for x in left.collect()} == {("k", 3), ("new", 3), ("gone", 3)}
    # A blind write makes a sibling, one with the read's context replaces what was read.
    after = records(spark, [r, s]).unionByName(left.where("key = 'k'").select(records(spark, []).columns))
    assert [x["value"] for x in causal.maximal(after).collect()] == ["x", "x"]
    removed = asked.limit(1).withColumn("method", F.lit("DELETE"))
    tomb = requests.apply_mutations(removed.withColumn("key", F.lit("new")), state, replies(1, 2), replies(1, 2), 2, 2).first()
    assert tomb["status"] == 204 and tomb["deleted"] and tomb["value"] is None


def test_validation(spark):
    rows = [("k", "", [""], "v", None), ("k", "a", ["b"], "v", None), ("k", "c", ["", "c"], "v", None), ("k", "d", ["d"], None, 5), ("k", "e", ["e"], None, None), ("k", "f", ["f"], "v", 5)]
    assert {r["id"]: r["fault"] for r in validate.record_faults(records(spark, rows)).collect()} == {"": "id", "a": "clock", "c": "context", "d": "tombstone"}


PEERS = {n: f"http://{n}:8080" for n in "abc"}


def test_cluster_settings():
    own = cluster.Cluster("a", PEERS)
    assert (own.n, own.r, own.w, own.vnodes, own.capacity, own.timeout_ms) == (3, 2, 2, 64, 1000, 2000)
    assert cluster.Cluster("a", {"a": "http://h"}).n == 1 and cluster.Cluster("a", PEERS, n=1).r == 1
    for bad in ({"n": 4}, {"n": 0}, {"r": 0}, {"r": 4}, {"w": 0}, {"n": 2, "w": 3}, {"timeout_ms": 0}, {"vnodes": 0}, {"node": "z"}, {"node": ""}):
        with pytest.raises(ValueError):
            cluster.Cluster(**{"node": "a", "peers": PEERS} | bad)
    for origin in ("ftp://a", "http://", "http://u@a", "http://a/path", "http://a?q=1", "http://a#f", "a:80", ""):
        with pytest.raises(ValueError):
            cluster.Cluster("a", PEERS | {"b": origin})
    assert cluster.Cluster("a", PEERS | {"b": "https://b/"}).nodes[1] == ("b", "https://b")
    assert own.fingerprint() == cluster.Cluster("b", dict(reversed(PEERS.items())), timeout_ms=9).fingerprint() != cluster.Cluster("a", PEERS, w=3).fingerprint()
    assert own.owner_fingerprint() != own.fingerprint()


def test_cluster_from_env():
    load = cluster.Cluster.from_env
    assert (load({}).node, load({}).n, load({}).r) == ("node-a", 1, 1)
    own = load({"CACHE_NODE_ID": "b", "CACHE_PEERS": json.dumps(PEERS), "CACHE_REPLICAS": "1"})
    assert (own.n, own.r, own.w) == (1, 1, 1)
    own = load({"CACHE_NODE_ID": "b", "CACHE_PEERS": json.dumps(PEERS), "CACHE_WRITE_QUORUM": "3"})
    assert (own.n, own.r, own.w) == (3, 2, 3)
    for bad in ({"CACHE_PEERS": "no"}, {"CACHE_PEERS": "[]"}, {"CACHE_LISTEN_ADDR": ":9"}, {"CACHE_REPLICAS": "x"}, {"CACHE_REPLICAS": "2"}, {"CACHE_READ_QUORUM": "1.0"}, {"CACHE_NODE_ID": "z", "CACHE_PEERS": json.dumps(PEERS)}):
        with pytest.raises(ValueError):
            load(bad)


def test_preview(spark):
    good = {"key": "k", "nodes": ["a", "b"], "virtual_nodes": 3, "replicas": 2}
    status, rows = cluster.preview(spark, json.dumps(good))
    rows = rows.collect()
    assert status == 200 and len(rows) == 6 and sorted(rows[0]["replicas"]) == ["a", "b"] and [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    for bad in ({"nodes": []}, {"nodes": ["a"] * 2}, {"nodes": [str(i) for i in range(33)]}, {"virtual_nodes": 0}, {"virtual_nodes": 129}, {"replicas": 33}, {"replicas": 0}, {"more": 1}, {"nodes": [""]}, {"key": "x" * 40_000}, {"virtual_nodes": True}):
        assert cluster.preview(spark, json.dumps(good | bad)) == (400, None)
    assert cluster.preview(spark, "{}{}")[0] == cluster.preview(spark, "[]")[0] == 400


def test_log_tails_and_append(spark, tmp_path):
    frame = wal.frame(wal.record(1, "put", "a", b"x"))
    for i, tail in enumerate((b"", b"\0\0", b"\0\0\0\x0a\0\0\0\0x", b"\0\0\0\0\0\0\0\0", frame[:8] + b"\xff" + frame[9:])):
        (tmp_path / f"store-{i:05d}.wal").write_bytes(frame + tail)
    got = {r["path"][-5]: (r["bytes"], r["valid_bytes"], r["error"] is not None) for r in wal.tails(spark, f"file://{tmp_path}").collect()}
    assert {v[1:] for k, v in got.items() if k in "012"} == {(len(frame), False)} and {v[1:] for k, v in got.items() if k in "34"} == {(len(frame), True)}
    ops = spark.createDataFrame([(i, s, "put", k, b"y") for i in (1, 7) for s, k in ((9, "late"), (3, "soon"))], "store long, seq long, op string, key string, value binary")
    (tmp_path / "store-00003.wal").unlink()
    (tmp_path / "store-00004.wal").unlink()
    wal.extend(spark, ops, f"file://{tmp_path}")
    got = [(r["path"][-5], r["seq"], r["key"]) for r in wal.strict(wal.scan(spark, f"file://{tmp_path}")).orderBy("path", "seq").collect()]
    assert got == [("0", 1, "a"), ("1", 1, "a"), ("1", 2, "soon"), ("1", 3, "late"), ("2", 1, "a"), ("7", 1, "soon"), ("7", 2, "late")]
    new = f"file://{tmp_path}/new"
    wal.compact(spark, f"file://{tmp_path}", new)
    assert len(shared.names(spark, new)) == 4
    wal.extend(spark, ops.where("store = 1"), new)
    assert sorted((r["path"][-5], r["seq"], r["key"]) for r in wal.recover(spark, new).collect()) == [("0", 1, "a"), ("1", 1, "a"), ("1", 4, "soon"), ("1", 5, "late"), ("2", 1, "a"), ("7", 1, "soon"), ("7", 2, "late")]
    (tmp_path / "store-00001.wal").write_bytes(frame[:8] + b"\xff" + frame[9:])
    with pytest.raises(Exception, match="checksum"):
        wal.extend(spark, ops, f"file://{tmp_path}")


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"k{i % 7}", f"r{i}", sorted({f"r{i}", *(f"r{rng.randrange(60)}" for _ in range(rng.randrange(3)))}), "v", False, None) for i in range(60)]
    whole = records(spark, []).schema
    here, source = f"file://{tmp_path}/state", f"file://{tmp_path}/in"
    stream = lambda: spark.readStream.schema(whole).option("maxFilesPerTrigger", 1).parquet(source)
    for i in range(0, 60, 15):
        spark.createDataFrame(rows[i : i + 15], whole).coalesce(1).write.mode("append").parquet(source)
        if i in (15, 45):  # two files, then a stop
            got = siblings(stream(), here)
            assert sorted(map(str, got.collect())) == sorted(map(str, causal.maximal(spark.createDataFrame(rows[: i + 15], whole)).collect()))
    assert siblings(stream(), here).count() == got.count()  # nothing new
    assert len([n for n in shared.names(spark, here) if n.startswith("state")]) == 2


def test_shared_folder_is_asked_for():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.folder(Session(), "x")
    Session.sparkContext.master = "local[2]"
    assert shared.folder(Session(), "x").startswith("file://")
