"""Log and snapshot files of version 1 and 2, with expiries, as the reference writes and refuses them."""

import base64
import io
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas import group_ops

from tidewake.functions import inorder
from tidewake.sources import wal

LEGACY = [{"version": 1, "op": "put", "key": "legacy", "value": "eA=="}, {"version": 1, "op": "delete", "key": "none"}]


def sibling(i, clock=None, **more):
    return {"id": i, "clock": dict.fromkeys(clock or [i], 1), "value": "v" + i, "deleted": False, "expires": wal.ZERO_TIME} | more


def v2(*siblings, **more):
    return {"siblings": list(siblings), "sequence": 1, "version": 2, "op": "put", "key": "k", "expires": wal.ZERO_TIME} | more


def scanned(spark, folder, records, boundary=0):
    folder.mkdir(exist_ok=True)
    (folder / "a.wal").write_bytes(b"".join(wal.frame(r) for r in records))
    return wal.scan(spark, f"file://{folder}", boundary).collect()


def test_scan(spark, tmp_path):
    got = scanned(spark, tmp_path, [*LEGACY, v2(sibling("a"), sibling("b", expires="2024-01-15T02:00:00.0000005+02:00"), sequence=3), {"sequence": 4, "version": 1, "op": "put", "key": "t", "value": base64.b64encode(b"\xff").decode(), "expires": "2024-01-15T00:00:00Z"}])
    assert [(r["seq"], r["version"], r["key"], r["value"] and bytes(r["value"]), r["expires_us"], r["error"]) for r in got] == [
        (1, 1, "legacy", b"x", None, None), (2, 1, "none", None, None, None), (3, 2, "k", None, None, None), (4, 1, "t", b"\xff", 1705276800000000, None)]
    assert [(s["id"], s["clock"], s["value"], s["deleted"], s["expires_us"]) for s in got[2]["siblings"]] == [("a", {"a": 1}, "va", False, None), ("b", {"b": 1}, "vb", False, 1705276800000001)]


BAD = [
    v2(), v2(sibling("a"), value="eA=="), v2(sibling("a"), expires="2024-01-15T00:00:00Z"), v2(sibling("a"), op="delete"), v2(sibling("a"), version=1), v2(sibling("a"), version=3),
    v2(sibling("a", ["b"])), v2(sibling("a") | {"clock": {"a": 2}}), v2(sibling("a", ["a", ""])), v2(sibling("a", deleted=True)), v2(sibling("a"), sibling("a", value="x")),
    LEGACY[0] | {"value": "?"}, LEGACY[0] | {"expires": "soon"}, LEGACY[0] | {"sequence": 2}, LEGACY[0] | {"key": 5}, [],
]


def test_faults(spark, tmp_path):
    for i, bad in enumerate(BAD):
        (tmp_path / f"{i}.wal").write_bytes(wal.frame(bad))
        (tmp_path / f"{i}.wal.snapshot").write_bytes(wal.snapshot({"k": bad}, 1))
    assert all(r["error"] for r in wal.scan(spark, f"file://{tmp_path}").collect())
    got = wal.scan_snapshots(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(BAD) and all(r["error"] for r in got)


def test_recover(spark, tmp_path):
    put = lambda seq, key, us=None: wal.record(seq, "put", key, key.encode(), us)
    kept = {"old": put(2, "old"), "gone": put(3, "gone"), "stale": put(4, "stale", 100), "k": v2(sibling("a"), sequence=5)}
    (tmp_path / "a.wal.snapshot").write_bytes(wal.snapshot(kept, 6))
    (tmp_path / "a.wal").write_bytes(b"".join(wal.frame(r) for r in [put(6, "skipped"), wal.record(7, "delete", "gone"), put(8, "new", 101)]) + b"\0\0")
    (tmp_path / "b.wal.snapshot").write_bytes(wal.snapshot({}, 9))
    (tmp_path / "b.wal").write_bytes(wal.frame(put(10, "b")))
    (tmp_path / "c.wal").write_bytes(b"".join(wal.frame(r) for r in LEGACY))
    state = wal.recover(spark, f"file://{tmp_path}", 100).collect()
    assert {(r["path"][-5], r["key"], r["seq"], r["expires_us"]) for r in state} == {("a", "old", 2, None), ("a", "k", 5, None), ("a", "new", 8, 101), ("b", "b", 10, None), ("c", "legacy", 1, None)}
    assert [s["value"] for r in state for s in r["siblings"] or []] == ["va"]
    (tmp_path / "b.wal").write_bytes(wal.frame(put(11, "b")))
    with pytest.raises(Exception, match="sequence gap"):
        wal.recover(spark, f"file://{tmp_path}", 100).collect()


def test_times():
    for us in (0, 1, 1705276800000000, 1705276800120000, -1):
        assert wal.instant(wal.timestamp(us)) == us * 1000
    assert wal.instant(wal.ZERO_TIME) is None and wal.timestamp(None) == wal.ZERO_TIME
    assert json.loads(json.dumps(wal.record(1, "put", "k")))["expires"] == wal.ZERO_TIME


@pytest.fixture
def no_frames(spark, monkeypatch):
    """No store's rows are one pandas frame, and Python gets few at a time."""

    def refuse(*_):
        raise AssertionError("a store's rows are one pandas frame")

    monkeypatch.setattr(group_ops.PandasGroupedOpsMixin, "applyInPandas", refuse)
    monkeypatch.setattr(group_ops.PandasCogroupedOps, "applyInPandas", refuse)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def ops(spark, n):
    """Records of stores 0 to 2, of 5 keys each, the last of which hold a value."""
    return spark.range(n).select(F.col("id").alias("seq"), (F.col("id") % 3).alias("store"), F.lit("put").alias("op"), F.concat(F.lit("k"), (F.col("id") % 5).cast("string")).alias("key"), F.col("id").cast("string").cast("binary").alias("value")).repartition(3)


def numbered(spark, folder):
    return sorted((r["path"][-5], r["seq"], int(r["value"])) for r in wal.strict(wal.scan(spark, folder)).collect())


def test_logs_are_streams(spark, tmp_path, no_frames):
    here = f"file://{tmp_path}/a b%20c"  # names as Spark has them, without escapes
    log = ops(spark, 90).withColumn("seq", F.expr("seq div 3 + 1"))
    wal.append(log, here)
    assert numbered(spark, here) == sorted((str(i % 3), i // 3 + 1, i) for i in range(90))
    # Files that workers open aren't a row each.
    plan = wal.scan(spark, here)._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan


def test_frames_are_read_as_they_come():
    data = io.BytesIO(wal.frame(LEGACY[0]) * 1000)
    one = next(wal.frames(data))
    assert json.loads(one[0]) == LEGACY[0] and data.tell() == one[2] == len(wal.frame(LEGACY[0]))


def test_extension_is_a_stream(spark, tmp_path, no_frames):
    here = f"file://{tmp_path}/logs"
    wal.append(ops(spark, 60).withColumn("seq", F.expr("seq div 3 + 1")).where("store < 2"), here)
    with open(tmp_path / "logs/store-00001.wal", "ab") as torn:
        torn.write(b"\0\0\0\x09broken")
    before = (tmp_path / "logs/store-00000.wal").read_bytes()
    wal.extend(spark, ops(spark, 90).where("store > 0 and seq >= 60"), here)
    wal.extend(spark, ops(spark, 93).where("store > 0 and seq >= 90"), here)
    assert (tmp_path / "logs/store-00000.wal").read_bytes() == before
    want = [("0", i // 3 + 1, i) for i in range(0, 60, 3)] + [("1", i // 3 + 1, i) for i in range(1, 93, 3)] + [("2", n, i) for n, i in enumerate(range(62, 93, 3), 1)]
    assert numbered(spark, here) == sorted(want)


def test_snapshots_are_streams(spark, tmp_path, no_frames):
    log, new = f"file://{tmp_path}/log", f"file://{tmp_path}/new"
    wal.append(ops(spark, 90).withColumn("seq", F.expr("seq div 3 + 1")), log)
    wal.compact(spark, log, new)
    for store in range(3):
        rows = {f"k{i % 5}": wal.record(i // 3 + 1, "put", f"k{i % 5}", str(i).encode()) for i in range(store, 90, 3)}
        assert (tmp_path / f"new/store-{store:05d}.wal.snapshot").read_bytes() == wal.snapshot(rows, 30)
    # Of rows of one key the last counts, and a null key stands for nothing.
    state = spark.createDataFrame([(7, 9, 2, "\U0001f600", b"new"), (7, 9, 1, "\U0001f600", b"old"), (7, 9, 3, "\uffff", b"x"), (8, 4, None, None, None)], "store long, boundary long, seq long, key string, value binary")
    wal.save_snapshots(state, new)
    want = {"\uffff": wal.record(3, "put", "\uffff", b"x"), "\U0001f600": wal.record(2, "put", "\U0001f600", b"new")}
    assert (tmp_path / "new/store-00007.wal.snapshot").read_bytes() == wal.snapshot(want, 9)
    assert (tmp_path / "new/store-00008.wal.snapshot").read_bytes() == wal.snapshot({}, 4)


def test_batches_are_bounded():
    import pyarrow as pa

    rows = lambda n, data: ((i, data) for i in range(n))
    fields = {"n": pa.int64(), "data": pa.binary()}
    assert [b.num_rows for b in inorder.batches(rows(5, bytes(inorder.BYTES // 2)), fields)] == [2, 2, 1]
    assert [b.num_rows for b in inorder.batches(rows(2 * inorder.ROWS + 1, None), fields)] == [inorder.ROWS, inorder.ROWS, 1]
    assert list(inorder.batches(iter(()), fields)) == []


def state_of(spark, folder):
    return sorted((r["path"][-5], r["key"], r["seq"], int(r["value"])) for r in wal.recover(spark, folder).collect())


def test_state_is_recovered_from_streams(spark, tmp_path, no_frames):
    here = f"file://{tmp_path}/log"
    wal.append(ops(spark, 90).withColumn("seq", F.expr("seq div 3 + 1")), here)
    want = sorted((str(i % 3), f"k{i % 5}", i // 3 + 1, i) for i in range(75, 90))
    assert state_of(spark, here) == want


def test_state_is_recovered_from_snapshots_and_streams(spark, tmp_path, no_frames):
    log, new = f"file://{tmp_path}/log", f"file://{tmp_path}/new"
    wal.append(ops(spark, 60).withColumn("seq", F.expr("seq div 3 + 1")), log)
    wal.compact(spark, log, new)
    wal.extend(spark, ops(spark, 66).where("seq >= 60"), new)
    want = sorted((str(i % 3), f"k{i % 5}", i // 3 + 1, i) for i in range(66) if i + 15 > 65)
    assert state_of(spark, new) == want
