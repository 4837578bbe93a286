"""Framed mutation logs and checksummed snapshots as DataFrames.

A frame is a 4-byte big-endian length, a 4-byte big-endian CRC-32 and that many bytes of JSON. A log may end
within a frame: that tail is left out. A length of 0 or over 16 MiB and a wrong checksum are errors anywhere.
Records of version 1 are puts and deletes of bytes (base64 in JSON), with an expiry or without; those of version 2 put
siblings. Expiries are kept in whole microseconds, rounded up, so that comparisons with a time in microseconds hold.
"""

import base64
import datetime
import io
import json
import re
import struct
import uuid
import zlib
from collections import deque
from contextlib import contextmanager, suppress
from itertools import chain, groupby
from operator import itemgetter
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import inorder

FRAME_LIMIT = 16 << 20
SIBLINGS = "array<struct<id:string,clock:map<string,bigint>,value:string,deleted:boolean,expires_us:bigint>>"
RECORD = f"seq long, version int, op string, key string, value binary, expires_us long, siblings {SIBLINGS}"
#: As RECORD, while siblings are JSON.
_FIELDS = ["seq", "version", "op", "key", "value", "expires_us", "siblings"]
_RAW = RECORD.replace(SIBLINGS, "string")
_EPOCH = datetime.datetime(1970, 1, 1)
_TIME = re.compile(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d+))?(?:Z|([+-])(\d\d):(\d\d))", re.ASCII)
ZERO_TIME = "0001-01-01T00:00:00Z"


def instant(text: str | None) -> int | None:
    """Nanoseconds since 1970 of an RFC 3339 time, None for no time or the zero time; ValueError if it isn't one."""
    if text is None or text == ZERO_TIME:
        return None
    if not (m := _TIME.fullmatch(text)):
        raise ValueError("time")
    since = datetime.datetime.fromisoformat(m[1]) - _EPOCH
    seconds = since.days * 86400 + since.seconds - (int(m[3] + "1") * (int(m[4]) * 3600 + int(m[5]) * 60) if m[3] else 0)
    ns = seconds * 10**9 + int((m[2] or "0")[:9].ljust(9, "0"))
    return None if ns == _ZERO_NS else ns


_ZERO_NS = -62135596800 * 10**9


def timestamp(us: int | None) -> str:
    """RFC 3339 of microseconds since 1970."""
    if us is None:
        return ZERO_TIME
    at = _EPOCH + datetime.timedelta(microseconds=us)
    return at.strftime("%Y-%m-%dT%H:%M:%S").zfill(19) + (f".{at.microsecond:06d}".rstrip("0") if at.microsecond else "") + "Z"


def _is(value, kind, default):
    """The value, the default for null; TypeError if it is of another kind."""
    if value is None:
        return default
    if not isinstance(value, kind) or isinstance(value, bool) and kind is int:
        raise TypeError(kind.__name__)
    return value


def _micros(ns: int | None) -> int | None:
    return None if ns is None else -(-ns // 1000)


def merge_fault(siblings: list) -> str | None:
    """Why siblings (id, clock, value, deleted, expires) can't be merged, if so."""
    seen = {}
    for s in siblings:
        if s["id"] == "" or s["clock"].get(s["id"]) != 1:
            return "invalid record identity"
        if s["deleted"] and (s["value"] != "" or s["expires"] is not None):
            return "invalid tombstone"
        if any(k == "" or n != 1 for k, n in s["clock"].items()):
            return "invalid causal context"
        if seen.setdefault(s["id"], s) != s:
            return "record identity reused with different contents"
    return None


def decode(r: dict) -> tuple[list, str | None]:
    """(fields as in RECORD, siblings as JSON; fault or None) of a record's JSON object."""
    seq, version = _is(r.get("sequence"), int, 0), _is(r.get("version"), int, 0)
    op, key = _is(r.get("op"), str, ""), _is(r.get("key"), str, "")
    value = base64.b64decode(_is(r.get("value"), str, "").replace("\r", "").replace("\n", ""), validate=True)
    expires = instant(_is(r.get("expires"), str, None))
    if not 0 <= seq < 1 << 63:
        raise ValueError("sequence")
    siblings = []
    for s in _is(r.get("siblings"), list, []):
        s = _is(s, dict, {})
        clock = {k: _is(n, int, 0) for k, n in _is(s.get("clock"), dict, {}).items()}
        siblings.append({"id": _is(s.get("id"), str, ""), "clock": clock, "value": _is(s.get("value"), str, ""), "deleted": _is(s.get("deleted"), bool, False), "expires": instant(_is(s.get("expires"), str, None))})
    if version == 1:
        fault = None if not siblings and op in ("put", "delete") else "invalid record"
    else:
        fault = None if version == 2 and op == "put" and siblings and expires is None and not value else "invalid record"
        fault = fault or merge_fault(siblings)
    packed = json.dumps([{k: v for k, v in s.items() if k != "expires"} | {"expires_us": _micros(s["expires"])} for s in siblings]) if siblings and not fault else None
    return [seq, version, op, key, value if version == 1 and op == "put" else None, _micros(expires), packed], fault


def record(seq: int, op: str, key: str, value: bytes | None = None, expires_us: int | None = None, siblings: list | None = None) -> dict:
    """A record's JSON object: of version 2 if it has siblings."""
    if siblings:
        own = [{"id": s["id"], "clock": s["clock"], "value": s.get("value") or "", "deleted": s["deleted"], "expires": timestamp(s.get("expires_us"))} for s in siblings]
        return {"siblings": own, "sequence": seq, "version": 2, "op": op, "key": key, "expires": ZERO_TIME}
    return {"sequence": seq, "version": 1, "op": op, "key": key} | ({"value": base64.b64encode(value).decode()} if value else {}) | {"expires": timestamp(expires_us)}


_ENCODER = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False)


def frame(record: dict) -> bytes:
    payload = _ENCODER.encode(record).encode()
    return struct.pack(">II", len(payload), zlib.crc32(payload)) + payload


def frames(data):
    """(payload, error, end) of each whole frame of bytes or of a binary stream; an error ends the log."""
    data, at = io.BytesIO(data) if isinstance(data, bytes) else data, 0
    while len(head := data.read(8)) == 8:
        size, crc = struct.unpack(">II", head)
        if size == 0 or size > FRAME_LIMIT:
            yield None, f"invalid frame size {size}", at
            return
        payload = data.read(size)
        if len(payload) < size:
            return
        at += 8 + size
        if zlib.crc32(payload) != crc:
            yield None, "checksum mismatch", at
            return
        yield payload, None, at


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("siblings", F.from_json("siblings", SIBLINGS))


def _at(path: str):
    """The file system of a path as Spark names it, without escapes, and the path in it."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if path.startswith("/") or scheme == "file":
        return fs.LocalFileSystem(), path if path.startswith("/") else f"/{rest.lstrip('/')}"
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def _open(path: str, content: bytes | None = None):
    """A file as a buffered stream; of its content, if Spark has read that."""
    if content is not None:
        return io.BytesIO(content)
    files, at = _at(path)
    return io.BufferedReader(files.open_input_stream(at, compression=None), inorder.BYTES)


def _logs(spark: SparkSession, path: str) -> DataFrame:
    """The log files below path: path, length, content. Workers read them as streams, so content is null, unless they
    are in a store that only Spark can open; then a file is a row, and may have 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path)
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        _at(here.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(here).toString())
    except (OSError, ValueError, NotImplementedError):
        return files.select("path", "length", "content")
    return files.select("path", "length", F.lit(None).cast("binary").alias("content"))


def scan(spark: SparkSession, path: str, boundary: int | DataFrame = 0) -> DataFrame:
    """Rows of the log files below path: path, RECORD, error. A record without a sequence gets the one before plus 1;
    a gap or step back is an error; records up to boundary, a number or a table (path, boundary) by log file, are
    checked and left out, and the first one after it must follow it."""

    def read(path, stream, boundary):
        last, applied = 0, boundary
        for payload, error, _ in frames(stream):
            if not error:
                try:
                    row, error = decode(_is(json.loads(payload), dict, {}))
                except (ValueError, TypeError, OverflowError) as e:
                    error = f"undecodable record: {e}"
            if not error:
                seq = row[0] = row[0] or last + 1
                if seq <= last or last and seq != last + 1 or seq > boundary and seq != applied + 1:
                    error = "sequence gap"
            if error:
                yield path, *[None] * len(_FIELDS), error
                return
            last = seq
            if seq > boundary:
                applied = seq
                yield path, *row, None

    files = _logs(spark, path)
    if isinstance(boundary, DataFrame):
        files = files.join(boundary.select("path", "boundary"), "path", "left").fillna(0, ["boundary"])
    else:
        files = files.withColumn("boundary", F.lit(boundary).cast("long"))

    def run(batches):
        import pyarrow as pa

        fields = dict(path=pa.string(), seq=pa.int64(), version=pa.int32(), op=pa.string(), key=pa.string(), value=pa.binary(), expires_us=pa.int64(), siblings=pa.string(), error=pa.string())
        for b in batches:
            for path, content, boundary in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _open(path, content) as stream:
                    yield from inorder.batches(read(path, stream, boundary), fields)

    return _unpacked(files.select("path", "content", "boundary").mapInArrow(run, f"path string, {_RAW}, error string"))


def strict(log: DataFrame) -> DataFrame:
    """The log, or a failed job if any row has an error."""
    return log.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "error")).cast("boolean")).otherwise(F.lit(True))).drop("error")


@contextmanager
def _put(folder: str, name: str):
    """A stream to a new file, which is moved into place when all is written."""
    files, path = _at(folder)
    files.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    try:
        with files.open_output_stream(own, compression=None) as raw, io.BufferedWriter(raw, inorder.BYTES) as out:
            yield out
    except BaseException:
        with suppress(OSError):
            files.delete_file(own)
        raise
    files.move(own, f"{path}/{name}")


def _rows(log: DataFrame, *more: str) -> DataFrame:
    """A log's columns as Python gets them, with the siblings in JSON."""
    expires = F.col("expires_us") if "expires_us" in log.columns else F.lit(None)
    siblings = F.to_json("siblings") if "siblings" in log.columns else F.lit(None)
    return log.select(F.col("store").cast("long").alias("store"), F.col("seq").cast("long").alias("seq"), "op", "key", F.col("value").cast("binary").alias("value"), expires.cast("long").alias("expires_us"), siblings.cast("string").alias("siblings"), *more)


def _record(seq, op, key, value, expires_us, siblings) -> dict:
    return record(seq, op, key, value, expires_us, json.loads(siblings) if siblings else None)


def append(log: DataFrame, folder: str) -> None:
    """Writes a log (store, seq, op, key, value and, if there are such columns, expires_us and siblings) as one file of
    frames per store, in order of seq."""

    def write(name, rows):
        with _put(folder, f"{name}.wal") as out:
            for _, seq, op, key, *more in rows:
                if key is not None:
                    out.write(frame(_record(seq, op, key, *more)))

    _write(inorder.by(_rows(log), "store", "seq"), write)


def save_snapshots(state: DataFrame, folder: str) -> None:
    """Writes a state (store, boundary, and a log's columns but op) as one snapshot per store, beside its log. boundary is
    the sequence that the store's state was taken at; a row with a null key stands for a store without entries."""

    def write(name, rows):
        first = next(rows)
        last = (r for _, own in groupby(chain([first], rows), itemgetter(3)) for r in deque(own, 1))  # of each key
        with _put(folder, f"{name}.wal.snapshot") as out:
            for piece in _pieces(((key, _record(seq, op, key, *more)) for _, seq, op, key, *more, _ in last if key is not None), int(first[-1])):
                out.write(piece)

    _write(inorder.by(_rows(state.withColumn("op", F.lit("put")), "boundary"), "store", "key", "seq"), write)


def _write(rows: DataFrame, write) -> None:
    """Calls write with a name and the rows of each store; a store's rows come one after another, in order."""

    def run(batches):
        import pyarrow as pa

        for store, own in inorder.groups(batches):
            write(f"store-{store:05d}", own)
            yield pa.RecordBatch.from_arrays([pa.array([store], pa.int64())], ["store"])

    rows.mapInArrow(run, "store long").count()


def tails(spark: SparkSession, path: str) -> DataFrame:
    """How far the log files below path can be read: path, bytes, valid_bytes (whole frames), error of the first bad frame."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for path, length, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                end, error = 0, None
                with _open(path, content) as stream:
                    for payload, error, at in frames(stream):
                        end = at if payload is not None else end
                rows.append((path, length, end, error))
            yield from inorder.batches(rows, dict(path=pa.string(), bytes=pa.int64(), valid_bytes=pa.int64(), error=pa.string()))

    return _logs(spark, path).mapInArrow(run, "path string, bytes long, valid_bytes long, error string")


def extend(spark: SparkSession, ops: DataFrame, folder: str) -> None:
    """Appends ops (store, seq for their order, and a log's other columns) to the stores' logs in folder, numbered on from
    the last record, or else from the store's snapshot. A frame that a log's end broke off goes; a log with a bad frame
    fails the job. The log is written anew and then moved into place, so a repeated task does no harm while it is the
    only one that writes to the store."""
    number = F.regexp_extract("path", r"store-(\d+)", 1).cast("long")
    files = spark.read.format("binaryFile").load(folder).where("path like '%.wal' or path like '%.snapshot'").select(number.alias("store"), "path")

    def end(path):
        """The last sequence of a log or a snapshot, where the log's whole frames end, and what is wrong."""
        if path.endswith(".snapshot"):
            with _open(path) as stream:
                top, *_, error = next(iter(read_snapshot(stream.read())))
            return top, None, error
        seq, at = 0, 0
        with _open(path) as stream:
            for payload, error, at in frames(stream):
                if error:
                    return seq, at, error
                seq = json.loads(payload).get("sequence") or seq + 1
        return seq, at, None

    def ends(batches):
        import pyarrow as pa

        fields = dict(store=pa.int64(), path=pa.string(), last=pa.int64(), end=pa.int64(), error=pa.string())
        for b in batches:
            yield from inorder.batches(((store, path, *end(path)) for store, path in zip(*(c.to_pylist() for c in b.columns), strict=True)), fields)

    def write(name, rows):
        last, kept, faults = 0, None, []
        for _, path, own, at, error, *new in rows:
            if path is None:
                break
            faults += [f"{path}: {error}"] if error else []
            last, kept = max(last, own or 0), kept if at is None else (path, at)
        else:
            return  # nothing to append
        if faults:
            raise ValueError(faults[0])
        with _put(folder, f"{name}.wal") as out:
            if kept:
                with _open(kept[0]) as stream:
                    for at in range(0, kept[1], inorder.BYTES):
                        out.write(stream.read(min(inorder.BYTES, kept[1] - at)))
            for i, (_, *more) in enumerate(chain([new], (r[5:] for r in rows)), last + 1):
                out.write(frame(_record(i, *more)))

    # A store's files come first. How far they go is settled before the shuffle, so a repeated task writes the same.
    found = files.mapInArrow(ends, "store long, path string, last long, end long, error string")
    _write(inorder.by(found.unionByName(_rows(ops), allowMissingColumns=True), "store", F.col("path").isNull(), "seq"), write)


def compact(spark: SparkSession, path: str, folder: str, now_us: int | None = None) -> None:
    """Writes the state of the stores below path as snapshots in folder, each at its store's last sequence, so that
    empty logs follow them. What has expired at now_us, if that is given, is left out. The input stays as it is."""
    number = F.regexp_extract("path", r"store-(\d+)", 1).cast("long").alias("store")
    boundary = _snapshots(spark, path).where("key is null").select(F.regexp_replace("path", r"\.snapshot$", "").alias("path"), F.col("sequence").alias("boundary"))
    log = strict(scan(spark, path, boundary)).select("path", "seq")
    top = log.unionByName(boundary.withColumnRenamed("boundary", "seq")).groupBy("path").agg(F.max("seq").alias("boundary")).select(number, "boundary")
    state = recover(spark, path, now_us).select(number, "seq", "key", "value", "expires_us", "siblings")
    save_snapshots(top.join(state, "store", "left"), folder)


def snapshot(state: dict[str, dict], sequence: int) -> bytes:
    """An envelope of the JSON of a state, records by key, and its CRC-32."""
    return b"".join(_pieces(sorted(state.items()), sequence))


def _pieces(entries, sequence: int):
    """A snapshot of (key, record) in order of the keys, piece by piece."""
    crc, comma = 0, ""
    yield b'{"state":'
    yield (piece := f'{{"version":1,"sequence":{sequence},"entries":{{'.encode())
    crc = zlib.crc32(piece)
    for key, r in entries:
        yield (piece := f"{comma}{json.dumps(key)}:{json.dumps(r, separators=(',', ':'))}".encode())
        crc, comma = zlib.crc32(piece, crc), ","
    yield b"}}"
    yield f',"checksum":{zlib.crc32(b"}}", crc)}}}'.encode()


def read_snapshot(data: bytes):
    """(sequence, fields as in RECORD, error) rows, the first without a key; the checksum covers the raw bytes of the state."""
    none = [None] * len(_FIELDS)
    try:
        text = data.decode()
        body = text[text.index('"state":') + 8 :]
        state, end = json.JSONDecoder().raw_decode(body)
        if zlib.crc32(body[:end].encode()) != json.loads(text)["checksum"] or state["version"] != 1:
            raise ValueError("checksum or version")
        top, rows = _is(state.get("sequence"), int, 0), []
        if not 0 <= top < 1 << 63:
            raise ValueError("sequence")
        for k, r in state["entries"].items():
            row, fault = decode(r)
            if fault or row[3] != k or row[2] != "put" or not 0 < row[0] <= top:
                raise ValueError(fault or "entry")
            rows.append(row)
    except (ValueError, KeyError, TypeError, AttributeError, OverflowError) as e:
        yield None, *none, f"invalid snapshot: {e}"
        return
    yield top, *none, None
    for row in rows:
        yield top, *row, None


def _snapshots(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.snapshot").load(path).select("path", "content")
    columns = ["path", "sequence", *_FIELDS, "error"]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(path, *r) for r in read_snapshot(bytes(content))]
                yield pd.DataFrame(rows, columns=columns, dtype=object).astype({"sequence": "Int64", "seq": "Int64", "version": "Int32", "expires_us": "Int64"})

    return _unpacked(files.mapInPandas(run, f"path string, sequence long, {_RAW}, error string"))


def scan_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the snapshot files below path: path, sequence (of the snapshot), RECORD, error."""
    return _snapshots(spark, path).where("key is not null or error is not null")


def recover(spark: SparkSession, path: str, now_us: int | None = None) -> DataFrame:
    """State (path of the log, RECORD) of the stores below path: a store's snapshot if it has one, its log after that,
    less what has expired at now_us if that is given. A fault in any file fails the job."""
    of_log = F.regexp_replace("path", r"\.snapshot$", "")
    kept = strict(_snapshots(spark, path)).withColumn("path", of_log)
    boundary = kept.where("key is null").select("path", F.col("sequence").alias("boundary"))
    both = kept.where("key is not null").drop("sequence").unionByName(strict(scan(spark, path, boundary)))
    # Sequences of the log are beyond those of the snapshot. Maps can't be compared, so they are not part of the order.
    last = both.groupBy("path", "key").agg(F.max_by(F.struct("seq", "version", "op", "value", "expires_us", "siblings"), "seq").alias("e")).where("e.op = 'put'").select("path", "e.seq", "e.version", "e.op", "key", "e.value", "e.expires_us", "e.siblings")
    return last if now_us is None else last.where(F.col("expires_us").isNull() | (F.lit(now_us) < F.col("expires_us")))
