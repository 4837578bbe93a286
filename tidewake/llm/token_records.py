"""Token ids in length-delimited binary records.

A part file is MAGIC, then records; a record is
    u32 length of the payload | u32 masked crc32 of those 4 bytes | payload | u32 masked crc32 of the payload
and a payload
    u8 1 if the id is null | u8 bytes of a token id | i64 id | token ids,
all little-endian. Beside it an index file has i64 id, u64 offset of the record, u64 tokens and u8 1 if the id is null
for each record, for reads in any order. A part is one or several files; parts, their files and records are in ascending
order of the id.
"""

import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch as S

MAGIC = b"TWREC01\n"
MASK_DELTA = 0xA282EAD8
ENTRY = "<qQQB"
#: Bytes after which a task goes on in another file.
ROLL_BYTES = 64 << 20
#: Parts of texts whose ids a worker remembers at most, besides those of a block; some 160 bytes each. A quarter of them
#: are parts met in one block so far.
PIECES = 800_000
#: New parts that are encoded as one text; fewer than the least go one by one.
JOINED, LEAST = 1000, 8
#: Bytes of texts that are encoded at a time, or a single text.
BLOCK_BYTES = 8 << 20
#: A blank before what isn't white space: byte-level pieces end before it, whatever is on either side.
CUT = r" (?=[^\s\u180e])"
#: Any other blank. A text without one has a cut at each blank.
UNCUT = r" (?:[\s\u180e]|\Z)"


def masked(data: bytes) -> int:
    """The crc32 turned by 15 bits plus a constant: a checksum of data that holds checksums stays strong."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<I", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def record(data: bytes, at: int) -> tuple[int | None, "object", int]:
    """The id, the token ids and the end of the record at a byte offset; a wrong checksum raises."""
    import numpy as np

    size, check = struct.unpack_from("<II", data, at)
    if masked(data[at : at + 4]) != check:
        raise ValueError(f"length checksum differs at {at}")
    payload, end = data[at + 8 : at + 8 + size], at + 12 + size
    if len(payload) != size or masked(payload) != struct.unpack_from("<I", data, end - 4)[0]:
        raise ValueError(f"payload checksum differs at {at}")
    null, width, doc_id = struct.unpack_from("<BBq", payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=10), end


def records(data: bytes) -> Iterator[tuple]:
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a record file")
    at = len(MAGIC)
    while at < len(data):
        doc_id, ids, end = record(data, at)
        yield doc_id, ids, at
        at = end


def lookup(folder: str, part: int, roll: int, row: int) -> tuple:
    """One record of a file by its place in the index; only its entry and the record itself are read."""
    _, at, _, _ = struct.unpack(ENTRY, S.get_range(f"{name(folder, part, roll)}.idx", struct.calcsize(ENTRY) * row, struct.calcsize(ENTRY)))
    file = f"{name(folder, part, roll)}.rec"
    size, check = struct.unpack("<II", head := S.get_range(file, at, 8))
    if masked(head[:4]) != check:
        raise ValueError(f"length checksum differs at {at}")
    return record(S.get_range(file, at, 12 + size), 0)[:2]


def name(folder: str, part: int, roll: int) -> str:
    return f"{folder}/part-{part:06d}-{roll:05d}"


def encoder(t, dtype: str):
    """A function of a list of texts: the ids of each as bytes, as the tokenizer encodes it whole.

    Where the tokenizer is byte-level BPE with the usual pattern, no piece of a text crosses a CUT, so a text's ids are
    those of its parts between cuts, and a part that comes again needn't be encoded again. New parts are encoded many at
    a time, joined to one text: each has one blank, before it, so its ids begin where a token begins with a blank."""
    import json
    import re
    from itertools import pairwise

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def whole(texts):
        return [np.array(e.ids, dtype).tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    x = json.loads(t.to_str())
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    parted = x["model"]["type"] == "BPE" and not any(x.get(k) for k in ("normalizer", "truncation", "padding")) and not x["model"].get("dropout")
    if not parted or usual.items() - (x["pre_tokenizer"] or {}).items() or not all(a["special"] for a in x["added_tokens"]):
        return whole
    vocabulary = x["model"]["vocab"]
    begins = np.zeros(1 + max([*vocabulary.values(), *(a["id"] for a in x["added_tokens"])]), bool)
    begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # a blank, as byte-level models write it
    uncut, cut, width = re.compile(UNCUT).search, re.compile(CUT).split, np.dtype(dtype).itemsize
    known, once = {}, {}  # parts met in several blocks, and in one
    least = LEAST if x["model"].get("unk_token") is None else JOINED + 1  # that token may stand for a blank too

    def learn(parts):
        for i in range(0, len(parts), JOINED):
            some = parts[i : i + JOINED]
            if len(some) >= least:
                data = whole([" " + " ".join(some)])[0]
                ats = (np.flatnonzero(begins[np.frombuffer(data, dtype)]) * width).tolist()
                if len(ats) == len(some):
                    once.update(zip(some, (data[a:b] for a, b in pairwise([*ats, len(data)])), strict=True))
                    continue
            once.update(zip(some, whole([f" {w}" for w in some]), strict=True))  # few, or they hold blanks

    def ids(parts):
        if len(known) > PIECES - PIECES // 4:
            known.clear()
        found = list(map(known.get, parts))
        gaps = [i for i, data in enumerate(found) if data is None]
        new = [w for w in (parts[i] for i in gaps) if w not in once]
        if len(new) < len(gaps):
            known.update((w, once.pop(w)) for w in (parts[i] for i in gaps) if w in once)
        if len(once) + len(new) > PIECES // 4:
            once.clear()
        learn([w for w in new if " " not in w])
        learn([w for w in new if " " in w])
        for i in gaps:
            found[i] = once[parts[i]] if parts[i] in once else known[parts[i]]
        return found

    def by_parts(texts):
        odd = [uncut(x) is not None for x in texts]
        split = pc.split_pattern(pa.array([x for x, o in zip(texts, odd, strict=True) if not o], pa.large_string()), " ")
        split = pa.concat_arrays([split, pa.array([cut(x) for x, o in zip(texts, odd, strict=True) if o], split.type)])
        at = split.offsets.to_numpy()
        later = np.ones(len(split.values), bool)
        later[at[:-1]] = False  # a text's first part has no blank before it
        parts = split.values.filter(pa.array(later)).dictionary_encode()
        data = pa.array(ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(parts.indices)
        ends = np.frombuffer(data.buffers()[1], np.int64)[at - np.arange(len(at))].tolist()
        raw, firsts = memoryview(data.buffers()[2] or b""), whole(split.values.take(pa.array(at[:-1])).to_pylist())
        made = [b"".join((first, raw[a:b])) for first, (a, b) in zip(firsts, pairwise(ends), strict=True)]
        plain, others = iter(made[: len(odd) - sum(odd)]), iter(made[len(odd) - sum(odd) :])
        return [next(others if o else plain) for o in odd]

    return by_parts


def kept(run: str, tokenizer: str, end_id: int):
    """The encoder of a tokenizer's file and the bytes of a token id: as this worker's last task left it with the parts
    it knows, if that was of the same run. Python workers live on from task to task, modules pickled by value don't, so
    it stays with the library. Runs share nothing."""
    import tokenizers

    key, last = (run, tokenizer, end_id), getattr(tokenizers, "_tidewake_kept", None)
    if last and last[0] == key:
        return last[1:]
    t = tokenizers.Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True  # their strings are ordinary text
    width = 2 if max(t.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    tokenizers._tidewake_kept = key, encoder(t, f"<u{width}"), width
    return tokenizers._tidewake_kept[1:]


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, parts: int | None = None, roll_bytes: int = ROLL_BYTES) -> list[tuple]:
    """Encodes every whole text of docs (doc_id, text; null: empty), adds end_id and writes record files.

    Rows are dealt to parts by ranges of doc_id and sorted there; each task writes its own part, a record at a time, to
    files of roll_bytes or one record more, so the work is one range shuffle and no task holds a part. Null ids come
    first. A repeated id keeps all its rows, in order of the text's hash; where it or one row has many, these are
    dealt to several parts. A very long text is one record, of less than 4 GiB. Without rows there are no files. Columns
    other than doc_id and text play no part. Returns (part, roll, tokens) of each file, in order. A token id takes 2
    bytes where the vocabulary allows it.
    """
    spark, run = docs.sparkSession, uuid.uuid4().hex
    parts = parts or S.shuffles(spark)

    def encode(batches):
        import contextlib
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        encoded, width = kept(run, tokenizer, end_id)
        end = np.array([end_id], f"<u{width}").tobytes()

        def rows():
            for batch in batches:
                ids, texts, low = batch.column(0).to_pylist(), batch.column(1), 0
                ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
                while low < len(ids):
                    high = max(low + 1, int(np.searchsorted(ends, BLOCK_BYTES + (ends[low - 1] if low else 0), "right")))
                    for doc_id, data in zip(ids[low:high], encoded([x or "" for x in texts[low:high].to_pylist()]), strict=True):
                        yield doc_id, data + end
                    low = high

        part, roll, left = TaskContext.get().partitionId(), 0, rows()
        now = next(left, None)
        while now is not None:
            at, total = len(MAGIC), 0
            with contextlib.ExitStack() as files:
                out, index = (files.enter_context(S.writer(f"{name(folder, part, roll)}.{x}")) for x in ("rec", "idx"))
                out.write(MAGIC)
                while now is not None and (at < roll_bytes or not total):
                    doc_id, tokens = now
                    data = frame(struct.pack("<BBq", doc_id is None, width, doc_id or 0) + tokens)
                    out.write(data)
                    index.write(struct.pack(ENTRY, doc_id or 0, at, len(tokens) // width, doc_id is None))
                    at, total = at + len(data), total + len(tokens) // width
                    now = next(left, None)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([roll], pa.int32()), pa.array([total], pa.int64())], ["part", "roll", "tokens"])
            roll += 1

    order = ("doc_id", "th", "salt")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.spark_partition_id().alias("salt"))
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = dealt.mapInArrow(encode, "part int, roll int, tokens long").collect()  # a row for each file
    return sorted((r["part"], r["roll"], r["tokens"]) for r in made)


def read_records(spark, folder: str, files: list[tuple]) -> DataFrame:
    """What the record files hold, a row for each: doc_id, start, n_tokens, ids_crc32 (over 4-byte ids), part, roll, byte_offset."""

    def read(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")] + [("part", pa.int32()), ("roll", pa.int32()), ("byte_offset", pa.int64())])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for part, roll, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for doc_id, ids, at in records(S.get(f"{name(folder, part, roll)}.rec")):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype(np.dtype("<u4")).tobytes()), part, roll, at))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    starts, rows = 0, []
    for part, roll, tokens in files:
        rows.append((part, roll, starts))
        starts += tokens
    given = spark.createDataFrame(rows, "part int, roll int, start long")
    given = given.repartition(max(1, len(rows)), "part", "roll") if rows else given
    return given.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, roll int, byte_offset long")
