"""Each operator against a brute-force version, on small tables with nulls, empties, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import bin_packing, chat_format, decontaminate, mixing, mtree, scratch, token_records

LETTERS = [chr(c) for c in range(97, 110)]
CLASHING = ("of", "of_th", "windows", "th", "hits", "_id", "_hash", "_th", "_f", "_s", "f", "s", "row", "id", "at", "y", "items", "N_HIT", "t", "all", "pfp")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, part int, " + ", ".join(f"{c} string" for c in CLASHING)


def documents(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, 0, -1, "k", -1, *CLASHING) for i, t, s in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choices(LETTERS, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, prose(rng, rng.choice((3, 20, 60))), rng.choice(("a", "b", "é", None))) for i in range(120)]
    out += [(200, None, "a"), (201, "", "a"), (202, " \t ", None), (203, "É Ä " * 3000, "b"), (204, "a", "c"), (205, "", "c")]
    out += [(300 + i, "the same text of a hot group", "a") for i in range(60)]
    return out + [out[5], out[5], (5, "another text under the same id", "b"), (None, "no id", None)]


def test_token_records(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = scratch.scratch(spark, "t")
    docs = documents(spark, rows)
    files = token_records.write_records(docs, folder, path, roll_bytes=3000)
    assert len(files) > 5
    got = sorted(token_records.read_records(spark, folder, files).collect(), key=lambda r: r["start"])
    t = Tokenizer.from_file(path)
    start = 0
    hashed = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    assert len(got) == len(order)
    for r, (doc_id, text, _) in zip(got, order, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), crc)
        start += len(ids)
    part, roll, _ = files[-1]
    own = [r for r in got if (r["part"], r["roll"]) == (part, roll)]
    for place in (0, len(own) - 1):
        doc_id, ids = token_records.lookup(folder, part, roll, place)
        assert (doc_id, len(ids)) == (own[place]["doc_id"], own[place]["n_tokens"])
    assert token_records.lookup(folder, *files[0][:2], 0)[0] is None  # a null id isn't the id 0
    data = bytearray(scratch.get(f"{token_records.name(folder, part, roll)}.rec"))
    data[30] ^= 1
    with pytest.raises(ValueError):
        list(token_records.records(bytes(data)))


def test_texts_encoded_by_parts(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    asked = []

    class Counting:
        to_str = t.to_str

        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(texts)
            return t.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    monkeypatch.setattr(token_records, "PIECES", 300)
    encoded, rng = token_records.encoder(Counting(), "<u2"), random.Random(5)
    odd = [" ", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u180e", "\u200b", "\u2003", "\u2028", "\u3000", "\ufeff", "a", "the", "É", "e\u0301", "'", "'s", "'ll", "7", "12", "²", "Ⅷ", ".", "...", "!", "_", "<|endoftext|>", "Ġ", "語", "🙂", "\0"]
    texts = ["", " ", "x", " x", "x ", "  x  "] + ["".join(rng.choices(odd, k=rng.randrange(1, 14))) for _ in range(6000)] + [" ".join(rng.choices(odd, k=300)) for _ in range(20)]
    for low in range(0, len(texts), 500):
        some = texts[low : low + 500]
        assert [np.frombuffer(x, "<u2").tolist() for x in encoded(some)] == [e.ids for e in t.encode_batch_fast(some, add_special_tokens=False)]
    asked.clear()
    encoded(["one two three two two three"] * 50)
    assert sorted(asked) == [" three", " two"] + ["one"] * 50  # a part that comes again isn't encoded again
    t.add_tokens(["two th"])  # it may cross a cut, so texts are encoded whole
    assert [np.frombuffer(x, "<u2").tolist() for x in token_records.encoder(t, "<u2")(["one two three"])] == [t.encode("one two three", add_special_tokens=False).ids]


def test_parts_are_encoded_jointly_and_remembered():
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    path, asked = public_tokenizers.path("byte_bpe_50k.json"), []
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True

    class Counting:
        to_str = t.to_str

        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(texts)
            return t.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    rng, encoded = random.Random(7), token_records.encoder(Counting(), "<u2")
    ends = ["", "", "", ",", ".\nNext", "'s", "\t", "\n", "é", "語", "12", "$$$", "\u2003x", "\u0120", "<|endoftext|>"]
    texts = [" ".join(prose(rng, 1) * 2 + rng.choice(ends) for _ in range(2000)) for _ in range(8)] + ["two  blanks here ", ""]
    for _ in range(3):
        assert [np.frombuffer(x, "<u2").tolist() for x in encoded(texts)] == [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        distinct = len({w for x in texts for w in x.split(" ")[1:]})
        assert distinct > 5000 and len(asked) < len(texts) + distinct / 100
        asked.clear()
    assert len(encoded(texts)) == len(asked) == len(texts)  # only first parts

    t = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2}, [("a", "b")]))  # without blanks, and without ids for much else
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    texts = ["ab " + " ".join("ab" * n + c for n in range(9) for c in "abxyz"), "x y", ""]
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in token_records.encoder(t, "<u2")(texts)] == [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    first, width = token_records.kept("run", path, 2)
    assert width == 2 and token_records.kept("run", path, 2)[0] is first  # a worker's tasks share it
    assert token_records.kept("another", path, 2)[0] is not first and token_records.kept("another", path, 1 << 16)[1] == 4


def test_token_records_of_one_row_often(spark):
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    docs = documents(spark, [(5, "one row many times", "a")] * 900 + [(None, "x", "a")] * 300 + [(6, "y", "a")]).repartition(8)
    folder = scratch.scratch(spark, "t")
    files = token_records.write_records(docs, folder, path, parts=4)
    assert len({f[0] for f in files}) > 2  # several parts share the row
    got = sorted(token_records.read_records(spark, folder, files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 300 + [5] * 900 + [6] and got[-1]["start"] == sum(r["n_tokens"] for r in got[:-1])


def test_token_records_of_none(spark):
    folder = scratch.scratch(spark, "t")
    assert token_records.read_records(spark, folder, token_records.write_records(documents(spark, []), folder, __import__("public_tokenizers").path("byte_bpe_50k.json"))).count() == 0


def test_tree_and_best_fit():
    rng = random.Random(1)
    tree, held = bin_packing.Tree(), set()
    for _ in range(2000):
        key = (rng.randint(0, 50), rng.randint(0, 5))
        if key in held:
            tree.remove(key)
            held.discard(key)
        else:
            tree.add(key)
            held.add(key)
        ask = (rng.randint(0, 50), -1)
        assert tree.ceiling(ask) == min((k for k in held if k >= ask), default=None)
    sizes = [rng.randint(1, 60) for _ in range(300)]
    room, put = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
        b = min(fits)[1] if fits else len(room)
        room += [100] * (b == len(room))
        room[b] -= sizes[i]
        put[i] = b
    assert bin_packing.best_fit(sizes, 100) == put
    assert bin_packing.best_fit([7, 3], 5) == [0, 1]
    assert max(bin_packing.fewest_capacity(sizes, 16)) < 16


def test_packing(spark, rows):
    rng = random.Random(9)
    more = [(1000 + i, prose(rng, 40), "a") for i in range(600)]
    got = bin_packing.pack(documents(spark, rows + more), 4).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in rows + more)
    sizes, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[r["grouped"]].add(r["shard"])
    assert set(sizes) == set(range(4)) and max(sizes.values()) < 1.02 * min(sizes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in groups.values())
    # Packing in several levels, by few rows a bucket, is as even and keeps groups whole.
    levels = bin_packing.pack(documents(spark, rows + more), 4, parcels=40, bucket_rows=30).collect()
    assert Counter(r["doc_id"] for r in levels) == Counter(i for i, *_ in rows + more) and len({(r["grouped"], r["shard"]) for r in levels}) == len(groups)
    filled = Counter()
    for r in levels:
        filled[r["shard"]] += r["size"]
    assert len(filled) == 4 and max(filled.values()) < 1.1 * min(filled.values())
    # A group over a mean shard stays whole unless it may be divided; many equal rows are as good as any.
    many = documents(spark, [(i % 3, "hot" * 9, "a") for i in range(900)] + [(7, None, "a")] * 90 + more[:50])
    whole, parts = bin_packing.pack(many, 4).collect(), bin_packing.pack(many, 4, divide=True).collect()
    assert len({r["shard"] for r in whole if r["size"] == 28}) == 1 and len({r["shard"] for r in whole if r["grouped"] == "null"}) == 1
    evened = Counter()
    for r in parts:
        evened[r["shard"]] += r["size"]
    assert len(whole) == len(parts) == 1040 and max(evened.values()) < 1.3 * min(evened.values()) and len(evened) == 4
    for result in (whole, parts):
        for shard in range(4):
            own = sorted(r["slot"] for r in result if r["shard"] == shard)
            assert own == list(range(len(own)))
    assert bin_packing.pack(documents(spark, []), 4).count() == 0


def test_mixing(spark, rows):
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((i is None, i or 0, words(t)) for i, t, _ in rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += words(t)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), set(order)
    while True:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    target |= {s: left * weight[s] / whole for s in free}
    taken, most = Counter(), Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1 for s in order)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [(1, None, None)])).collect()[0]["taken"] == 0


def test_mixing_takes_the_least_keys(spark, rows):
    """Which documents the exponential keys choose, by sorting all of them."""
    df = documents(spark, rows)
    hashed = F.xxhash64(F.lit(17), "doc_id", "text")
    keyed = df.select("doc_id", "text", "source", hashed.alias("h")).collect()
    got = defaultdict(list)
    for r in mixing.mix(df).collect():
        got[r["source"]].append(r)
    unsigned = lambda h: (h & (1 << 64) - 1) >> 11
    weigh = lambda t, n: 4.0 if 4 <= (m := len(t or "") / max(n, 1)) <= 9 else 2.0 if 3 <= m <= 14 else 1.0
    for source, own in got.items():
        target, size = own[0]["target"], own[0]["source_size"]
        epochs = min(int(target // size), 2) if size else 0
        rest, below, want = target - epochs * size, 0, []
        docs = []
        for r in keyed:
            if r["source"] == source:
                n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
                docs.append((-math.log((unsigned(r["h"]) + 0.5) / (1 << 53)) / weigh(r["text"], n), r["h"], r["doc_id"], n))
        for _, _, doc_id, n in sorted(docs, key=lambda d: (d[0], d[1], d[2] or 0)):
            below += n
            want.append((str(doc_id), n, epochs + int(rest > 0 and below - n / 2 <= rest)))
        mine = sorted((str(r["doc_id"]), r["size"], r["copies"]) for r in own)
        # An empty document is as good on either side of the cut.
        assert [x for x in mine if x[1]] == [x for x in sorted(want) if x[1]], source


def test_chats(spark):
    odd = ["", None, "\\", "\\b", "### user: x </turn>\n", "#\\h<\\l", "é\n</turn>", "a:b", "\\### Assistant: </turn> ok"]
    rng, turns = random.Random(2), []
    for c in range(40):
        turns += [(c, t, rng.choice(("user", "assistant", "system", "a: b#", None)), rng.choice(odd) or rng.choice(odd), "extra") for t in range(rng.randint(1, 6))]
    turns += [(50, 0, "user", "x", ""), (50, 1, "assistant", "y", ""), (50, 1, "assistant", "y", ""), (51, None, "system", None, ""), (51, 0, "user", "q", ""), (51, 1, "assistant", "", ""), (None, 0, "user", "z", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, turns string").withColumnRenamed("turns", "formatted")
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.read_chats(chat_format.format_chats(df))).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in turns:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest()
        loss = "".join(x for *_, r, x in own if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got[50]["valid"] and got[51]["valid"]
    accepted = re.compile("(system )?user assistant( user assistant)*")
    assert all(got[c]["valid"] == (accepted.fullmatch(" ".join(r for *_, r, _ in own)) is not None) for c, own in by.items())
    assert chat_format.digests(chat_format.read_chats(chat_format.format_chats(df.limit(0)))).count() == 0


def test_chats_of_other_templates(spark):
    """Marks with characters of regular expressions, and a machine whose flags depend on its state."""
    steps = {("start", "user"): ("one", False), ("one", "tool"): ("two", True), ("two", "tool"): ("two", False), ("two", "assistant"): ("end", True)}
    template = {"open": "<|", "role_end": "|>(", "close": ").*[$]", "loss": ("assistant",), "start": "start", "accept": ("end",), "steps": steps}
    odd = ["<|user|>(x).*[$]", "\\", "\\b\\h", "a|b", "(", ").*[$]", ".*", "é\u2028", ""]
    turns = [(1, 0, "user", odd[0]), (1, 1, "tool", odd[1]), (1, 2, "tool", odd[2]), (1, 3, "assistant", odd[3])]
    turns += [(2, i, "assistant" if i % 2 else "us|er", odd[i % 9]) for i in range(40)]
    turns += [(3, i, "user" if i % 2 == 0 else "assistant", f"turn {i} " + "z" * (i % 50)) for i in range(3000)]
    turns += [(4, 0, "user", "w" * 300_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat_format.format_chats(df, template)
    got = {r["conv_id"]: r for r in chat_format.read_chats(made, template).collect()}
    for c in (1, 2, 3, 4):
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for i, _, r, x in turns if i == c]
    assert got[1]["valid"] and not got[2]["valid"] and not got[3]["valid"]
    assert got[1]["loss_text"] == odd[1] + odd[3] and got[2]["loss_text"] == "".join(x for i, _, r, x in turns if i == 2 and r == "assistant")
    for r in made.collect():
        ends = [s["start"] + s["length"] for s in r["segments"]]
        assert [s["start"] for s in r["segments"]] == [0, *ends[:-1]] and ends[-1] == len(r["formatted"])


def hit_brute(texts, items, n=10):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = tokens(t)
        m = min(n, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[s : s + m])].add(i)
    for i, t in texts:
        w, hit, found = tokens(t), set(), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                if (x := tuple(w[s : s + m])) in windows:
                    hit |= set(range(s, s + m))
                    found |= windows[x]
        yield i, len(w), len(hit), tuple(sorted(found))


def test_decontaminate(spark, rows):
    rng = random.Random(5)
    items = [(i, prose(rng, 40)) for i in range(12)] + [(20, "Short item éÉ here"), (21, "x"), (22, ""), (23, None), (24, "a " * 30), (25, "SHORT item éÉ here"), (26, prose(rng, 10))]
    items.append((27, items[3][1]))
    docs = list(rows)
    for j in range(40):
        w = items[rng.randrange(12)][1].split()
        s = rng.randrange(25)
        docs.append((2000 + j, f"{prose(rng, 9)} {' '.join(w[s : s + rng.randint(8, 14)]).upper()}, {prose(rng, 5)}. {rng.choice(('short ITEM éÉ here', 'x', ''))}", "a"))
    docs += [(3000, items[3][1] + " " + items[3][1], "a"), (3001, items[18][1], "b"), (3002, "a " * 9, "b"), (3003, "a " * 50, "b"), docs[-1]]
    got = decontaminate.decontaminate(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    mine = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], tuple(sorted(r["items"]))) for r in got)
    want = sorted((i is None, i or 0, a, b, c) for i, a, b, c in hit_brute([(i, t) for i, t, _ in docs], items))
    assert mine == want and sum(x[3] > 0 for x in mine) > 20
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got) and got[0]["source"] is not None
    assert all(r[c] == c for r in got for c in CLASHING if c not in ("items", "N_HIT")) and "N_HIT" not in got[0].asDict()
    none = decontaminate.decontaminate(documents(spark, docs), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(docs)
    assert decontaminate.decontaminate(documents(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def top_brute(rows, k=20, every=20):
    """Every pair of rows: all that the rows of one query id find is ranked together."""
    fine = [(i, [math.floor(64 * float(np.float32(v))) for v in x]) for i, x, *_ in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    scored = defaultdict(list)
    for q, x in fine:
        if q % every == 0:
            scored[q] += [(-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in fine if i != q and len(y) == len(x)]
    return sorted((q, n + 1, i, -s) for q, found in scored.items() for n, (s, i) in enumerate(sorted(found)[:k]))


@pytest.mark.parametrize(("tree", "asked"), [(150, 128), (40, 5)])
def test_top_k(spark, tree, asked):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).astype("float32") / 3
    rows = [(i, [float(v) for v in x[i % 300]], 0) for i in range(400)] + [(1000 + i, [float(v) for v in x[7]], 0) for i in range(90)]
    rows += [(2000, None, 0), (2020, [1.0, None] + [0.0] * 6, 0), (2040, [float("nan")] * 8, 0), (2060, [float("inf")] + [0.0] * 7, 0), (2080, [0.5, 0.25], 0), (2081, [0.25, 0.5], 0), (2100, [], 0), (2101, [], 0), (None, [0.0] * 8, 0)]
    # Repeated rows, repeated queries, ids with several vectors, and one with more of them than results are asked for.
    rows += [rows[3]] * 3 + [rows[20], rows[40], rows[40], (60, rows[7][1], 0), (61, rows[9][1], 0)] + [(80, [float(v) for v in x[i]], 0) for i in range(30)]
    schema = "vec_id long, embedding array<float>, key int"
    got = mtree.top_k(spark.createDataFrame(rows, schema), k=20, tree=tree, asked=asked).collect()
    assert sorted(map(tuple, got)) == top_brute(rows)
    assert mtree.top_k(spark.createDataFrame([], schema)).count() == 0 and mtree.top_k(spark.createDataFrame([(1, [0.5], 0)], schema)).count() == 0


def test_top_k_is_what_its_sql_says(spark, tmp_path):
    import duckdb

    from tidewake.llm import queries

    rows = [(20, [0.5, 0.25]), (20, [0.5, 0.25]), (1, [0.25, 0.5]), (1, [0.25, 0.5]), (2, [1.0, 0.0]), (40, [0.0, 1.0]), (40, [1.0, 1.0]), (3, [0.5])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.sql(queries.ORACLE_SQL["op10_mtree"]).fetchall()
    assert sorted(map(tuple, queries.op10_mtree(spark, str(tmp_path)).collect())) == sorted(want) == top_brute(rows)


def test_mtree_bounds_lose_nothing():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 1, (300, 4)) for c in rng.normal(0, 60, (12, 4))]).round().astype(int)
    tree = mtree.MTree(x, np.arange(len(x)), page=16)
    for q in x[::97]:
        want = sorted(((int(v), i) for i, v in enumerate(x @ q)), key=lambda t: (-t[0], t[1]))[:9]
        assert [t[:2] for t in tree.search(q, 9)] == want
        halves = [mtree.MTree(x[h::2], np.arange(len(x))[h::2], page=16) for h in (0, 1)]
        assert [t[:2] for t in halves[1].search(q, 9, None, halves[0].search(q, 9))] == want
    leaves = sum(p["child"] is None for p in tree.pages)
    assert tree.opened < 0.5 * leaves * len(x[::97])  # clusters let pages be left out
