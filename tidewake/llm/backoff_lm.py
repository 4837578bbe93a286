"""A smoothed n-gram model as a weighted automaton with failure arcs, built and run block by block."""

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch as S

#: Tokens of a block: its automaton and its documents are what one task holds.
BLOCK_TOKENS = 2_000_000
#: Buckets of hashed n-grams at least and at most, and bytes of text for each: a bucket's counts from all blocks are what
#: one counting task holds.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_BYTES = 2048, 1 << 25, 1 << 21
#: Bits by which n-grams of one bucket are told apart.
REST = 38
#: Smoothing mass of each order from 2 up; their number sets the order.
MASSES = (100.0, 3.0)
TRAIN = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 <> 2"
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b" "  # no word holds a blank


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased A-Z, runs of other than ASCII white space, then the end."""
    # bytes.split() parts at exactly \x20 and \x09-\x0D
    return [*(text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split(), END]


def mixed(a, b):
    """A 64-bit hash of pairs of 64-bit hashes."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Level:
    """The distinct n-grams of one order in a block, sorted by prefix and word: hash, count in training documents, number
    of the prefix (all but the last word) and of the suffix (all but the first) one order down, last word."""

    def __init__(self, hashes, counts, prefix, suffix, word):
        self.hashes, self.counts, self.prefix, self.suffix, self.word = hashes, counts, prefix, suffix, word


class Block:
    """Documents as word numbers; number v, the vocabulary's size, is the start of a text, which no token is."""

    def __init__(self, ids: list, held: list, sizes: list, flat: list, number: dict):
        import numpy as np
        import xxhash

        self.doc_ids, self.held, self.sizes = ids, np.array(held, bool), np.array(sizes, np.int64)
        self.words = np.array(flat, np.int32)
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64)

    def levels(self, order: int) -> list[Level]:
        """The n-grams of orders 1 to order. Those of order 1 are the words by number, then the start."""
        import numpy as np

        v = len(self.hashes)
        n = self.sizes + 1
        first = np.cumsum(n) - n
        x = np.full(int(n.sum()), v, np.int64)
        inside = np.ones(len(x), bool)
        inside[first] = False
        x[inside] = self.words
        place = np.arange(len(x)) - np.repeat(first, n)
        learned = np.repeat(~self.held, n)
        hashes = np.append(mixed(self.hashes, np.uint64(1)), np.uint64(0x5851F42D4C957F2D))
        counts = np.bincount(x[learned], minlength=v + 1)
        out = [Level(hashes, counts, np.zeros(v + 1, np.int64), np.zeros(v + 1, np.int64), np.arange(v + 1))]
        del inside, first
        before = x.copy()  # the number of the n-gram of the order before that ends here
        for j in range(2, order + 1):
            ends = np.nonzero(place >= j - 1)[0]
            grams, inverse = np.unique(before[ends - 1] * (v + 1) + x[ends], return_inverse=True)
            suffix = np.empty(len(grams), np.int64)
            suffix[inverse] = before[ends]
            counts = np.bincount(inverse[learned[ends]], minlength=len(grams))
            prefix, word = grams // (v + 1), grams % (v + 1)
            out.append(Level(mixed(mixed(out[-1].hashes[prefix], out[0].hashes[word]), np.uint64(j)), counts, prefix, suffix, word))
            before = np.full(len(x), -1, np.int64)
            before[ends] = inverse
        return out

    def dump(self) -> bytes:
        import pickle
        import zlib

        import numpy as np

        return zlib.compress(pickle.dumps((self.doc_ids, np.packbits(self.held), self.sizes, self.words, self.hashes), 5), 1)

    @classmethod
    def load(cls, data: bytes) -> "Block":
        import pickle
        import zlib

        import numpy as np

        own = cls.__new__(cls)
        own.doc_ids, held, own.sizes, own.words, own.hashes = pickle.loads(zlib.decompress(data))
        own.held = np.unpackbits(held, count=len(own.sizes)).astype(bool)
        return own


def asked(levels: list[Level], buckets: int) -> list[tuple]:
    """For words (0) and for longer n-grams (1): bucket and rest of their hashes as one number, sorted; the order that
    sorts them; their counts in that order."""
    import numpy as np

    out = []
    for kind in (levels[:1], levels[1:]):
        hashes, counts = (np.concatenate([getattr(x, c)[: len(x.hashes) - (x is levels[0])] for x in kind]) if kind else np.zeros(0, np.uint64) for c in ("hashes", "counts"))
        keys = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)) << np.uint64(REST) | hashes & np.uint64((1 << REST) - 1)
        order = np.argsort(keys, kind="stable")
        out.append((keys[order], order, counts[order].astype(np.int64)))
    return out


class Automaton:
    """States are the root, and the n-grams of orders 1 to n - 1 of a block (the start is one) that were seen in training;
    an arc reads a word from a state and leads to the longest state that the text so far ends with.

    For a context h of order j - 1, c(h) its count, h' without its first word and m the smoothing mass of order j,
    an arc whose n-gram was seen weighs log10 of p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m). Otherwise the failure
    arc weighs log10(m / (c(h) + m)) and leads to h', and so on down to the root, where w weighs log10 of
    p(w) = (c(w) + 1) / (N + V + 1). The probabilities of a state sum to 1.
    """

    def __init__(self, levels: list[Level], totals: list, n: int, distinct: int, masses: tuple):
        import numpy as np

        self.v = len(levels[0].hashes)  # the start is a word that is never read
        p = (totals[0] + 1) / (n + distinct + 1)
        self.root = np.log10(p)
        first = np.cumsum([1, *(len(t) for t in totals[:-1])])  # the number of each order's first state
        self.start = int(first[0]) + self.v - 1
        self.leads = np.where(totals[0] > 0, first[0] + np.arange(self.v), 0) if len(levels) > 1 else np.zeros(self.v, np.int64)
        suffix, fail, arcs, weights, leads = [np.zeros(1 + self.v, np.int64)], [np.zeros(1)], [], [], []
        for j, mass in enumerate(masses, 1):
            level, context = levels[j], totals[j - 1]
            fail.append(np.log10(mass / (context + mass)))
            seen = totals[j] > 0
            p = np.where(seen, (totals[j] + mass * p[level.suffix]) / (context[level.prefix] + mass), 0.0)
            last = j == len(masses)
            to = first[j - 1] + level.suffix if last else first[j] + np.arange(len(seen))
            arcs.append(((first[j - 1] + level.prefix) * self.v + level.word)[seen])
            weights.append(np.log10(p[seen]))
            leads.append(to[seen])
            if not last:
                suffix.append(first[j - 1] + level.suffix)
        self.suffix, self.fail = np.concatenate(suffix), np.concatenate(fail)
        self.arcs, self.weights, self.to = (np.concatenate([*x, [-1]]) for x in (arcs, weights, leads))  # the last is none
        self.first = np.searchsorted(self.arcs[:-1], np.arange(len(self.fail) + 1) * self.v)  # each state's arcs lie together

    def step(self, states, words):
        """What reading words from states weighs, and the states it leads to: by an arc, or down failure arcs first."""
        import numpy as np

        out, to = np.zeros(len(states)), np.zeros(len(states), np.int64)
        todo, own = np.arange(len(states)), states
        while len(todo):
            read = words[todo]
            key, at = own * self.v + read, self.first[own]
            found = (self.arcs[at] == key) & (own > 0)  # most contexts have one arc
            more = np.nonzero(~found & (self.first[own + 1] > at + 1))[0]
            at[more] = np.searchsorted(self.arcs[:-1], key[more])
            found[more] = self.arcs[at[more]] == key[more]
            hit = todo[found]
            out[hit] += self.weights[at[found]]
            to[hit] = self.to[at[found]]
            ended = ~found & (own == 0)
            hit = todo[ended]
            out[hit] += self.root[read[ended]]
            to[hit] = self.leads[read[ended]]
            left = ~found & ~ended
            todo, own = todo[left], own[left]
            out[todo] += self.fail[own]
            own = self.suffix[own]
        return out, to

    def traverse(self, words, sizes):
        """Left to right over all documents of a block side by side: one state and one sum for each."""
        import numpy as np

        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        active = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")  # documents longer than t
        total, states = np.zeros(len(sizes)), np.full(len(sizes), self.start if len(self.fail) > 1 else 0, np.int64)
        for t, n in enumerate(active.tolist()):
            weight, states[:n] = self.step(states[:n], words[starts[:n] + t].astype(np.int64))
            total[:n] += weight
        out = np.empty(len(sizes))
        out[order] = total
        return out


def blocks(batches, limit: int) -> Iterator[Block]:
    ids, held, sizes, flat, number = [], [], [], [], {END: 0}
    for batch in batches:
        for doc_id, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = tokens(text.as_py())
            ids.append(doc_id)
            held.append(not train)
            sizes.append(len(words))
            flat.extend([number.setdefault(w, len(number)) for w in words])
            if len(flat) >= limit:
                block = [Block(ids, held, sizes, flat, number)]
                ids, held, sizes, flat, number, words = [], [], [], [], {END: 0}, None
                yield block.pop()  # nothing of it is held here
    if ids:
        block = [Block(ids, held, sizes, flat, number)]
        ids, held, sizes, flat, number, words, batch = [], [], [], [], {}, None, None
        yield block.pop()


def packed_keys(rest) -> bytes:
    """Sorted numbers as their differences, in 4 bytes each if they fit."""
    import numpy as np

    gaps = np.diff(rest, prepend=np.uint64(0))
    width = 4 if gaps.max(initial=0) < 1 << 32 else 8
    return bytes([width]) + gaps.astype(f"<u{width}").tobytes()


def keys_of(data: bytes):
    import numpy as np

    return np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint64))


def packed_counts(counts) -> bytes:
    """A byte for each count, 255 for those of 255 and more, which follow whole."""
    import struct
    import zlib

    import numpy as np

    counts = np.asarray(counts, np.uint64)
    small = np.minimum(counts, 255).astype(np.uint8)
    return struct.pack("<Q", len(small)) + zlib.compress(small.tobytes() + counts[small == 255].astype("<u8").tobytes(), 1)


def counts_of(data: bytes):
    import struct
    import zlib

    import numpy as np

    (n,), raw = struct.unpack_from("<Q", data), zlib.decompress(data[8:])
    out = np.frombuffer(raw, np.uint8, n).astype(np.uint64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n)
    return out


def score(docs: DataFrame, train: str = TRAIN, masses: tuple = MASSES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Log10 probabilities of whole texts (doc_id, text) under an n-gram model of all rows for which train holds; n is the
    number of masses plus 1.

    1. Tasks turn documents into blocks, files of word numbers in the shared folder, and send for each block
       and bucket the hashes of its n-grams with their training counts: one row, already summed.
    2. A task for each bucket adds up the counts of all blocks and answers each with the totals of its own
       n-grams, in its order. No task and no driver holds the corpus' n-grams; they grow with the corpus, and
       the buckets with the bytes of its texts.
    3. A task for each block builds the automaton over its n-grams and reads its documents through it.
    Words meet by 64-bit hashes, n-grams by a bucket and 38 bits in it; buckets are of like size whatever the input.
    Null and empty texts hold the end alone; a very long text is a block of its own. Repeated rows all count. Without
    rows the result is empty; without training rows every token has p = 1. Other columns play no part.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    here = S.scratch(spark, "lm")
    order = len(masses) + 1
    # Texts that train counts, times that the start is a context; bytes of all.
    texts, size = docs.agg(F.count(F.when(F.expr(train), 1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 4 * S.shuffles(spark), math.ceil(size / BUCKET_BYTES)))

    def count(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        S.thrifty()
        edges = np.arange(buckets, dtype=np.uint64) << np.uint64(REST)
        i = -1
        for block in blocks(batches, block_tokens):
            i += 1
            data = block.dump()
            name = f"{TaskContext.get().partitionId()}-{i}-{zlib.crc32(data):08x}"
            S.put(f"{here}/blocks/{name}", data)
            levels = [block.levels(order)]
            del data, block
            for kind, (keys, _, counts) in enumerate(asked(levels.pop(), buckets)):
                cut = [*np.searchsorted(keys, edges).tolist(), len(keys)]
                parts = [(b, cut[b], cut[b + 1]) for b in range(buckets) if cut[b] < cut[b + 1]]
                rest = keys & np.uint64((1 << REST) - 1)
                for low in range(0, len(parts), 512):
                    now = parts[low : low + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(now), pa.int32()), pa.array([b for b, *_ in now], pa.int32()), pa.array([name] * len(now)), pa.array([packed_keys(rest[x:y]) for _, x, y in now], pa.binary()), pa.array([packed_counts(counts[x:y]) for _, x, y in now], pa.binary())],
                        ["kind", "bucket", "block", "keys", "counts"],
                    )
                del keys, counts, rest
            S.trim()

    def total(table):
        import numpy as np
        import pyarrow as pa

        keys = [keys_of(k) for k in table.column("keys").to_pylist()]
        counts = [counts_of(c) for c in table.column("counts").to_pylist()]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(distinct), np.uint64)
        np.add.at(sums, at, np.concatenate(counts))
        cut = np.cumsum([0, *map(len, keys)])
        words = table.column("kind")[0].as_py() == 0
        stats = [int((sums > 0).sum()), int(sums.sum())] if words else [0, 0]
        n = len(keys)
        return pa.table({
            "kind": table.column("kind"), "bucket": table.column("bucket"), "block": table.column("block"),
            "totals": pa.array([packed_counts(sums[at[cut[i] : cut[i + 1]]]) for i in range(n)], pa.binary()),
            "distinct": pa.array([stats[0] if i == 0 else 0 for i in range(n)], pa.int64()), "n": pa.array([stats[1] if i == 0 else 0 for i in range(n)], pa.int64()),
        })

    sent = docs.select("doc_id", F.expr(train).alias("train"), "text").mapInArrow(count, "kind int, bucket int, block string, keys binary, counts binary")
    answers = S.saved(sent.groupBy("kind", "bucket").applyInArrow(total, "kind int, bucket int, block string, totals binary, distinct long, n long"), f"{here}/answers")
    distinct, n = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(table):
        import numpy as np
        import pyarrow as pa

        S.thrifty()
        S.trim()
        block = Block.load(S.get(f"{here}/blocks/{table.column('block')[0].as_py()}"))
        levels = block.levels(order)
        rows = sorted(zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("totals").to_pylist(), strict=True))
        totals = []
        for kind, (keys, places, _) in enumerate(asked(levels, buckets)):
            sums = np.zeros(len(keys), np.int64)
            if len(keys):
                sums[places] = np.concatenate([counts_of(t) for k, _, t in rows if k == kind]).astype(np.int64)
            totals.append(sums)
        del rows, keys, places
        cut = np.cumsum([0, *(len(x.hashes) for x in levels[1:])])
        counts = totals[0]
        totals = [np.append(counts, texts), *(totals[1][cut[i] : cut[i + 1]] for i in range(order - 1))]
        model = Automaton(levels, totals, n, distinct, masses)
        del levels, totals, sums
        S.trim()
        starts = np.cumsum(block.sizes) - block.sizes
        add = lambda x: np.add.reduceat(x[block.words], starts)
        return pa.table({
            "doc_id": pa.array(block.doc_ids, pa.int64()), "held_out": pa.array(block.held), "n_tokens": pa.array(block.sizes), "n_known": pa.array(add((counts > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(starts), n, np.int64)), "base_score": pa.array(add(model.root)), "score": pa.array(model.traverse(block.words, block.sizes)),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answers.select("kind", "bucket", "block", "totals").groupBy("block").applyInArrow(run, schema)
