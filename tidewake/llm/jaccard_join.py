"""Sets of word shingles that overlap: count vectors, R-trees and exact checks."""

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch as S
from .backoff_lm import _UPPER, mixed
from .components import components

#: Words of a block, which is what one task holds; of a slice, which is hashed at once; rows of a page of a shared key's members.
BLOCK_WORDS, SLICE, PAGE_ROWS = 1_000_000, 60_000, 16_384
#: Buckets of keys at least, and bytes of text for each: keys take about as much.
LEAST_BUCKETS, BUCKET_BYTES = 512, 1 << 23
#: Bits of a block's number in its task, and of a row's in its block.
SEQ_BITS, ROW_BITS = 18, 24
ROW = (1 << ROW_BITS) - 1
#: Coordinates of a count vector, at most of a fine one, and entries of an R-tree node.
COORDINATES, MOST_COORDINATES, NODE = 128, 4096, 32
#: Tasks that send a block's sets; bytes of a batch of sets; rows of a table up to which it is broadcast.
SPREAD, SENT_BYTES, BROADCAST_ROWS = 4, 1 << 20, 1_000_000
#: Rows of a batch of keys, one for each bucket.
SENT_PARTS = 1024


def differing(s: int, t: int, num: int, den: int) -> int:
    """The most elements that only one of two linked sets of these sizes can hold."""
    return (s + t) * (den - num) // (den + num)


def overlap(s, t, num: int, den: int):
    """The least intersection that links: den * i >= num * (s + t - i)."""
    return -(-(num * (s + t)) // (den + num))


#: What a row of a weak group costs against one of a strong group, where the number of groups is chosen.
WEAK_COST = 200


def size_classes(most: int, num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(least size, groups, least strong group, weak groups let go) of each class, least sizes growing by half.

    A set's elements fall into groups by a hash. Linked sets of a class differ in at most d elements, so at
    most d groups; of d + 1 + e groups e + 1 agree as wholes. Groups of under m elements are weak: many sets
    may share one. A set with at most e of them need only be met by its strong groups. Any e and m lose
    nothing; those are taken that make the fewest rows and rarely send weak groups."""
    out, low = [], 1
    while low <= most:
        high = max(low + 1, low * 3 // 2)
        d = differing(high - 1, high - 1, num, den)
        least = -(-low * num // den)
        k, best = d + 1, None
        while k <= 2 * (d + 1) + 4:
            for m in (1, 2, 3):
                cost = 0.0
                for size in (least, (least + low) // 2, low, (low + high) // 2, high - 1):
                    rate = size / k
                    p = math.exp(-rate) * sum(rate**i / math.factorial(i) for i in range(m))
                    spread = max(1e-9, k * (p - p * p * (1 + rate)) if m == 1 else k * p * (1 - p))
                    cost += k * (1 - p) + WEAK_COST * k * p * math.erfc((k - d - 0.5 - k * p) / math.sqrt(2 * spread)) / 2
                best = min(best or (math.inf,), (cost, k, m, k - 1 - d))
            k += max(1, k >> 6)
        out.append((low, *best[1:]))
        low = high
    return out


class Shingles:
    """Distinct hashed shingles of a block of texts: hashes[cut[i] : cut[i + 1]] are those of row i, sorted.
    They are made for SLICE words at a time: texts don't depend on each other, and passing values need no more room."""

    def __init__(self, words, sizes, vocabulary, k: int):
        import numpy as np

        parts = [self._made(words[a:b], sizes[i:j], vocabulary, k) for i, j, a, b in slices(np.cumsum(sizes))]
        self.hashes = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
        self.sizes = np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)
        self.cut = np.concatenate(([0], np.cumsum(self.sizes)))

    @classmethod
    def _made(cls, words, sizes, vocabulary, k):
        import numpy as np

        if len(sizes) == 1 and len(words) > 2 * SLICE:  # a long text: its own slices overlap by the words that a shingle spans
            parts = [cls._hashed(words[a : a + SLICE + k - 1], np.array([min(SLICE + k - 1, len(words) - a)]), vocabulary, k)[1] for a in range(0, len(words) - k + 1, SLICE)]
            value = np.unique(np.concatenate(parts))
            return value, np.array([len(value)])
        doc, value = cls._hashed(words, sizes, vocabulary, k)
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        return value[new], np.bincount(doc[new], minlength=len(sizes))

    @staticmethod
    def _hashed(words, sizes, vocabulary, k):
        """(row, hash) of each shingle."""
        import numpy as np

        h = vocabulary[words] if len(words) else np.zeros(0, np.uint64)
        n = len(sizes)
        doc = np.repeat(np.arange(n), sizes)
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        of = sizes[doc]
        value = h.copy()
        for i in range(1, k):  # of a text with fewer than k words its first shingle is the whole
            ahead = np.zeros_like(h)
            ahead[: max(0, len(h) - i)] = h[i:]
            value = np.where(place + i < of, mixed(value, ahead), value)
        starts = (place + k <= of) | ((of < k) & (place == 0))
        return doc[starts], mixed(value[starts], np.minimum(of[starts], k).astype(np.uint64))

    def of(self, row: int):
        return self.hashes[self.cut[row] : self.cut[row + 1]]

    def vectors(self):
        """Counts of each row's elements in COORDINATES groups of another hash."""
        import numpy as np

        out = np.zeros((len(self.sizes), COORDINATES), np.uint16 if self.sizes.max(initial=0) < 1 << 16 else np.int32)
        for i, j, a, b in slices(self.cut[1:]):
            docs = np.repeat(np.arange(j - i), self.sizes[i:j])
            for low in range(a, b, SLICE):
                group = (mixed(self.hashes[low : min(b, low + SLICE)], np.uint64(77)) >> np.uint64(40)).astype(np.int64) % COORDINATES
                np.add.at(out[i:j].reshape(-1), docs[low - a : low - a + len(group)] * COORDINATES + group, 1)
        return out

    def some(self, rows):
        """The rows given, in their order."""
        import numpy as np

        own = Shingles.__new__(Shingles)
        own.hashes = np.concatenate([self.of(i) for i in rows.tolist()]) if len(rows) else self.hashes[:0]
        own.sizes = self.sizes[rows]
        own.cut = np.concatenate(([0], np.cumsum(own.sizes)))
        return own


def slices(ends):
    """(first row, end row, first element, end element) of runs of rows with SLICE elements or so, by the ends of rows."""
    import numpy as np

    i, a = 0, 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, a + SLICE, side="right")))
        yield i, j, a, int(ends[j - 1])
        i, a = j, int(ends[j - 1])


class Node:
    """Points below it, or children: the greatest of each coordinate, the least size and the range of their parts; its
    component if it has one only."""

    __slots__ = ("most", "least", "low", "high", "only", "rows", "children", "box")

    def __init__(self, most, least, low, high, only, rows=None, children=None):
        import numpy as np

        self.most, self.least, self.low, self.high, self.only, self.rows, self.children = most, least, low, high, only, rows, children
        self.box = np.array([c.most for c in children]) if children else None


class RTree:
    """Count vectors in a packed R-tree. Points of different parts never link, so they are first parted by these."""

    def __init__(self, points, sizes, labels, parts=None):
        import numpy as np

        self.points, self.sizes, self.labels = points, sizes, labels
        self.parts = np.zeros(len(points), np.int64) if parts is None else parts
        leaves, todo = [], [np.argsort(self.parts, kind="stable")] if len(points) else []
        while todo:  # halve by parts, then along the widest coordinate, until a node's worth is left
            rows = todo.pop()
            if len(rows) <= NODE:
                own = labels[rows]
                leaves.append(Node(points[rows].max(0), int(sizes[rows].min()), int(self.parts[rows].min()), int(self.parts[rows].max()), int(own[0]) if (own == own[0]).all() else -1, rows))
                continue
            if self.parts[rows[0]] == self.parts[rows[-1]]:
                wide = np.ptp(points[rows], axis=0).argmax()
                rows = rows[np.argsort(points[rows, wide], kind="stable")]
            todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
        level = leaves
        while len(level) > 1:
            up = []
            for i in range(0, len(level), NODE):
                part = level[i : i + NODE]
                same = {p.only for p in part}
                up.append(Node(np.max([p.most for p in part], axis=0), min(p.least for p in part), min(p.low for p in part), max(p.high for p in part), same.pop() if len(same) == 1 else -1, None, part))
            level = up
        self.root = level[0] if level else None

    def search(self, point, size: int, label: int, num: int, den: int) -> list[int]:
        """Points of other components whose overlap with this one may reach the least that links: summed coordinate minima bound it."""
        import numpy as np

        found, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node.only == label and label != -1 or np.minimum(point, node.most).sum() < overlap(size, node.least, num, den):
                continue
            if node.children is not None:
                stack += node.children
                continue
            rows = node.rows
            fits = (self.labels[rows] != label) & (np.minimum(self.points[rows], point).sum(1) >= overlap(size, self.sizes[rows], num, den))
            found += rows[fits].tolist()
        return found

    def meet(self, other: "RTree", num: int, den: int) -> Iterator[tuple]:
        """(rows of this, rows of the other, summed minima of each pair) of leaves that may hold pairs which link; of
        a tree and itself every two leaves meet once. Both trees' boxes bound the pairs below them."""
        import numpy as np

        def boxes(a, b):
            return np.minimum(a[:, None, :], b[None, :, :]).sum(2, dtype=np.int64)

        stack = [(self.root, other.root)] if self.root and other.root else []
        while stack:
            a, b = stack.pop()
            if a.high < b.low or b.high < a.low:
                continue
            if a.children is None and b.children is None:
                yield a.rows, b.rows, boxes(self.points[a.rows], other.points[b.rows])
                continue
            left, right = a.children or [a], b.children or [b]
            bound = boxes(a.box if a.children else a.most[None], b.box if b.children else b.most[None])
            need = np.array([[overlap(x.least, y.least, num, den) for y in right] for x in left])
            for i, j in np.argwhere(bound >= need).tolist():
                if a is not b or i <= j:
                    stack.append((left[i], right[j]))


def group_keys(s: Shingles, wanted, classes: list, num: int, den: int):
    """(key, row) of each emitted group of the rows where wanted, slice by slice."""
    import numpy as np

    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for i, j, a, b in slices(s.cut[1:]):
        for key, row in _group_keys(s.hashes[a:b], s.sizes[i:j], wanted[i:j], classes, num, den):
            keys.append(key)
            owners.append((row + i).astype(np.uint32))
    return np.concatenate(keys), np.concatenate(owners)


def _group_keys(hashes, sizes, wanted, classes, num, den):
    import numpy as np

    lows = np.array([c[0] for c in classes])
    own = np.searchsorted(lows, sizes, side="right") - 1
    last = np.searchsorted(lows, sizes * den // num, side="right") - 1
    docs = np.repeat(np.arange(len(sizes)), sizes)
    wanted = wanted & (sizes > 0)
    step = 0
    while (now := wanted & (own + step <= last)).any():
        klass = own + step
        k = np.where(now, np.array([c[1] for c in classes])[klass], 0)
        first = np.cumsum(k) - k
        total = int(k.sum())
        content, count = np.zeros(total, np.uint64), np.zeros(total, np.int64)
        for a in range(0, len(hashes), SLICE):
            inside = now[docs[a : a + SLICE]]
            doc, h = docs[a : a + SLICE][inside], hashes[a : a + SLICE][inside]
            slot = first[doc] + (mixed(h, np.uint64(13)) >> np.uint64(32)).astype(np.int64) % k[doc]
            np.add.at(content, slot, mixed(h, np.uint64(29)))
            np.add.at(count, slot, 1)
        doc_of = np.repeat(np.arange(len(k)), k)
        weak = count < np.array([c[2] for c in classes])[klass[doc_of]]
        many = np.bincount(doc_of[weak], minlength=len(k)) > np.array([c[3] for c in classes])[klass]
        out = ~weak | many[doc_of]
        number = (np.arange(total) - first[doc_of]).astype(np.uint64) + (klass[doc_of].astype(np.uint64) << np.uint64(40))
        yield mixed(content, mixed(number, np.uint64(3)))[out], doc_of[out]
        step += 1


def stars(keys, members) -> Iterator:
    """(key, least member, other member) of each key with two members or more; and each key's least member."""
    import numpy as np

    order = np.lexsort((members, keys))
    keys, members = keys[order], members[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (members[1:] != members[:-1])
    keys, members = keys[new], members[new]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    pivot = members[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))] if len(keys) else members
    return (keys[~first], pivot[~first], members[~first]), (keys[first], members[first])


def fine(n: int) -> int:
    """Coordinates of the fine count vector of a set of n elements: a power of two from n / 2 on, within bounds."""
    return min(max(COORDINATES, 1 << max(0, (n + 1) // 2 - 1).bit_length()), MOST_COORDINATES)


def packed(hashes) -> bytes:
    """The fine count vector of a set, in 4 bits a count where all are below 16, else in 1 or 4 bytes. Element groups are
    those of Shingles.vectors, divided further, so that folds of it are the vectors of fewer coordinates."""
    import numpy as np

    d = fine(len(hashes))
    v = np.bincount((mixed(hashes, np.uint64(77)) >> np.uint64(40)).astype(np.int64) % d, minlength=d)
    most = int(v.max())
    if most < 16:
        v = v.astype(np.uint8)
        return (v[0::2] | v[1::2] << 4).tobytes()
    return v.astype("<u1" if most < 256 else "<u4").tobytes()


def unpacked(data, n: int):
    import numpy as np

    d, raw = fine(n), np.frombuffer(data, "<u1")
    if len(raw) * 2 == d:
        return np.stack((raw & 15, raw >> 4), axis=1).reshape(-1).astype(np.int32)
    return raw.astype(np.int32) if len(raw) == d else raw.view("<u4").astype(np.int32)


def folded(v, d: int):
    """A count vector in d coordinates, of which its own are a multiple."""
    return v if len(v) == d else v.reshape(-1, d).sum(0)


def common(x, y) -> int:
    """Summed minima of two fine vectors in the coordinates of the coarser: at least what their sets share."""
    import numpy as np

    d = min(len(x), len(y))
    return int(np.minimum(folded(x, d), folded(y, d)).sum())


def gathered(members: DataFrame, here: str) -> DataFrame:
    """Members (key, id, root, rank) of keys by hubs: a key's hub is its greatest rank, and a hub has all members of its
    keys, each once. Members that share a key share its hub, and keys with nearly the same members mostly have one hub,
    so that a pair which shares hundreds of keys meets a few times. Keys of two members are left out.
    Returns key (the hub's), id, root."""
    hubs = S.saved(members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("hub")).where("n > 2").select("key", "hub"), f"{here}/hubs")
    return members.join(few(hubs), "key").select(F.col("hub").alias("key"), "id", "root").distinct()


def links(a, b, num: int, den: int) -> bool:
    """Whether two sets of distinct hashes link: den * |a n b| >= num * |a u b|."""
    import numpy as np

    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    i = int((both[1:] == both[:-1]).sum())
    return den * i >= num * (len(a) + len(b) - i)


def digests(s: Shingles) -> list:
    """Two sums of hashes of each set's elements; with its size they tell equal sets."""
    import numpy as np

    out = [np.zeros(len(s.sizes), np.uint64) for _ in range(2)]
    for i, j, a, b in slices(s.cut[1:]):
        at = np.minimum(s.cut[i:j] - a, b - a)
        for sums, seed in zip(out, (41, 43), strict=True):
            sums[i:j] = np.add.reduceat(np.append(mixed(s.hashes[a:b], np.uint64(seed)), np.uint64(0)), at)
    return out


def short(hashes):
    """The top 16 bits of a sorted set's hashes, sorted."""
    return (hashes >> 48).astype("<u2")


def told_apart(values):
    """Sorted 16-bit values with the number of equal ones before each: two such sets share at least as much as their sets."""
    import numpy as np

    place = np.arange(len(values))
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return values.astype(np.uint64) << np.uint64(32) | (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)


def resolved(s: Shingles, pivot, member, classes: list, num: int, den: int):
    """The least row of each row's component within a block. Rows that share a key with another make one R-tree of
    count vectors for each size class. Trees of classes whose sizes may link meet, and every pair of points across
    components that the summed coordinate minima let through is checked on its sets, the likeliest of two leaves
    first. Two rows that link share a key, so rows which no chain of shared keys joins are told apart by the tree."""
    import numpy as np

    root = list(range(len(s.sizes)))
    part = list(root)

    def find(of, i):
        while of[i] != i:
            of[i] = i = of[of[i]]
        return i

    def join(of, a, b):
        x, y = find(of, a), find(of, b)
        of[max(x, y)] = min(x, y)

    for a, b in np.unique(np.stack((pivot, member), 1).astype(np.int64), axis=0).tolist():
        join(part, a, b)
    rows = np.unique(np.concatenate((pivot, member)).astype(np.int64))
    if not len(rows):
        return np.arange(len(root))
    own = s.some(rows)
    points, parts = own.vectors(), np.array([find(part, i) for i in rows.tolist()], np.int64)
    lows = np.array([c[0] for c in classes])
    klass = np.searchsorted(lows, own.sizes, side="right") - 1
    trees = {}
    for c in np.unique(klass).tolist():
        at = np.nonzero(klass == c)[0]
        trees[c] = (at, RTree(points[at], own.sizes[at], at, parts[at]))
    for c, (at, tree) in trees.items():
        top = int(np.searchsorted(lows, int(own.sizes[at].max()) * den // num, side="right")) - 1
        for d in range(c, top + 1):
            if d not in trees:
                continue
            for left, right, sums in tree.meet(trees[d][1], num, den):
                x, y = at[left], trees[d][0][right]
                n, m = own.sizes[x][:, None], own.sizes[y][None, :]
                fits = (sums >= overlap(n, m, num, den)) & (np.minimum(n, m) * den >= np.maximum(n, m) * num) & (parts[x][:, None] == parts[y][None, :])
                if c == d and left is right:
                    fits &= np.triu(np.ones(fits.shape, bool), 1)
                if not fits.any():
                    continue
                a, b = np.array([find(root, i) for i in rows[x].tolist()]), np.array([find(root, i) for i in rows[y].tolist()])
                pairs = np.argwhere(fits & (a[:, None] != b[None, :]))
                likely = sums[pairs[:, 0], pairs[:, 1]] / (n[pairs[:, 0], 0] + m[0, pairs[:, 1]])
                for i, j in pairs[np.argsort(-likely, kind="stable")].tolist():
                    p, q = int(rows[x[i]]), int(rows[y[j]])
                    if find(root, p) != find(root, q) and links(s.of(p), s.of(q), num, den):
                        join(root, p, q)
    return np.array([find(root, i) for i in range(len(root))], np.int64)


def read_blocks(batches, limit: int) -> Iterator[tuple]:
    """((ids, hashes of texts), words, sizes, vocabulary) of blocks of texts."""
    import numpy as np
    import xxhash

    def made(ids, flat, sizes, number):
        return tuple(zip(*ids, strict=True)), np.array(flat, np.int32), np.array(sizes, np.int64), np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64)

    ids, flat, sizes, number = [], [], [], {}
    for batch in batches:
        for doc_id, text, hashed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
            ids.append((doc_id, hashed))
            sizes.append(len(words))
            flat.extend([number.setdefault(w, len(number)) for w in words])
            if len(flat) + len(ids) >= limit:
                block = [made(ids, flat, sizes, number)]
                ids, flat, sizes, number, words = [], [], [], {}, None
                yield block.pop()  # nothing of it is held here
    if ids:
        block = [made(ids, flat, sizes, number)]
        ids, flat, sizes, number, words, batch = [], [], [], {}, None, None
        yield block.pop()


def few(rows: DataFrame) -> DataFrame:
    """Broadcast up to a count of rows, which hold two longs at most; beyond, the join shuffles."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def numbered(partition: int, seq: int) -> int:
    """A block's number; it stays below 2^39, so that it and a row's number make one long."""
    if seq >= 1 << SEQ_BITS or partition >= 1 << 39 - SEQ_BITS:
        raise OverflowError(f"block {seq} of task {partition}: read the texts in more tasks")
    return partition << SEQ_BITS | seq


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, block_words: int = BLOCK_WORDS, here: str | None = None) -> DataFrame:
    """Components of documents (doc_id, text) whose sets of k-word shingles have den * |A n B| >= num * |A u B|.

    1. Tasks turn texts into blocks (files of word numbers in the shared folder) and deal each distinct set's
       elements into groups; any two linked sets share a group's hash, their key. A block's own links are
       found in its task. Then only the first member of each key is sent to the key's bucket: a key that a
       third of all rows share reaches its bucket once per block.
    2. Pairs of a key's first and another block's first are checked on their whole sets: for each component of
       a block the pair with most keys in common, then the pairs whose components are still apart and whose
       count vectors may overlap enough. A set is sent once to each block that has members to check it with,
       which reads their sets from its file: first as digests, which tell equal sets, and 16 bits of each
       element, which bound the overlap from above; then whole, for pairs still open. Components of blocks so join.
    3. Keys whose members still lie in several components get the rest: the blocks list all their members, which
       are gathered by hubs, and those outside a hub's largest component are looked up in R-trees over the count
       vectors, part by part and page by page; summed coordinate minima bound the overlap, then those of vectors
       with more coordinates for larger sets, and every pair across components and blocks that survives is checked.
       So no link is lost.
    What only serves on the way goes from the shared folder (here: a new one) as soon as nothing reads it any more.
    Elements are 64-bit hashes. Null and empty texts have an empty set and no link. A text with fewer than k
    words is one shingle. Repeated rows all stay. docs is read twice if it isn't a table: it must be the same
    rows in the same order each time, as a table's are. Returns doc_id, n_shingles, component_id (least id of
    the component; for rows without one, the own id), component (its number; rows without words each have
    their own), text_hash (xxhash64 of the text).
    """
    spark = docs.sparkSession
    here = here or S.scratch(spark, "jaccard")
    # A word takes two bytes with the blank after it: no set is larger than half the longest text. Buckets follow the input.
    total, longest = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, 4 * S.shuffles(spark), math.ceil(total / BUCKET_BYTES))
    classes = size_classes(longest // 2 + 1, num, den)

    def sketch(batches):
        import pickle
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        S.thrifty()
        seq = -1
        for ids, words, sizes, vocabulary in read_blocks(batches, block_words):
            seq += 1
            number = numbered(TaskContext.get().partitionId(), seq)
            s = Shingles(words, sizes, vocabulary, k)
            S.put(f"{here}/blocks/{number}", zlib.compress(pickle.dumps((words, sizes, vocabulary), 5), 1))
            del words, vocabulary
            sums = digests(s)
            first: dict[tuple, int] = {}
            copy = np.array([first.setdefault((n, a, b) if n else (0, i, 0), i) for i, (n, a, b) in enumerate(zip(s.sizes.tolist(), sums[0].tolist(), sums[1].tolist(), strict=True))], np.int64)
            del first, sums
            keys, owners = group_keys(s, copy == np.arange(len(copy)), classes, num, den)
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            keys &= np.uint64(0xFFFFFFFF)
            keys |= bucket << np.uint64(32)
            del bucket
            (star, pivot, member), (keys, owners) = stars(keys, owners)
            root = resolved(s, pivot, member, classes, num, den)
            other = root[pivot] != root[member]  # one member for each further component of a key
            extra = np.unique(np.stack((star[other].astype(np.int64), root[member[other]])), axis=1)
            held = s.sizes
            del s, pivot, other
            S.put(f"{here}/held/{number}", zlib.compress(pickle.dumps((ids, held, copy, root, keys, owners, star, member, extra), 5), 1))
            del star, member, extra, ids, held, copy
            cut = np.searchsorted(keys >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            some = np.nonzero(cut[1:] > cut[:-1])[0]
            parts = list(zip(some.tolist(), cut[some].tolist(), cut[some + 1].tolist(), strict=True))
            low, roots, owners = (keys & np.uint64(0xFFFFFFFF)).astype("<u4"), root[owners].astype("<u4"), owners.astype("<u4")
            del keys, root
            S.trim()
            for i in range(0, len(parts) + 1, SENT_PARTS):  # the first one says that there is this block
                now = parts[max(0, i - 1) : i + SENT_PARTS - 1]
                mark = [b""] * (i == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1 - number % 64] * (i == 0) + [b for b, *_ in now], pa.int32()), pa.array([number] * (len(now) + (i == 0)), pa.int64()), *(pa.array(mark + [v[x:y].tobytes() for _, x, y in now], pa.binary()) for v in (low, owners, roots))],
                    ["bucket", "block", "keys", "owners", "roots"],
                )
            del low, roots, owners
            S.trim()

    def meet(table):
        import numpy as np
        import pyarrow as pa

        bucket, numbers = table.column("bucket")[0].as_py(), table.column("block").to_pylist()
        if bucket < 0:  # what blocks there are
            none = pa.array([-1] * len(numbers), pa.int64())
            return pa.table({"key": none, "a": pa.array(numbers, pa.int64()), "b": none, "ra": none, "rb": none})
        keys = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
        owners, roots = (np.concatenate([np.frombuffer(x, "<u4").astype(np.int64) + (n << ROW_BITS) for x, n in zip(table.column(c).to_pylist(), numbers, strict=True)]) for c in ("owners", "roots"))
        (key, pivot, member), _ = stars(np.concatenate(keys).astype(np.int64) + (bucket << 32), owners)
        order = np.argsort(owners, kind="stable")
        of = lambda x: roots[order[np.searchsorted(owners[order], x)]]
        return pa.table({"key": pa.array(key, pa.int64()), "a": pa.array(pivot, pa.int64()), "b": pa.array(member, pa.int64()), "ra": pa.array(of(pivot), pa.int64()), "rb": pa.array(of(member), pa.int64())})

    sent = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sketch, "bucket int, block long, keys binary, owners binary, roots binary")
    met = S.saved(sent.groupBy("bucket").applyInArrow(meet, "key long, a long, b long, ra long, rb long"), f"{here}/met")
    numbers = S.saved(met.where("key = -1").select(F.col("a").alias("block")), f"{here}/numbers").repartition(S.shuffles(spark), "block")

    def rows_of(batches):
        import pickle
        import zlib

        import pyarrow as pa

        for batch in batches:
            for n in batch.column(0).to_pylist():
                (ids, hashed), sizes, copy, root, *_ = pickle.loads(zlib.decompress(S.get(f"{here}/held/{n}")))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashed, pa.int64()), pa.array(sizes, pa.int64()), pa.array(root[copy] + (n << ROW_BITS), pa.int64())], ["doc_id", "text_hash", "n_shingles", "root"])

    def extras_of(batches):
        import pickle
        import zlib

        import pyarrow as pa

        for batch in batches:
            for n in batch.column(0).to_pylist():
                key, root = pickle.loads(zlib.decompress(S.get(f"{here}/held/{n}")))[-1]
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(root + (n << ROW_BITS), pa.int64())], ["key", "root"])

    def members_of(table):
        import pickle
        import zlib

        import numpy as np
        import pyarrow as pa

        n = table.column("block")[0].as_py()
        _, _, _, root, keys, owners, star, member, _ = pickle.loads(zlib.decompress(S.get(f"{here}/held/{n}")))
        wanted = np.unique(table.column("key").to_numpy().astype(np.uint64))
        first, more = np.isin(keys, wanted), np.isin(star, wanted)
        key, own = np.concatenate((keys[first], star[more])).astype(np.int64), np.concatenate((owners[first], member[more])).astype(np.int64)
        ids = own + (n << ROW_BITS)
        # Rows with many keys come first, then a hash decides; rows of one rank would only share their hubs.
        often = np.minimum(np.bincount(own, minlength=len(root)), (1 << 20) - 1)[own]
        rank = often << 43 | (mixed(ids.astype(np.uint64), np.uint64(7)) >> np.uint64(21)).astype(np.int64)
        return pa.table({"key": pa.array(key, pa.int64()), "id": pa.array(ids, pa.int64()), "root": pa.array(root[own] + (n << ROW_BITS), pa.int64()), "rank": pa.array(rank, pa.int64())})

    rows = S.saved(numbers.mapInArrow(rows_of, "doc_id long, text_hash long, n_shingles long, root long"), f"{here}/rows")
    pairs = S.saved(met.where("key <> -1").groupBy("a", "b").agg(F.first("ra").alias("ra"), F.first("rb").alias("rb"), F.count(F.lit(1)).alias("n")), f"{here}/pairs")

    def opened(number):
        import pickle
        import zlib

        return pickle.loads(zlib.decompress(S.get(f"{here}/blocks/{number}")))

    def picked(block, local):
        """Shingles of some rows of an opened block."""
        import numpy as np

        words, sizes, vocabulary = block
        place = np.cumsum(sizes) - sizes
        return Shingles(np.concatenate([words[place[i] : place[i] + sizes[i]] for i in local.tolist()]), sizes[local], vocabulary, k)

    def fetch(batches):
        """(id, n, v): the size and the fine count vector of each id's set; ids come sorted."""
        import numpy as np
        import pyarrow as pa

        number, block, last = None, None, -1
        for batch in batches:
            ids = np.unique(batch.column(0).to_numpy())
            ids = ids[ids > last]
            for n in np.unique(ids >> ROW_BITS).tolist():
                if n != number:
                    number, block = n, opened(n)
                own = ids[ids >> ROW_BITS == n]
                last = int(own[-1])
                s = picked(block, own & ROW)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(s.sizes, pa.int64()), pa.array([packed(s.of(i)) for i in range(len(own))], pa.binary())], ["id", "n", "v"])

    def vectors_of(ids, name):
        dealt = ids.select("id").repartition(S.shuffles(spark), F.shiftright("id", ROW_BITS)).sortWithinPartitions("id")
        return S.saved(dealt.mapInArrow(fetch, "id long, n long, v binary"), f"{here}/{name}-vectors")

    def ends(pairs):
        return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))

    def bounded(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for x, y, n, m in zip(batch.column(4), batch.column(5), batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                out.append(common(unpacked(x.as_buffer(), n), unpacked(y.as_buffer(), m)) >= overlap(n, m, num, den))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "ra", "rb"]).filter(pa.array(out, pa.bool_()))

    def allowed(pairs, points):
        """Pairs whose sizes and count vectors allow a link."""
        x = points.select(F.col("id").alias("a"), F.col("v").alias("x"), F.col("n").alias("n"))
        y = points.select(F.col("id").alias("b"), F.col("v").alias("y"), F.col("n").alias("m"))
        both = pairs.select("a", "b", "ra", "rb").join(x, "a").join(y, "b").where(F.least("n", "m") * den >= F.greatest("n", "m") * num)
        return both.select("a", "b", "ra", "rb", "x", "y", "n", "m").mapInArrow(bounded, "a long, b long, ra long, rb long")

    def sets_of(rows):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.binary()] * 3, strict=True)], ["block", "a", "ra", "b", "rb", "h"])

    def send(batches, whole):
        """The set of a or its sketch (digests, shortened hashes), once for all pairs with members of another block; pairs come sorted."""
        import numpy as np

        S.thrifty()
        number, block = None, None
        for batch in batches:
            a, b, ra, rb = (c.to_numpy() for c in batch.columns)
            if not len(a):
                continue
            new = np.nonzero((a[1:] != a[:-1]) | (b[1:] >> ROW_BITS != b[:-1] >> ROW_BITS))[0] + 1
            low, high = np.concatenate(([0], new)), np.concatenate((new, [len(a)]))
            for n in np.unique(a >> ROW_BITS).tolist():
                if n != number:
                    block = None
                    S.trim()
                    number, block = n, opened(n)
                local = np.unique(a[a >> ROW_BITS == n] & ROW)
                s = picked(block, local)
                sums = None if whole else np.stack(digests(s), axis=1).astype("<u8")
                out, size = [], 0
                for x, y in zip(low[a[low] >> ROW_BITS == n].tolist(), high[a[low] >> ROW_BITS == n].tolist(), strict=True):
                    at = int(np.searchsorted(local, a[x] & ROW))
                    data = s.of(at).astype("<u8").tobytes() if whole else sums[at].tobytes() + short(s.of(at)).tobytes()
                    out.append((int(b[x]) >> ROW_BITS, int(a[x]), int(ra[x]), b[x:y].astype("<i8").tobytes(), rb[x:y].astype("<i8").tobytes(), data))
                    size += len(data) + 16 * (y - x)
                    if size >= SENT_BYTES:
                        yield sets_of(out)
                        out, size = [], 0
                if out:
                    yield sets_of(out)

    def check(batches, whole):
        """Pairs that link (sure) and, of sketches, those that may."""
        import numpy as np
        import pyarrow as pa

        S.thrifty()
        number, block = None, None
        for batch in batches:
            blocks, out = batch.column(0).to_numpy(), []
            for n in np.unique(blocks).tolist():
                if n != number:
                    block = None
                    S.trim()
                    number, block = n, opened(n)
                rows = np.nonzero(blocks == n)[0].tolist()
                b, rb = ([np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for i in rows] for c in (3, 4))
                local = np.unique(np.concatenate(b) & ROW)
                s = picked(block, local)
                sums = None if whole else np.stack(digests(s), axis=1)
                for i, ids, roots in zip(rows, b, rb, strict=True):
                    sent = batch.column(5)[i].as_buffer()
                    x = np.frombuffer(sent, "<u8") if whole else told_apart(np.frombuffer(sent, "<u2", offset=16))
                    for y, root, at in zip(ids.tolist(), roots.tolist(), np.searchsorted(local, ids & ROW).tolist(), strict=True):
                        own = s.of(at)
                        same = not whole and len(own) == len(x) and (np.frombuffer(sent, "<u8", count=2) == sums[at]).all()
                        if same or links(x, own if whole else told_apart(short(own)), num, den):
                            out.append((batch.column(1)[i].as_py(), y, batch.column(2)[i].as_py(), root, bool(whole or same)))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64() if j < 4 else pa.bool_()) for j in range(5)], ["a", "b", "ra", "rb", "sure"])

    def linked(pairs, name):
        """Pairs (of different blocks) whose whole sets link: the blocks of a send sketches to the blocks of b and, for pairs these leave open, sets."""
        n = S.shuffles(spark)

        def met_by(pairs, whole):
            asked = pairs.select("a", "b", "ra", "rb").repartition(n, F.shiftright("a", ROW_BITS), F.pmod(F.shiftright("b", ROW_BITS), F.lit(SPREAD))).sortWithinPartitions("a", "b")
            sent = asked.mapInArrow(lambda t: send(t, whole), "block long, a long, ra long, b binary, rb binary, h binary").repartition(n, "block").sortWithinPartitions("block")
            return sent.mapInArrow(lambda t: check(t, whole), "a long, b long, ra long, rb long, sure boolean")

        may = S.saved(met_by(pairs, False), f"{here}/{name}-may")
        return S.saved(may.where("sure").unionByName(met_by(may.where("not sure"), True)).drop("sure"), f"{here}/{name}-links")

    def named(rows, roots, labels):
        """rows with l<root>, the label of each root column so far."""
        for c in roots:
            rows = rows.join(labels.select(F.col("id").alias("_of"), F.col("label").alias("_is")), F.col(c) == F.col("_of"), "left").withColumn(f"l{c}", F.coalesce("_is", c)).drop("_of", "_is")
        return rows

    def joined(found, name):
        return components(found.select(F.col("ra").alias("a"), F.col("rb").alias("b")), f"{here}/{name}")

    best = S.saved(pairs.groupBy("rb").agg(F.max_by(F.struct("a", "b", "ra"), F.struct("n", -F.col("a"), -F.col("b"))).alias("p")).select("p.*", "rb"), f"{here}/best")
    found = linked(best, "best")
    labels = joined(found, "first")
    near = S.saved(named(pairs.join(best.select("a", "b"), ["a", "b"], "left_anti"), ["ra", "rb"], labels).where("lra <> lrb").select("a", "b", "ra", "rb"), f"{here}/near")
    if not near.isEmpty():
        maybe = S.saved(allowed(near, vectors_of(ends(near), "near")), f"{here}/maybe")
        found = found.unionByName(linked(maybe, "near"))
        labels = joined(found, "second")
    # Keys with members in several components, and the members outside the key's largest.
    extras = S.saved(numbers.mapInArrow(extras_of, "key long, root long"), f"{here}/extras")
    keys = met.where("key <> -1")
    apart = S.saved(named(pairs, ["ra", "rb"], labels).where("lra <> lrb").select("a", "b"), f"{here}/apart")
    within = named(keys.join(few(extras), "key").select("key", "root", "ra").distinct(), ["root", "ra"], labels).where("lroot <> lra")
    several = keys.join(few(apart), ["a", "b"], "left_semi").select("key").union(within.select("key")).distinct()
    several = S.saved(several, f"{here}/several")
    if several.isEmpty():
        return _answer(rows, labels, here)
    places = keys.join(few(several), "key").select("key", F.explode(F.array(F.shiftright("a", ROW_BITS), F.shiftright("b", ROW_BITS))).alias("block")).distinct()
    members = S.saved(places.groupBy("block").applyInArrow(members_of, "key long, id long, root long, rank long"), f"{here}/members")
    for name in ("held", "met", "several"):
        S.drop(f"{here}/{name}")
    members = S.saved(named(gathered(members, here), ["root"], labels).withColumnRenamed("lroot", "label"), f"{here}/asked")
    largest = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    largest = S.saved(largest.where(F.col("all") > F.col("most")).select("key", "main", F.ceil(F.col("all") / PAGE_ROWS).alias("pages"), F.ceil((F.col("all") - F.col("most")) / PAGE_ROWS).alias("sides")), f"{here}/largest")
    members = members.join(few(largest), "key")
    points = members.join(vectors_of(members, "members"), "id")
    # Each page of a hub's members meets each part of those outside its largest component, so no task gets more than both.
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["key", "page", "side", "id", "root", "label", "n", "v", "held", "asks"]
    points = points.withColumn("own_page", F.pmod(F.xxhash64("id"), F.col("pages"))).withColumn("own_side", F.when(F.col("label") != F.col("main"), F.pmod(F.xxhash64("id", F.lit(5)), F.col("sides"))))
    page = points.withColumn("page", F.col("own_page")).withColumn("side", each("sides")).withColumn("held", F.lit(True)).withColumn("asks", F.coalesce(F.col("side") == F.col("own_side"), F.lit(False))).select(*columns)
    outside = points.where("pages > 1 and own_side is not null").withColumn("side", F.col("own_side")).withColumn("page", each("pages")).where("page <> own_page").withColumn("held", F.lit(False)).withColumn("asks", F.lit(True)).select(*columns)

    def search(table):
        import numpy as np
        import pyarrow as pa

        held, asks = (np.nonzero(table.column(c).to_numpy(zero_copy_only=False))[0] for c in ("held", "asks"))
        ids, roots, labels, sizes = (table.column(c).to_numpy() for c in ("id", "root", "label", "n"))
        v = table.column("v").combine_chunks()
        whole = lambda i: unpacked(v[int(i)].as_buffer(), int(sizes[i]))
        coarse = np.zeros((len(ids), COORDINATES), np.int32)
        for i in range(len(ids)):
            coarse[i] = folded(whole(i), COORDINATES)
        tree = RTree(coarse[held], sizes[held], labels[held])
        out = set()
        for i in asks.tolist():
            own = whole(i)
            for j in held[tree.search(coarse[i], int(sizes[i]), labels[i], num, den)].tolist():
                if ids[i] >> ROW_BITS != ids[j] >> ROW_BITS:  # a block has checked its own
                    x, y = (i, j) if ids[i] < ids[j] else (j, i)
                    if (p := (ids[x], ids[y], roots[x], roots[y])) not in out and common(own, whole(j)) >= overlap(int(sizes[i]), int(sizes[j]), num, den):
                        out.add(p)
        return pa.table({c: pa.array([x[k] for x in out], pa.int64()) for k, c in enumerate(("a", "b", "ra", "rb"))})

    rest = page.unionByName(outside).groupBy("key", "page", "side").applyInArrow(lambda t: search(t.select(["id", "root", "label", "n", "v", "held", "asks"])), "a long, b long, ra long, rb long").distinct()
    rest = S.saved(rest.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), f"{here}/rest")
    if not rest.isEmpty():
        more = linked(rest, "rest")
        if not more.isEmpty():
            labels = joined(found.unionByName(more), "third")
    return _answer(rows, labels, here)


def _answer(rows: DataFrame, labels: DataFrame, here: str) -> DataFrame:
    of = labels.select(F.col("id").alias("of"), "label")
    rows = S.saved(rows.join(of, F.col("root") == F.col("of"), "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("label", "root").alias("component")), f"{here}/labelled")
    # A row alone has its own id: only components of several rows are looked up.
    least = rows.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size")).where("size > 1").select(F.col("component").alias("of"), "component_id")
    least = S.saved(least, f"{here}/least")
    S.drop(here, keep=("labelled", "least"))
    return rows.join(few(least), (F.col("component") == F.col("of")) & (F.col("n_shingles") > 0), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component", "text_hash")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: the least id (null first), then the least hash of the text. Rows without words
    all stay, but of rows equal in id and text one stays, whichever it is. Columns stay whatever their names; without
    rows there are none."""
    here = S.scratch(docs.sparkSession, "kept")
    joined = S.saved(join(docs, k, num, den, here=f"{here}/join"), f"{here}/joined")
    S.drop(f"{here}/join")
    kept = joined.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*").distinct()
    rows = joined.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & rows["text_hash"].eqNullSafe(kept["text_hash"])
    other = lambda df: df.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"))
    drop = S.saved(other(rows.join(kept, same, "left_anti")), f"{here}/drop")
    hint = F.broadcast if drop.count() <= BROADCAST_ROWS else lambda x: x
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    match = F.col("id").eqNullSafe(F.col("of")) & F.col("hash").eqNullSafe(F.col("of_hash"))
    out = held.join(hint(drop), match, "left_anti")
    twins = S.saved(other(rows.where("n > 1").join(kept, same, "left_semi")), f"{here}/twins")
    S.drop(here, keep=("drop", "twins"))
    if not twins.isEmpty():
        out = out.join(twins, match, "left_anti").unionByName(out.join(twins, match, "left_semi").dropDuplicates(["id", "hash"]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
