"""Exact top-k by inner product over M-trees."""

import heapq
import io

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch as S

#: Vectors of a tree, entries of a page, query vectors of a task.
TREE, PAGE, ASKED = 20_000, 512, 128
#: Rows of the table of vector lengths up to which it is broadcast: three numbers each.
BROADCAST_ROWS = 100_000


class MTree:
    """A paged M-tree over integer vectors, lifted by one coordinate to equal length.

    With |x|^2 + z^2 = M^2, the squared distance from a query q is |q|^2 + M^2 - 2 q.x: nearest is largest
    product, and the lifted distance is a metric. A page holds its entries' vectors, their distances to the
    page's own routing object and, for inner pages, covering radii and child pages.
    """

    def __init__(self, x, ids, counts=None, page: int = PAGE, lift: float | None = None):
        import numpy as np

        self.x, self.ids = x.astype(np.float64), np.asarray(ids)
        self.counts = np.ones(len(ids), np.int64) if counts is None else np.asarray(counts)
        square = (self.x**2).sum(1)
        self.top = float(square.max() if lift is None else lift)
        self.z = np.sqrt(np.maximum(self.top - square, 0))
        self.pages: list[dict] = []
        self.page, self.opened = page, 0
        self.root = self._build(np.arange(len(ids)), None)
        # Rows of a leaf lie together, so a page is a slice and reading it copies nothing.
        leaves = [p for p in self.pages if p["child"] is None]
        order = np.concatenate([p["rows"] for p in leaves]) if leaves else np.arange(0)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.x, self.z, self.ids, self.counts = self.x[order], self.z[order], self.ids[order], self.counts[order]
        for p in self.pages:
            p["rows"] = place[p["rows"]]

    def _distance(self, i: int, rows):
        import numpy as np

        return np.sqrt(np.maximum(2 * (self.top - self.x[rows] @ self.x[i] - self.z[rows] * self.z[i]), 0))

    def _build(self, rows, center: int | None) -> int:
        import numpy as np

        to = np.zeros(len(rows)) if center is None else self._distance(center, rows)
        at = len(self.pages)
        if len(rows) <= self.page:
            self.pages.append({"rows": rows, "to": to, "child": None})
            return at
        self.pages.append({})
        fan = min(self.page, max(2, -(-len(rows) * 2 // self.page)), 32)
        # Farthest first: each pivot is the entry that lies farthest from all pivots before it.
        pivots, far = [rows[0]], [self._distance(rows[0], rows)]
        near = far[0]
        while len(pivots) < fan:
            pivots.append(rows[near.argmax()])
            far.append(self._distance(pivots[-1], rows))
            near = np.minimum(near, far[-1])
        pivots, far = np.array(pivots), np.stack(far)
        owner = far.argmin(0)
        if np.bincount(owner, minlength=fan).max() == len(rows):  # no pivot divides them: all equally far
            owner = np.arange(len(rows)) % fan
        used = [f for f in range(fan) if (owner == f).any()]
        radius = np.array([far[f][owner == f].max() for f in used])
        up = np.zeros(len(used)) if center is None else self._distance(center, pivots[used])
        child = [self._build(rows[owner == f], int(pivots[f])) for f in used]
        self.pages[at] = {"rows": pivots[used], "to": up, "radius": radius, "child": child}
        return at

    def search(self, q, k: int, skip: int | None = None, best: list | None = None) -> list[tuple[int, int, int]]:
        """The k best (product, id, count), larger product first, then smaller id; skip: an id left out; best: what a search of
        another tree gave, which goes on and bounds this one. Best first: pages by the least distance they can hold;
        the distance to an entry is only computed where the one between its page's routing object and itself doesn't
        rule it out already."""
        import numpy as np

        q = q.astype(np.float64)
        base, slack = float(q @ q) + self.top, 1e-6
        best = [(s, -i, n) for s, i, n in best or []]  # a heap of (product, -id, count): worst first
        heapq.heapify(best)
        queue, bound = [(0.0, 0, self.root, None)], np.inf if len(best) < k else max(base - 2 * best[0][0], 0) ** 0.5
        while queue:
            near, _, at, own = heapq.heappop(queue)
            if near > bound + slack:
                break
            page = self.pages[at]
            self.opened += page["child"] is None
            rows, keep = page["rows"], None
            if own is not None and bound < np.inf:
                keep = np.abs(own - page["to"]) - page.get("radius", 0) <= bound + slack
                if not keep.any():
                    continue
                rows = rows[keep]
            if page["child"] is None and len(page["rows"]) and (keep is None or 2 * len(rows) > len(keep)):
                rows = page["rows"]
                product = self.x[rows[0] : rows[0] + len(rows)] @ q
            else:
                product = self.x[rows] @ q
            if page["child"] is None:
                if len(best) >= k:
                    near_enough = product >= best[0][0]
                    rows, product = rows[near_enough], product[near_enough]
                for s, i, n in zip(product.tolist(), self.ids[rows].tolist(), self.counts[rows].tolist(), strict=True):
                    if i == skip:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (int(s), -i, n))
                    elif (int(s), -i) > best[0][:2]:
                        heapq.heapreplace(best, (int(s), -i, n))
                if len(best) == k:
                    bound = max(base - 2 * best[0][0], 0) ** 0.5
                continue
            d = np.sqrt(np.maximum(base - 2 * product, 0))
            low = np.maximum(d - (page["radius"] if keep is None else page["radius"][keep]), 0)
            child = page["child"] if keep is None else [c for c, x in zip(page["child"], keep, strict=True) if x]
            for j in np.nonzero(low <= bound + slack)[0].tolist():
                heapq.heappush(queue, (float(low[j]), child[j], child[j], float(d[j])))
        return sorted(((s, -i, n) for s, i, n in best), key=lambda t: (-t[0], t[1]))

    def dump(self) -> bytes:
        import numpy as np

        out, pages = io.BytesIO(), self.pages
        whole = {f"{name}{i}": np.asarray(p[name]) for i, p in enumerate(pages) for name in ("rows", "to", "radius", "child") if p.get(name) is not None}
        np.savez(out, x=self.x, ids=self.ids, counts=self.counts, z=self.z, top=self.top, n=len(pages), root=self.root, **whole)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "MTree":
        import numpy as np

        own = cls.__new__(cls)
        f = np.load(io.BytesIO(data))
        own.x, own.ids, own.counts, own.z, own.top, own.root, own.opened = f["x"], f["ids"], f["counts"], f["z"], float(f["top"]), int(f["root"]), 0
        own.pages = [{k: f[f"{k}{i}"] for k in ("rows", "to", "radius") if f"{k}{i}" in f} | {"child": f[f"child{i}"].tolist() if f"child{i}" in f else None} for i in range(int(f["n"]))]
        return own


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, tree: int = TREE, asked: int = ASKED) -> DataFrame:
    """The k best rows for each row of vectors (vec_id, embedding) whose id is divisible by `every`.

    Components become floor(scale * x). Rows with a null id or vector, or a null or non-finite component,
    take no part; an empty vector is one too; vectors of other lengths are no candidates, nor are rows of the query's own
    id. Ties go to the smaller id. Repeated rows each count, as candidates and as queries: what all rows of one query id
    find is ranked together. Without rows, or without queries, the result is empty; other columns play no part.

    Of equal vectors only the k + 1 of smallest id can be in any result, so only those are indexed - an exact reduction
    which takes groups of copies out before the first shuffle - and equal queries are searched for once. Trees of some
    `tree` vectors each, dealt by a hash, lie as files in the shared folder. A task takes up to `asked` distinct query
    vectors through trees one after the other, so that what they have found so far bounds the next search; the results
    of all tasks are ranked. Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    here = S.scratch(spark, "mtree")
    x = F.col("embedding").cast("array<double>")
    fine = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    fine = fine.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    fixed = fine.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("v")).withColumn("key", F.md5(F.to_json("v").cast("binary")))
    # Each (vector, id) once, with the number of its rows.
    whole = S.saved(fixed.groupBy("key", "vec_id").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n")), f"{here}/whole")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    index = S.saved(whole.withColumn("r", rank).where(F.col("r") <= k + 1).select("vec_id", "v", "n", F.size("v").alias("dim")), f"{here}/index")
    sizes = S.saved(index.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / tree).alias("trees")).withColumnRenamed("dim", "of"), f"{here}/sizes")
    few = F.broadcast if sizes.count() <= BROADCAST_ROWS else lambda x: x

    def build(key, pdf):
        import numpy as np
        import pandas as pd

        dim, number = int(key[0]), int(key[1])
        x = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), dim)
        S.put(f"{here}/trees/{dim}-{number}.npz", MTree(x, pdf["vec_id"].to_numpy(), pdf["n"].to_numpy()).dump())
        return pd.DataFrame({"dim": [dim], "tree": [number]})

    dealt = index.join(few(sizes), F.col("dim") == F.col("of")).select("vec_id", "v", "n", "dim", F.pmod(F.xxhash64("vec_id"), F.col("trees")).alias("tree"))
    S.saved(dealt.groupBy("dim", "tree").applyInPandas(build, "dim int, tree long"), f"{here}/built")
    # A query id with several vectors leaves out all its rows in each search; else the one row it may meet is cut later.
    queries = whole.where(F.col("vec_id") % every == 0)
    several = queries.groupBy("vec_id").agg(F.count(F.lit(1)).alias("vectors")).where("vectors > 1").select(F.col("vec_id").alias("skip"))
    queries = S.saved(queries.join(several, F.col("vec_id") == F.col("skip"), "left").select(F.col("vec_id").alias("query_id"), "key", "skip", "v", F.col("n").alias("times")), f"{here}/queries")
    distinct = S.saved(queries.groupBy("key", "skip").agg(F.first("v").alias("v")), f"{here}/distinct")
    count, most = distinct.count(), sizes.agg(F.max("trees")).first()[0] or 0
    groups = max(1, -(-count // asked))
    # Fewer groups than tasks: each meets parts of the trees only.
    parts = min(max(1, most), -(-max(S.shuffles(spark), 12) // groups))
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    sent = distinct.withColumn("dim", F.size("v")).join(few(sizes), F.col("dim") == F.col("of")).select("key", "skip", "v", "dim", "trees", F.pmod(F.xxhash64("key", "skip"), F.lit(groups)).alias("part_of"), part)
    sent = sent.repartition(max(S.shuffles(spark), 12, groups * parts), "part_of", "part").sortWithinPartitions("part_of", "part", "dim")

    def search(frames):
        import numpy as np
        import pandas as pd

        def answer(rows):
            """Takes one group through its part of the trees."""
            dim, trees, now = rows[0][3], rows[0][4], rows[0][5][1]
            best = [[] for _ in rows]
            for number in range(now, trees, parts):
                try:
                    held = MTree.load(S.get(f"{here}/trees/{dim}-{number}.npz"))
                except FileNotFoundError:  # no vector fell to it
                    continue
                for i, (_, skip, v, *_) in enumerate(rows):
                    best[i] = held.search(v, k + (skip is None), skip, best[i])
            out = [(r[0], r[1], i, s, n) for r, b in zip(rows, best, strict=True) for s, i, n in b]
            return pd.DataFrame(out, columns=["key", "skip", "vec_id", "score", "n"], dtype=object).astype({"skip": "Int64", "vec_id": "int64", "score": "int64", "n": "int64"})

        rows = []
        for pdf in frames:
            for key, skip, v, dim, trees, of, now in zip(pdf["key"], pdf["skip"], pdf["v"], pdf["dim"], pdf["trees"], pdf["part_of"], pdf["part"], strict=True):
                if rows and (rows[0][3], rows[0][5]) != (dim, (of, now)):
                    yield answer(rows)
                    rows = []
                rows.append((key, None if pd.isna(skip) else int(skip), np.array(v, np.int64), dim, trees, (of, now)))
        if rows:
            yield answer(rows)

    found = sent.mapInPandas(search, "key string, skip long, vec_id long, score long, n long")
    if parts > 1:
        best = F.row_number().over(Window.partitionBy("key", "skip").orderBy(F.desc("score"), "vec_id"))
        found = found.withColumn("r", best).where(F.col("r") <= k + 1).drop("r")
    # A candidate counts as often as it has rows, for each row of the query.
    found = S.saved(found, f"{here}/found").withColumnsRenamed({"key": "asked", "skip": "left_out"})
    met = queries.drop("v").join(found, (F.col("key") == F.col("asked")) & F.col("skip").eqNullSafe(F.col("left_out"))).where(F.col("vec_id") != F.col("query_id"))
    met = met.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("times") * F.col("n"), F.lit(k).cast("long")))))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
