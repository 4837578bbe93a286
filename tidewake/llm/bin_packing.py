"""Best-fit-decreasing packing of indivisible groups into shards."""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch as S

#: Parcels that a shard of mean size holds; together with the shards it bounds what the driver packs.
PARCELS = 512
#: Groups or parcels that one task packs.
BUCKET_ROWS = 50_000


class Tree:
    """Bins by remaining capacity in an AVL tree: the tightest bin with enough room in logarithmic time."""

    def __init__(self):
        self.root = None  # [key, left, right, height]

    def add(self, key: tuple) -> None:
        self.root = self._add(self.root, key)

    def remove(self, key: tuple) -> None:
        self.root = self._remove(self.root, key)

    def ceiling(self, key: tuple) -> tuple | None:
        node, best = self.root, None
        while node:
            if node[0] >= key:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best

    @staticmethod
    def _height(n) -> int:
        return n[3] if n else 0

    def _turn(self, n, side: int):
        m = n[side]
        n[side], m[3 - side] = m[3 - side], n
        for x in (n, m):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return m

    def _even(self, n):
        n[3] = 1 + max(self._height(n[1]), self._height(n[2]))
        lean = self._height(n[1]) - self._height(n[2])
        if abs(lean) < 2:
            return n
        side = 1 if lean > 0 else 2
        if self._height(n[side][3 - side]) > self._height(n[side][side]):
            n[side] = self._turn(n[side], 3 - side)
        return self._turn(n, side)

    def _add(self, n, key):
        if not n:
            return [key, None, None, 1]
        side = 1 if key < n[0] else 2
        n[side] = self._add(n[side], key)
        return self._even(n)

    def _remove(self, n, key):
        if key == n[0]:
            if not n[1] or not n[2]:
                return n[1] or n[2]
            low = n[2]
            while low[1]:
                low = low[1]
            n[0] = low[0]
            n[2] = self._remove(n[2], low[0])
        else:
            side = 1 if key < n[0] else 2
            n[side] = self._remove(n[side], key)
        return self._even(n)


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item: largest item first, each into the open bin with the least room that suffices.
    An item over the capacity gets a bin of its own. Ties keep the order given."""
    tree, bins, out = Tree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        key = tree.ceiling((sizes[i], -1))
        if key is None:
            room, out[i] = max(capacity - sizes[i], 0), bins
            bins += 1
        else:
            tree.remove(key)
            room, out[i] = key[0] - sizes[i], key[1]
        tree.add((room, out[i]))
    return out


def fewest_capacity(sizes: list[int], shards: int) -> list[int]:
    """Bins under the least capacity, to a 2^-14th of the mean, at which best fit needs no more than shards bins."""
    if not sizes:
        return []
    low = max(max(sizes), -(-sum(sizes) // shards))
    high = low + max(sizes)  # a bin is only opened when no other has room, so more than this is never needed
    step = max(1, low >> 14)
    best = best_fit(sizes, high)
    while high - low >= step:
        middle = (low + high) // 2
        got = best_fit(sizes, middle)
        if max(got) < shards:
            best, high = got, middle
        else:
            low = middle + 1
    return best


def pack(docs: DataFrame, shards: int = 16, parcels: int = PARCELS, divide: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Shards of near-equal bytes over documents (doc_id, text) in which equal texts stay together.

    A group is all rows of one text (nulls are one group); a row's size is its UTF-8 bytes plus 1. Groups of more than
    1/(shards * parcels) of all bytes or rows are items of their own, so there are at most twice that many. The others are
    packed into parcels of that size, best fit decreasing, in each of many hash buckets at once, and the parcels that
    come of it likewise, again and again, until buckets no longer add to their number: at most two of three are less than
    half full, so about 2 * shards * parcels are left, whatever the input. These items are packed into the shards on the
    driver by the same rule. Groups stay whole, so that one larger than a mean shard makes a shard larger than the others;
    divide: such a group is divided by a hash of its rows instead.

    Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in a shard), grouped (text's hash). Null and empty
    texts are groups of their own, a very long one too; repeated rows all stay, and equal rows are interchangeable in
    their slots; ties go by the text's hash; columns other than doc_id and text play no part; without rows the result is
    empty.
    """
    spark = docs.sparkSession
    here = S.scratch(spark, "packing")
    least = max(64, S.shuffles(spark))
    rows = S.saved(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias("grouped"),
            F.spark_partition_id().alias("salt"),
        ),
        f"{here}/rows",
    )
    groups = S.saved(rows.groupBy("grouped").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), f"{here}/groups")
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    unit, mean = max(1, total // (shards * parcels)), max(1, -(-total // shards))
    own = (F.col("bytes") > unit) | (F.col("rows") > max(1000, count // (shards * parcels)))

    def parcel(key, pdf):
        pdf = pdf.sort_values(["bytes", "item"], ascending=[False, True], ignore_index=True)
        pdf["parcel"] = [f"{key[0]}.{key[1]}.{b}" for b in best_fit(pdf["bytes"].tolist(), unit)]
        return pdf[["item", "parcel", "bytes"]]

    # (grouped, item): the parcel of each small group so far; levels end where one bucket is enough or none got fewer.
    small = groups.where(~own).select(F.col("grouped").alias("item"), "bytes")
    of_parcel, left, level = None, small.count(), 0
    while left > bucket_rows or level == 0:
        buckets = max(least if level == 0 else 1, math.ceil(left / bucket_rows))
        dealt = small.groupBy(F.lit(level).alias("level"), F.pmod(F.xxhash64("item"), F.lit(buckets)).alias("bucket"))
        made = S.saved(dealt.applyInPandas(parcel, "item string, parcel string, bytes long"), f"{here}/parcels{level}")
        if of_parcel is None:
            of_parcel = made.select(F.col("item").alias("grouped"), F.col("parcel").alias("item"))
        else:
            of_parcel = S.saved(of_parcel.join(made.select("item", "parcel"), "item").select("grouped", F.col("parcel").alias("item")), f"{here}/placed{level}")
        small = S.saved(made.groupBy(F.col("parcel").alias("item")).agg(F.sum("bytes").alias("bytes")), f"{here}/sums{level}")
        before, left, level = left, small.count(), level + 1
        if left > before // 2:
            break
    big = [(r["grouped"], r["bytes"]) for r in groups.where(own).select("grouped", "bytes").collect()]
    items = [(r["item"], r["bytes"]) for r in small.collect()]
    over = {k: -(-8 * b // mean) for k, b in big if divide and b > mean}
    items += [(f"{k}.0", b) for k, b in big if k not in over]
    pieces = F.lit(1).cast("long")
    if over:  # fewer than shards
        known = F.create_map(*[F.lit(x) for kp in over.items() for x in kp])
        pieces = F.coalesce(F.try_element_at(known, F.col("grouped")), F.lit(1)).cast("long")
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id", "size", "grouped", "salt"), pieces))
    if over:
        split = rows.where(F.col("grouped").isin(list(over))).groupBy("grouped", "piece").agg(F.sum("size").alias("bytes"))
        items += [(f"{r['grouped']}.{r['piece']}", r["bytes"]) for r in split.collect()]
    items.sort()
    packed = fewest_capacity([b for _, b in items], shards)
    # At most twice shards * parcels groups, and about twice as many parcels: bounded whatever the input.
    placed = spark.createDataFrame([(k, b) for (k, _), b in zip(items, packed, strict=True)], "item string, shard int")
    of_parcel = of_parcel.join(F.broadcast(placed), "item").select(F.col("grouped").alias("of"), F.col("shard").alias("by_parcel"))
    by_group = placed.select(F.col("item").alias("whole"), F.col("shard").alias("by_group"))
    rows = rows.join(F.broadcast(by_group), F.concat("grouped", F.lit("."), F.col("piece")) == F.col("whole"), "left")
    # Only rows of small groups meet their parcels by a shuffle: none of these has a large share of rows.
    columns = ["doc_id", "size", "text_crc32", "grouped", "shard"]
    hot = rows.where(F.col("by_group").isNotNull()).select(*columns[:-1], F.col("by_group").alias("shard"), "salt")
    rest = rows.where(F.col("by_group").isNull()).join(of_parcel, F.col("grouped") == F.col("of")).select(*columns[:-1], F.col("by_parcel").alias("shard"), F.lit(0).alias("salt"))
    # Slots: counts of fine chunks give each chunk its first slot, so that no task numbers a whole shard. Rows of large
    # groups, among which many may be equal, are dealt to chunks by the task that read them too.
    chunks = max(64, math.ceil(count / (shards * 100_000)))
    put = S.saved(hot.unionByName(rest).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "grouped", "salt"), F.lit(chunks))), f"{here}/put")
    sizes = put.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "grouped"))
    return put.withColumn("inside", inside).join(first, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("inside") - 1).cast("long").alias("slot"), "grouped")
