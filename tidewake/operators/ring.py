"""Consistent-hash placement: a small ring of points against any number of keys."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions import position, position_number


def points(spark: SparkSession, members: list[str], vnodes: int = 64) -> DataFrame:
    """(node, idx, pos) for each node and virtual number; the id's length in bytes is part of what is hashed."""
    if vnodes <= 0 or "" in members or len(set(members)) < len(members):
        raise ValueError("virtual nodes must be positive, ids non-empty and distinct")
    nodes = spark.createDataFrame([(m,) for m in members], "node string").withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))))
    text = F.concat(F.lit("node:"), F.octet_length("node").cast("string"), F.lit(":"), "node", F.lit(":"), F.col("idx").cast("string"))
    return nodes.withColumn("pos", position(text))


#: Points up to which a ring is broadcast: some 150 bytes each.
BROADCAST_POINTS = 200_000


def positions(points: DataFrame) -> DataFrame:
    """All points in the order of the ring, with positions as unsigned numbers."""
    return points.select("node", "idx", position_number(F.col("pos")).alias("position")).orderBy("position", "node", "idx")


def preferences(points: DataFrame, n: int | None = None) -> DataFrame:
    """For each arc (lo, hi] of the ring, the first n (all) distinct nodes in clockwise order: (rn, lo, hi, nodes).

    A ring is configuration, nodes * vnodes points whatever the keys are: one task walks it backwards twice, the nodes
    in order of their last visit, so an arc costs its n nodes and no point meets every other."""

    def walk(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["pos", "node", "idx"], ignore_index=True)
        pos, node = pdf["pos"].tolist(), pdf["node"].tolist()
        seen: dict[str, None] = {}  # the nearest node ahead comes last
        rows = []
        for turn in range(2):
            for i in range(len(pos) - 1, -1, -1):
                seen.pop(node[i], None)
                seen[node[i]] = None
                if turn:
                    ahead = reversed(seen)
                    rows.append((i + 1, pos[i - 1] if i else None, pos[i], [x for x, _ in zip(ahead, range(len(seen) if n is None else max(n, 0)))]))
        return pd.DataFrame(rows, columns=["rn", "lo", "hi", "nodes"])

    return points.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: walk(pdf), "rn int, lo string, hi string, nodes array<string>")


def segments(prefs: DataFrame) -> DataFrame:
    """Arcs cut at leading-byte boundaries, so keys meet them by an equi-join on that byte and a range within it."""
    lo, hi = F.coalesce("lo", F.lit("")), F.col("hi")
    # What lies beyond the last point wraps to the first.
    ends = prefs.agg(F.max("hi").alias("lo"), F.min_by("nodes", "rn").alias("nodes")).where("lo is not null")
    first = ends.select("lo", F.lit("g").alias("hi"), "nodes")
    both = prefs.select(lo.alias("lo"), hi.alias("hi"), "nodes").unionByName(first)
    byte = lambda c, other: F.when((c == "") | (c == "g"), F.lit(other)).otherwise(F.conv(F.substring(c, 1, 2), 16, 10).cast("int"))
    return both.withColumn("byte", F.explode(F.sequence(byte(F.col("lo"), 0), byte(F.col("hi"), 255))))


def place(keys: DataFrame, points: DataFrame, n: int = 1) -> DataFrame:
    """keys (key) with nodes: up to n distinct nodes clockwise from the first point at or after the key, wrapping.
    No keys come back for an empty ring; n of 0 or less gives empty lists."""
    seg = segments(preferences(points, n))  # a row for each point, and for each leading byte that an arc spans
    if points.count() <= BROADCAST_POINTS:
        seg = F.broadcast(seg)
    kp = keys.withColumn("pos", position(F.concat(F.lit("key:"), "key"))).withColumn("byte_of", F.conv(F.substring("pos", 1, 2), 16, 10).cast("int"))
    hit = kp.join(seg, (F.col("byte_of") == F.col("byte")) & (F.col("lo") < F.col("pos")) & (F.col("pos") <= F.col("hi")))
    return hit.select(*[F.col(c) for c in keys.columns], "pos", F.slice("nodes", 1, max(n, 0)).alias("nodes"))


def movement(keys: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose owner differs between two rings: (key, old, new)."""
    a = place(keys, before).select("key", F.col("nodes")[0].alias("old"))
    return place(a, after).select("key", "old", F.col("nodes")[0].alias("new")).where("old <> new")
