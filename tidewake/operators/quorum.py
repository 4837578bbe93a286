"""Quorum reads and writes over replica states (key, rank, id, clock, value, deleted) and reply traces (key, rank, arrival_ms, ok)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake import functions
from tidewake.operators import causal


def defaults(members: int, n: int | None = None) -> dict:
    """Replicas and quorums that follow from the membership where unset; the deadline in milliseconds."""
    n = min(3, members) if n is None else n
    return {"n": n, "r": n // 2 + 1, "w": n // 2 + 1, "timeout_ms": 2000}


def validate(members: int, n: int, r: int, w: int, timeout_ms: int) -> None:
    if not (1 <= r <= n <= members and 1 <= w <= n and timeout_ms > 0):
        raise ValueError("quorums must lie between 1 and the replicas, replicas within the membership")


def decided(replies: DataFrame, need: int) -> DataFrame:
    """The first `need` good replies of each key, by arrival then rank; `reached` tells whether there were so many."""
    order = Window.partitionBy("key").orderBy("arrival_ms", "rank")
    good = replies.where("ok").withColumn("place", F.row_number().over(order)).where(F.col("place") <= need)
    counts = good.groupBy("key").agg(F.count(F.lit(1)).alias("n_ok"))
    return replies.select("key").distinct().join(counts, "key", "left").select("key", (F.coalesce("n_ok", F.lit(0)) >= need).alias("reached")).join(good.select("key", "rank"), "key", "left")


def read(state: DataFrame, replies: DataFrame, r: int, now_us: int | None = None) -> DataFrame:
    """(key, status, value, siblings, context): 503 without a quorum, 404 if no merged record is live, 409 if
    several remain and one is live, else 200. At now_us, if that is given, records past their expires_us aren't live;
    they still take part in the merge."""
    quorum = decided(replies, r)
    merged = causal.maximal(quorum.where("reached").join(state, ["key", "rank"]).drop("rank", "reached"))
    live = ~F.col("deleted") if now_us is None else functions.live(F.col("deleted"), F.col("expires_us"), F.lit(now_us))
    sums = merged.groupBy("key").agg(F.count(F.lit(1)).alias("siblings"), F.sum(live.cast("long")).alias("live"), F.max(F.when(live, F.col("value"))).alias("one"))
    keys = quorum.select("key", "reached").distinct().join(sums, "key", "left").join(causal.context(merged), "key", "left")
    status = F.when(~F.col("reached"), 503).when(F.coalesce("live", F.lit(0)) == 0, 404).when(F.col("siblings") > 1, 409).otherwise(200)
    out = keys.withColumn("status", status)
    return out.select("key", "status", F.when(F.col("status") == 200, F.col("one")).alias("value"), F.coalesce("siblings", F.lit(0)).cast("long").alias("siblings"), "context")


def write(replies: DataFrame, w: int) -> DataFrame:
    """(key, status, stored): 204 at w good replies, else 503; what good replicas took stays either way."""
    sums = replies.groupBy("key").agg(F.sum(F.col("ok").cast("long")).alias("n"), F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("rank")))).alias("stored"))
    return sums.select("key", F.when(F.col("n") >= w, 204).otherwise(503).alias("status"), "stored")


def write_without_context(state: DataFrame, replies: DataFrame, r: int, w: int) -> DataFrame:
    """A write that gives no context reads first: 503 without a read quorum, 409 if several records remain even
    if none is live, else the read's context goes into the new record and the write decides. (key, status, context)"""
    first = read(state, replies, r).join(write(replies, w).withColumnRenamed("status", "written"), "key")
    status = F.when(F.col("status") == 503, 503).when(F.col("siblings") > 1, 409).otherwise(F.col("written"))
    return first.select("key", status.alias("status"), F.when(status.isin(204), F.coalesce("context", F.array().cast("array<string>"))).alias("context"))


def repairs(state: DataFrame, replies: DataFrame, r: int) -> DataFrame:
    """What read repair adds: after a good read all good replies are merged and given to every replica. (key, rank, id)"""
    reached = decided(replies, r).where("reached").select("key").distinct()
    good = replies.where("ok").select("key", "rank").join(reached, "key", "left_semi")
    merged = causal.maximal(good.join(state, ["key", "rank"]).drop("rank")).select("key", "id")
    everywhere = merged.join(replies.select("key", "rank").distinct(), "key")
    return everywhere.join(state.select("key", "rank", "id"), ["key", "rank", "id"], "left_anti").select("key", "rank", "id")


def divergence(state: DataFrame) -> DataFrame:
    """(key, rank, missing): how many of a key's maximal records each replica that holds the key lacks. Spark extra."""
    merged = causal.maximal(state.drop("rank")).select("key", "id")
    held = state.select("key", "rank").distinct().join(merged, "key")
    lacks = held.join(state.select("key", "rank", "id"), ["key", "rank", "id"], "left_anti")
    return lacks.groupBy("key", "rank").agg(F.count(F.lit(1)).alias("missing"))
