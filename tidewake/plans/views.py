"""Views of the events and customer tables in the shape of the operators' inputs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions import clock

MEMBERS = ["a", "b", "c", "d", "e"]


def keys(customer: DataFrame) -> DataFrame:
    return customer.select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("key"))


def ops(events: DataFrame, key: Column | None = None) -> DataFrame:
    """A log: puts, gets and deletes by event type, a third of them with a TTL."""
    op = F.when(F.col("event_type").isin("purchase", "signup"), "put").when(F.col("event_type") == "error", "delete").otherwise("get")
    ttl = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 50 * 60_000_000).otherwise(0)
    return events.select(
        (F.col("user_id") % 4).alias("store"), (F.col("event_id") + 1).alias("seq"), op.alias("op"),
        (F.concat(F.lit("k"), (F.col("event_id") * 7919 % 60).cast("string")) if key is None else key).alias("key"), F.col("event_id").cast("string").alias("value"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), ttl.cast("long").alias("ttl_us"),
    )


def user_log(events: DataFrame) -> DataFrame:
    return ops(events, F.concat(F.lit("u"), F.col("user_id").cast("string")))


def records(events: DataFrame) -> DataFrame:
    """Records of some 2,000 keys, not causally closed."""
    number = (F.col("event_id") * 31 % 1999).alias("u")
    own = events.where(F.col("event_type").isin("purchase", "signup", "error")).select("event_id", number, (F.col("event_type") == "error").alias("deleted"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    before = F.lag("event_id").over(Window.partitionBy("u").orderBy("event_id"))
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    own = own.withColumn("p", before).withColumn("id", name(F.col("event_id")))
    alone = (F.col("event_id") % 7 == 0) | F.col("p").isNull()
    return own.select(
        "event_id", "u", F.concat(F.lit("k:"), F.col("u").cast("string")).alias("key"), "id",
        F.when(alone, F.array("id")).otherwise(clock(F.array(name(F.col("p")), F.col("id")))).alias("clock"),
        F.when(~F.col("deleted"), F.col("event_id").cast("string")).alias("value"), "deleted",
        F.when(~F.col("deleted") & (F.col("event_id") % 3 == 0), F.col("at_us") + F.col("event_id") % 50 * 3_600_000_000).alias("expires_us"),
    )


def replica_state(events: DataFrame) -> DataFrame:
    held = records(events).withColumn("rank", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("rank <> event_id % 5")
    return held.select("key", "rank", "id", "clock", "value", "deleted", "expires_us")


def requests(events: DataFrame) -> DataFrame:
    """A request for each event that isn't a record: PUT for a click, DELETE for a view; some with a context, some bad."""
    own = events.where(F.col("event_type").isin("click", "view"))
    n = F.col("event_id") % 10
    value = F.concat(F.lit('"value":"v'), F.col("event_id").cast("string"), F.lit('"'))
    known = F.concat(F.lit(',"context":{"e'), (F.col("event_id") - F.col("event_id") % 3).cast("string"), F.lit('":1}'))
    more = F.when(n == 0, ',"context":{}').when(n == 1, known).when(n == 2, ',"context":null').when(n == 3, ',"ttl_ms":60000').when(n == 4, ',"ttl_ms":-1').otherwise("")
    key = F.concat(F.lit("k:"), (F.col("event_id") * 31 % 1999).cast("string"))
    method = F.when(F.col("event_type") == "click", "PUT").otherwise("DELETE")
    node = F.element_at(F.array(*map(F.lit, MEMBERS)), (F.col("event_id") % 5 + 1).cast("int"))
    return own.select(F.col("event_id").alias("req_id"), node.alias("node"), key.alias("key"), method.alias("method"), F.concat(F.lit("{"), value, more, F.lit("}")).alias("body"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


def replies(events: DataFrame) -> DataFrame:
    one = records(events).select("key", "u").distinct().withColumn("rank", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    arrival = ((F.col("u") * 7919 + F.col("rank") * 104729) % 3000).alias("arrival_ms")
    return one.select("key", "rank", arrival).withColumn("ok", F.col("arrival_ms") < 2000)
