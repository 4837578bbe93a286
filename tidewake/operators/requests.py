"""Requests against replicas, from the body to the answer and to what each replica then holds.

requests: req_id, node (that receives it), key, method (PUT, DELETE), body (JSON), at_us. Requests of one table are
concurrent: each reads the state as it is before all of them. Reply traces are by key and rank, as in quorum."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.operators import quorum, validate


def new_records(requests: DataFrame) -> DataFrame:
    """requests (req_id, node, method, value, ttl_ms, context, at_us) with the record each makes: id, clock, value,
    deleted, expires_us.

    The id is the node and 128 bits, here of a hash of the request's id, so that a repeated task makes the same record;
    the clock is the context and the id; a tombstone has neither value nor expiry."""
    put = F.col("method") == "PUT"
    id_ = F.concat("node", F.lit(":"), F.substring(F.sha2(F.concat("node", F.lit("/"), F.col("req_id").cast("string")).cast("binary"), 256), 1, 32))
    made = requests.withColumn("id", id_)
    clock = F.array_sort(F.array_union(F.coalesce("context", F.array().cast("array<string>")), F.array("id")))
    expires = F.when(put & (F.col("ttl_ms") > 0), F.col("at_us") + F.col("ttl_ms") * 1000)
    return made.withColumn("clock", clock).withColumn("value", F.when(put, F.col("value"))).withColumn("deleted", ~put).withColumn("expires_us", expires)


def apply_mutations(requests: DataFrame, state: DataFrame, reads: DataFrame, writes: DataFrame, r: int, w: int) -> DataFrame:
    """Each request's answer and record: req_id, key, status, id, clock, value, deleted, expires_us, stored.

    400 for a body that isn't valid. Without a context (absent or null, not {}) the key is read first: 503 without a read
    quorum, 409 if several records remain even if none is live, else the read's context goes into the record. Then 204 at w
    good replies, else 503; `stored` are the ranks that took the record either way - a failed write stays where it
    arrived. Refused requests have no record."""
    status = validate.mutation_status(F.col("method"), F.col("body"))
    parsed = requests.withColumn("valid", status == 200).withColumn("b", F.when(F.col("valid"), validate.mutation(F.col("body"))))
    parsed = parsed.select(*requests.columns, "valid", "b.value", F.coalesce("b.ttl_ms", F.lit(0)).alias("ttl_ms"), F.col("b.context").alias("given"))
    asking = parsed.where(F.col("valid") & F.col("given").isNull()).select("key").distinct()
    first = quorum.read(state.join(asking, "key", "left_semi"), reads.join(asking, "key", "left_semi"), r).select("key", F.col("status").alias("first"), "siblings", F.col("context").alias("found"))
    outcome = quorum.write(writes, w).select("key", F.col("status").alias("written"), "stored")
    both = parsed.join(first, "key", "left").join(outcome, "key", "left")
    unread = F.col("given").isNull()
    refused = F.when(~F.col("valid"), 400).when(unread & (F.coalesce("first", F.lit(503)) == 503), 503).when(unread & (F.col("siblings") > 1), 409)
    made = new_records(both.withColumn("context", F.coalesce("given", "found")).withColumn("refused", refused))
    sent = F.col("refused").isNull()
    only = lambda c: F.when(sent, F.col(c)).alias(c)
    return made.select("req_id", "key", F.coalesce("refused", "written", F.lit(503)).alias("status"), only("id"), only("clock"), only("value"), only("deleted"), only("expires_us"), F.when(sent, F.coalesce("stored", F.array().cast("array<int>"))).alias("stored"))


def effects(answers: DataFrame) -> DataFrame:
    """What the replicas hold more: key, rank, id, clock, value, deleted, expires_us, whatever the request's status."""
    return answers.where(F.col("stored").isNotNull()).select("key", F.explode("stored").alias("rank"), "id", "clock", "value", "deleted", "expires_us")
