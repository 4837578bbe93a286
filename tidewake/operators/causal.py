"""Causally maximal records of a key. Records: key, id, clock (sorted array of ids), value, deleted and, if there is
such a column, expires_us (null: none)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BODY = ("clock", "value", "deleted", "expires_us")


def versions(records: DataFrame) -> DataFrame:
    """One row for each (key, id): the least of its versions, and whether they differ. Copies of a record meet before the shuffle."""
    body = F.struct(*[c for c in BODY if c in records.columns])
    one = records.groupBy("key", "id").agg(F.min(body).alias("b"), (F.min(body) != F.max(body)).alias("differs"))
    return one.select("key", "id", "b.*", "differs")


def maximal(records: DataFrame, strict: bool = True) -> DataFrame:
    """Records that no other record of their key strictly dominates, once per id.

    A dominating clock holds the dominated record's own id, so candidates come from an equi-join on
    (key, id) with exploded clocks; the subset test then decides. Clocks of one id dominate nothing and
    aren't exploded. Tombstones and expired records take part. An id that stands for different records fails the
    job; where not strict, the least of its versions counts and conflicts() tells which ids these are."""
    one = versions(records)
    if strict:
        message = F.concat(F.lit("record identity reused with different contents: "), "key", F.lit(" "), "id")
        one = one.where(F.when(F.col("differs"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    one = one.drop("differs")
    above = one.where(F.size("clock") > 1).select(F.col("key").alias("ak"), F.col("clock").alias("ac"), F.explode("clock").alias("cid"))
    beaten = (F.col("ak") == F.col("key")) & (F.col("cid") == F.col("id")) & (F.size("ac") > F.size("clock")) & (F.size(F.array_except("clock", "ac")) == 0)
    return one.join(above, beaten, "left_anti")


def context(records: DataFrame, by: tuple = ("key",)) -> DataFrame:
    """The union of all clocks of a key: each id once before the rows of a key meet."""
    ids = records.select(*by, F.explode("clock").alias("id")).distinct()
    return ids.groupBy(*by).agg(F.array_sort(F.collect_list("id")).alias("context"))


def conflicts(records: DataFrame) -> DataFrame:
    """(key, id, versions) of ids that stand for different records."""
    body = F.struct(*[c for c in BODY if c in records.columns])
    return records.groupBy("key", "id").agg(F.count_distinct(F.to_json(body, {"ignoreNullFields": "false"})).alias("versions")).where("versions > 1")


def records_of(records: DataFrame, key: str) -> DataFrame:
    """All siblings of a key, tombstones and expired ones too; none for an unknown key."""
    return maximal(records.where(F.col("key") == key))


def deliveries(log: DataFrame, capacity: int = 0) -> DataFrame:
    """What each delivery of records to a replica does: (store, seq, outcome) of log (store, seq, key, id, clock, ...),
    rows of one seq being one delivery to one key.

    unchanged: every record is held already or dominated by one that is, so nothing is written and delivering again is
    harmless; rejected: a new key at capacity (0 or less: none); stored: otherwise. Keys are never removed - tombstones and
    expired records count - so those held are the first `capacity` to arrive, and no ordered fold is needed: a record
    is news unless the same id or a dominating clock came before, and dominance is transitive."""
    from pyspark.sql import Window

    first = log.groupBy("store", "key").agg(F.min("seq").alias("came"))
    place = F.row_number().over(Window.partitionBy("store").orderBy("came", "key"))
    held = first.withColumn("held", place <= capacity if capacity > 0 else F.lit(True)).select("store", "key", "held")
    known = log.select(F.col("store").alias("ks"), F.col("key").alias("kk"), F.col("seq").alias("kseq"), F.col("id").alias("kid"), F.col("clock").alias("kc"), F.explode("clock").alias("cid"))
    above = (F.size("kc") > F.size("clock")) & (F.size(F.array_except("clock", "kc")) == 0)
    old = (F.col("ks") == F.col("store")) & (F.col("kk") == F.col("key")) & (F.col("cid") == F.col("id")) & (F.col("kseq") < F.col("seq")) & ((F.col("kid") == F.col("id")) | above)
    news = log.join(known, old, "left_anti").select("store", "seq").distinct().withColumn("news", F.lit(True))
    each = log.groupBy("store", "seq").agg(F.min("key").alias("key")).join(held, ["store", "key"]).join(news, ["store", "seq"], "left")
    # A rejected key holds nothing, so all that is delivered to it stays news.
    outcome = F.when(~F.col("held"), "rejected").when(F.coalesce("news", F.lit(False)), "stored").otherwise("unchanged")
    return each.select("store", "seq", "key", outcome.alias("outcome"))
