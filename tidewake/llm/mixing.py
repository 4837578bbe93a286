"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch as S

#: Sources up to this many are broadcast: their row is under 100 bytes besides the name.
BROADCAST_SOURCES = 20_000
BLANK = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs of other than ASCII white space; null: 0."""
    bare = F.regexp_replace(text, rf"^{BLANK}|{BLANK}$", "")
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, BLANK))).cast("long")


def quality(text: Column, words: Column) -> Column:
    """A weight from 1 to 4: words of common length count most."""
    mean = F.length(text) / F.greatest(words, F.lit(1))
    return F.when(mean.between(4, 9), 4.0).when(mean.between(3, 14), 2.0).otherwise(1.0)


def mix(docs: DataFrame, weights: tuple = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 17, carry: bool = False) -> DataFrame:
    """How often each document (doc_id, text, source) enters a mix, and what it adds.

    Sources in order of code points, null last, take the weights in turn, repeating, and share `share` times
    all words; a source stops at `most` times its own and the rest is shared again. That end state is
    target = min(most * size, level * weight) for one level, found from running sums over the sources.
    A source's whole epochs come first; the rest of its target goes to its documents in ascending order of
    -ln(u) / weight, u from a hash of seed, id and text, weight from the text's quality. The order isn't sorted:
    keys fall into buckets, bucket sums are added up, and only the bucket in which the rest ends is ordered.
    A document enters whole, the last if its middle lies within the rest: the error is half a document.
    Returns doc_id, size, source, source_size, target, copies, taken; carry: and `row`, all columns of docs. Null text: size 0, taken 0. Repeated
    rows count each; equal ones are interchangeable, and ties go by hash, then id. Very long texts are counted whole, and
    one longer than its source's rest may be left out. Columns of docs come back in `row` only, so none can clash. Without
    rows the result is empty. The windows over all sources have a row for each source, not for each document.
    """
    spark = docs.sparkSession
    here = S.scratch(spark, "mixing")
    size = n_words(F.col("text"))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    held = ["row"] if carry else []
    hashed = F.xxhash64(F.lit(seed), "doc_id", "text")
    unit = (F.shiftrightunsigned(hashed, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = docs.select("doc_id", "source", size.alias("size"), hashed.alias("tie"), unit.alias("u"), F.col("text"), *row)
    # 1 - exp(-key) orders as the key does; weights of 1 and more keep it near even between 0 and 1.
    rows = S.saved(rows.select("doc_id", "source", "size", "tie", *held, (1 - F.pow("u", 1 / quality(F.col("text"), F.col("size")))).alias("key")), f"{here}/rows")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sums = sums.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((turn - 1) % len(weights) + 1).cast("int")))
    sums = sums.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = everything.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(whole)
    level = (F.lit(float(share)) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    sums = sums.withColumn("level", level)
    fits = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(whole)
    sums = sums.withColumn("target", F.coalesce(F.least("cap", fits["level"] * F.col("w")), F.col("cap")).cast("double"))
    epochs = F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most))))
    sums = sums.withColumn("epochs", epochs.cast("long"))
    sums = S.saved(sums.select("source", "source_size", "n", "target", "epochs", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest")), f"{here}/sources")
    count, largest = sums.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    hint = F.broadcast if count <= BROADCAST_SOURCES else lambda x: x
    buckets = 1 << max(10, math.ceil(math.log2(max(1, largest / 5_000))))
    rows = rows.withColumn("bucket", F.least(F.floor(F.col("key") * buckets), F.lit(buckets - 1)).cast("long"))
    words = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumnRenamed("source", "of")
    run = F.sum("words").over(Window.partitionBy("of").orderBy("bucket"))
    ends = words.select("of", "bucket", (run - F.col("words")).alias("below"), run.alias("upto"))
    ends = ends.join(hint(sums.select("source", "rest")), F.col("of").eqNullSafe(F.col("source"))).where((F.col("below") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
    ends = ends.select("of", F.col("bucket").alias("last"), "below")
    sums = S.saved(sums.join(hint(ends), F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), f"{here}/ends").withColumnRenamed("source", "of")
    joined = rows.join(hint(sums), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    on_last = F.coalesce(F.col("bucket") == F.col("last"), F.lit(False))
    clear = joined.where(~on_last).withColumn("extra", F.coalesce(F.col("bucket") < F.col("last"), F.lit(False)).cast("long"))
    ordered = Window.partitionBy("source").orderBy("key", "tie", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("below") + F.sum("size").over(ordered) - F.col("size") / 2
    edge = joined.where(on_last).withColumn("extra", (middle <= F.col("rest")).cast("long"))
    both = clear.unionByName(edge)
    copies = (F.col("epochs") + F.col("extra")).alias("copies")
    return both.select("doc_id", "size", "source", "source_size", "target", copies, (copies * F.col("size")).alias("taken"), *held)
