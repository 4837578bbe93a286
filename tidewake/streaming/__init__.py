"""Incremental versions of the log fold and the causal merge; both equal the batch result."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.operators import causal, fold
from tidewake.sources import shared
from tidewake.sources.shared import folder


def _drain(stream: DataFrame, step, here: str, mode: str) -> None:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{here}/progress").trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()


def last_write(stream: DataFrame) -> DataFrame:
    """The state of a streamed log: max_by per key in the state store, the last batch's whole result as a table."""
    spark, here = stream.sparkSession, folder(stream.sparkSession, "stream-lww")
    _drain(fold.last_write(stream), lambda df, _: df.write.mode("overwrite").parquet(f"{here}/state"), here, "complete")
    return spark.read.parquet(f"{here}/state")


def siblings(stream: DataFrame, here: str | None = None) -> DataFrame:
    """Maximal records of a stream of records. Dominance is transitive, so the merge of a batch with the maximal
    records so far is the merge of all; no watermark, since order doesn't matter and nothing may be dropped.

    here: a shared folder that holds the progress and the state, for a stream that goes on later. Batch i merges with
    the table that batch i - 1 left, found by its number, so a batch that is repeated or comes after a restart gives the
    same. Tables older than the last two are removed."""
    spark = stream.sparkSession
    here = here or folder(spark, "stream-siblings")

    def step(df, i):
        both = spark.read.parquet(f"{here}/state{i - 1}").unionByName(df) if i else df
        causal.maximal(both).write.mode("overwrite").parquet(f"{here}/state{i}")
        if i > 1:
            shared.remove(spark, f"{here}/state{i - 2}")

    _drain(stream, step, here, "append")
    done = [int(x.removeprefix("state")) for x in shared.names(spark, here) if x.startswith("state")]
    return spark.read.parquet(f"{here}/state{max(done)}") if done else spark.createDataFrame([], stream.schema)


def window_counts(stream: DataFrame, lateness: str, width: str) -> DataFrame:
    """Events (at, op) per window of event time that the watermark has closed: start, op, n. Later ones are too late.
    Spark extra."""
    spark, here = stream.sparkSession, folder(stream.sparkSession, "stream-windows")
    counts = stream.withWatermark("at", lateness).groupBy(F.window("at", width).alias("w"), "op").agg(F.count(F.lit(1)).alias("n")).select("w.start", "op", "n")
    # A batch that is repeated writes its own folder again.
    _drain(counts, lambda df, i: df.write.mode("overwrite").parquet(f"{here}/out/batch={i}"), here, "append")
    return spark.read.schema("start timestamp, op string, n long, batch int").parquet(f"{here}/out").drop("batch")
