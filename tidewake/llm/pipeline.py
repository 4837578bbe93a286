"""From raw documents to shards: each stage works on all rows that the one before kept.

A stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read as the next
stage's docs. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bin_packing, decontaminate, jaccard_join, mixing, rule_quality, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the rule ensemble, fitted on this corpus' labels, gives 0.5 or more. Null and empty texts are scored like
    any and repeated rows alike; without labels of both classes all get the share of label 1, or 0.5, and so stay unless
    most labels are 0; without rows there are none."""
    model = rule_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_quality.score(docs, model).where("score >= 0.5").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of five-word shingle sets linked at 0.8, that of the least id (null first). Rows
    without words all stay, but of rows equal in id and text one; without rows there are none."""
    return jaccard_join.keep_one(docs.select(COLUMNS), 5, 80, 100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a shorter item whole. Null and empty texts
    hold nothing and stay, repeated rows stay or go together; an empty benchmark drops none; without rows there are none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs.select(COLUMNS), items).where(~F.col("contaminated")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents as the mix of sources says, a null source being one like any. A document without words
    adds nothing and stays as often as its source's whole epochs say; equal rows are interchangeable; without rows there
    are none."""
    mixed = mixing.mix(docs.select(COLUMNS), carry=True).where("copies > 0")
    return mixed.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen shards of near-equal bytes; equal texts share one, nulls too. Every row gets its place, repeated ones each
    their own; without rows there are none."""
    return bin_packing.pack(docs.select(COLUMNS), 16).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("source_mixing", mixture),
    ("sharding", shards),
]

#: The fitted classifier and the hashes of the mix aren't expressible in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    here = scratch.scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.saved(stage(spark, docs, sf_dir), f"{here}/{i}")
    return docs
