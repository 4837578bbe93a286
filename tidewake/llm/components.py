"""Connected components of links between long ids, in tables of the shared folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch as S


def components(links: DataFrame, here: str) -> DataFrame:
    """(id, label) for each end of links (a, b): label is the least id that links reach.

    Each pass takes the least label of the neighbours and then the label of that label, so stars end after
    two passes and chains after a logarithm of their length; every pass is a table, so none is recomputed."""
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = S.saved(edges, f"{here}/edges")
    labels = S.saved(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), f"{here}/labels0")
    i = 0
    while True:
        i += 1
        least = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(least, F.col("id") == F.col("a")).select("id", "label", F.least("label", "m").alias("to"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("root"))
        after = near.join(jump, F.col("to") == F.col("via")).select("id", F.least("to", "root").alias("new"), "label")
        after = S.saved(after, f"{here}/labels{i}")
        labels = after.select("id", F.col("new").alias("label"))
        if after.where("new <> label").isEmpty():
            return labels
