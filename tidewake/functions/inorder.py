"""Rows of a key in order for Python, which holds a batch of them at a time whatever the key's rows are."""

from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, BYTES = 10_000, 8 << 20  # of a batch that Python makes


def by(df: DataFrame, key: str, *order) -> DataFrame:
    """Each key's rows one after another in one partition, in order. Spark sorts, on disk where memory ends."""
    return df.repartition(F.col(key)).sortWithinPartitions(key, *order)


def groups(batches):
    """(key, iterator of rows) of each key, which the first column has. The rows must be read before the next key."""
    return groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), itemgetter(0))


def batches(rows, fields: dict):
    """Record batches of rows with these fields: Arrow types by name."""
    import pyarrow as pa

    schema = pa.schema(list(fields.items()))
    pack = lambda kept: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), schema.types, strict=True)], schema=schema)
    kept, size = [], 0
    for r in rows:
        kept.append(r)
        size += sum(len(v) for v in r if isinstance(v, str | bytes))
        if len(kept) == ROWS or size >= BYTES:
            yield pack(kept)
            kept, size = [], 0
    if kept:
        yield pack(kept)
