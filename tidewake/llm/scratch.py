"""Tables and files in the folder that driver and executors share."""

import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset the machine's own serves, but only in local mode,
    where driver and executors are one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tidewake-checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it back: lineage ends at a table that outlives executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """pyarrow's filesystem and path of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else os.path.abspath(uri))


def put(uri: str, data: bytes) -> None:
    """Writes a whole file under a name of this attempt, then moves it: attempts may race or repeat."""
    files, path = filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, path)


@contextlib.contextmanager
def writer(uri: str):
    """A stream to a file that appears whole when it ends, as with put."""
    files, path = filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(own) as out:
        yield out
    files.move(own, path)


def get_range(uri: str, at: int, size: int) -> bytes:
    files, path = filesystem(uri)
    with files.open_input_file(path) as file:
        return file.read_at(size, at)


def get(uri: str) -> bytes:
    files, path = filesystem(uri)
    with files.open_input_stream(path) as file:
        return file.read()


def drop(uri: str, keep: tuple = ()) -> None:
    """Deletes a folder with all tables and files in it, or all but those named. Nothing may read them any more."""
    from pyarrow import fs

    files, path = filesystem(uri)
    for x in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if x.base_name not in keep:
            (files.delete_dir if x.type == fs.FileType.Directory else files.delete_file)(x.path)
    if not keep and files.get_file_info(path).type == fs.FileType.Directory:
        files.delete_dir(path)


def thrifty() -> None:
    """Has arrays of 128 KB and more mapped on their own, so that their memory goes back when they go: Python workers
    live on from task to task, and what they keep counts for their executor. A no-op without glibc."""
    import ctypes

    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 17)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError, TypeError):
        pass


def trim() -> None:
    """Gives free memory back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
