"""Shared folder, shard files and text patterns that several operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """This application's folder under the cluster's shared spark.checkpoint.dir.

    Only a local master, whose executors are this process, may do without that setting: it gets a folder of its own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        base = context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tokenlake-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tokenlake/{context.applicationId}"


def release() -> None:
    """Give memory that this process no longer uses back to the system: idle workers stay alive, and count."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in this application's."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all that this application has in the shared folder: for callers that have taken their results."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame, rows: int = 1000, size: int = 32 << 20) -> DataFrame:
    """df, with its session's Arrow batches bounded to `rows` and `size` bytes (less, if the session says so already).

    Rows hold whole texts, so ten thousand of them (Spark's default) are far more memory than a task needs at once. Spark
    reads these settings when the plan runs, which is after this returns, so they stay set.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        have = df.sparkSession.conf.get(key).rstrip("b")
        if not (have.isdigit() and 0 < int(have) <= most):
            df.sparkSession.conf.set(key, str(most))
    return df


def joined(rows: DataFrame, values: DataFrame, key: list[str], n: str, total: int, how: str = "left", parts: int = 512) -> DataFrame:
    """rows with the columns of values, a table with a row per key and n: how many of `rows` have it. No key is a task of its own.

    Keys that more than one in `parts` of all `total` rows have, fewer than `parts` keys, are broadcast, so that their
    rows stay where they are; the other keys are joined by a shuffle. n is not in the result.
    """
    hot = F.col(n) > F.lit(total // parts)
    few, rest = values.where(hot).drop(n), values.where(~hot).drop(n)
    if few.isEmpty():
        return rows.join(rest.hint("merge"), key, how)
    others = rows.join(F.broadcast(few.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(others.join(rest.hint("merge"), key, how))


def saved(df: DataFrame, name: str, sort: list[str] | None = None) -> DataFrame:
    """df, written as a table in the shared folder and read again: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> str:
    """The folder in the shared one that df is written to, for workers that read it themselves."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return path


def read_columns(path: str, *columns: str) -> list:
    """Columns (numpy arrays, or lists of bytes) of a table written to the shared folder, read by one process."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = filesystem(path)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
    tables = [pq.read_table(f, columns=list(columns), filesystem=store) for f in files]
    import pyarrow as pa

    whole = pa.concat_tables(tables)
    return [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in (whole.column(n) for n in columns)]


def filesystem(uri: str):
    """(pyarrow file system, path) of a shared folder's URI or absolute path, on the driver or an executor."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n
