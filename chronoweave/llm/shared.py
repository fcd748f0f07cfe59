"""Shared storage for tables that several jobs read."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

#: Writes a table under a name and gives it back as read from storage.
Writer = Callable[[DataFrame, str], DataFrame]
#: What ``mapInArrow`` takes.
Maker = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Bytes of rows that a task gathers for a row group of a file that it writes itself.
GROUP_BYTES = 1 << 24


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path below ``spark.checkpoint.dir``.

    The setting is read from the session. Only where it is unset in local
    mode, as in tests, a temporary folder of this machine becomes the
    checkpoint folder; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chronoweave-"))
        root = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= GROUP_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _file_batches(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows to one Parquet file under a hidden name of its own, which is told; no file without rows."""
    name, writer = f"_{uuid.uuid4().hex}", None
    for table in _tables(batches):
        if writer is None:
            os.makedirs(folder, exist_ok=True)
            writer = pq.ParquetWriter(f"{folder}/{name}", table.schema)
        writer.write_table(table)
    if writer is not None:
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])


def _written_by_tasks(df: DataFrame, path: str, make: Maker | None = None, schema: str = "") -> DataFrame:
    """As :func:`_written`, but on the local file system by files that Python tasks write; what ``make`` yields if it is given.

    Hadoop's local file system starts four processes for each file (``chmod``
    of it and of its checksums), and until such a child is another program it
    has the memory of its executor, which then seems to take twice its own.
    Other stores start none, and are left to Spark's writer.
    Files are hidden until the driver renames those that successful tasks
    have told; those of failed attempts stay hidden.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = df.mapInArrow(make, schema) if make else df
    if fs.getUri().getScheme() != "file":
        return _written(made, path)
    folder = fs.makeQualified(at(path)).toUri().getPath()
    told = df.mapInArrow(lambda b: _file_batches(folder, make(b) if make else b), "name string").collect()  # a row for each file
    fs.mkdirs(at(path))
    for row in told:
        if not fs.rename(at(f"{path}/{row['name']}"), at(f"{path}/part{row['name']}.parquet")):
            raise OSError(f"{path}/{row['name']} can't be renamed")
    return spark.read.schema(made.schema).parquet(path)


def persisted(df: DataFrame, name: str, by_tasks: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts lineage, and survives the loss of executors. The table stays, as
    what is built on it is read later. With ``by_tasks`` no process is started
    for a file, but rows pass through Python: for many small tables.
    """
    return (_written_by_tasks if by_tasks else _written)(df, shared_dir(df.sparkSession, name))


def persisted_map(df: DataFrame, make: Maker, schema: str, name: str) -> DataFrame:
    """``df.mapInArrow(make, schema)`` as by :func:`persisted` with ``by_tasks``; a task takes one Python worker and not two."""
    return _written_by_tasks(df, shared_dir(df.sparkSession, name), make, schema)


@contextmanager
def scratch(spark: SparkSession, name: str, by_tasks: bool = False) -> Iterator[Writer]:
    """A writer like :func:`persisted` whose tables go when the block ends; what outlives the block must not read them."""
    folder, write = shared_dir(spark, name), _written_by_tasks if by_tasks else _written
    try:
        yield lambda df, table: write(df, f"{folder}/{table}-{uuid.uuid4().hex}")
    finally:
        drop_dir(spark, folder)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`shared_dir`."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
