"""Shared folders, cut lineage, row keys and word rules of the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and every executor see, below ``spark.checkpoint.dir``.

    A machine-local folder stands in only where the setting is unset and the session is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-shared-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to a table in the shared folder and read them back; cuts the lineage."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder that no plan reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def filesystem(uri: str):
    """Arrow file system and path of a URI, for use inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def publish(uri: str, name: str, write) -> None:
    """Write one file of a task: to a name of its own first, then moved in one step.

    A repeated or speculative attempt replaces the file by the same bytes.
    """
    store, folder = filesystem(uri)
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        write(out)
    store.move(part, f"{folder}/{name}")


_KEPT: dict = {}


def kept(key, make):
    """The object that a worker keeps for later tasks; there is one, so what tasks of another key kept is let go."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """A worker's kept object is of an earlier job: its memory is free for this one."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: Python objects and results of a task are those of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def held_out(doc_id: str | Column, parts: int, rest: int = 2) -> Column:
    """True where the CRC-32 of the id as text leaves ``rest``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % parts == rest


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other letter left; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
