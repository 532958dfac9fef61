"""Shared pieces of the llm operators: tables, tokens, shared storage and Arrow plumbing."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what bytes.split() and the contract's `[^\x20\x09-\x0D]+` both split on.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=8)
def _own_dir(app: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='siltscan-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set on the context. Where
    neither is set, a temporary folder in local mode, where all share one disk; on a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = own.get() if own.isDefined() else None
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _own_dir(spark.sparkContext.applicationId)
    return path.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders written by this process and not deleted yet.
_written: dict[str, SparkSession] = {}


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """While it lasts, the engine deletes a query's shuffle files when the query ends, not when the driver next collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


#: Share of the driver's largest heap from which its garbage is collected after a write.
HEAP = 0.5


def relieve(spark: SparkSession) -> None:
    """Collect the driver's garbage once its heap has grown to `HEAP` of what it may be.

    Broadcasts, records of shuffles, buffers and generated classes of ended queries else stay until the heap is full, and the heap never shrinks."""
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP * heap.maxMemory():
        jvm.java.lang.System.gc()


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut, and losing an executor loses nothing.

    Shuffle files of the write are deleted at its end, as nothing reads them again. The folder is deleted by `drop`, by `Scratch` or when the process ends."""
    path = f"{shared_dir(df.sparkSession)}/siltscan-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with _cleaning(df.sparkSession):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _written[path] = df.sparkSession
    relieve(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def delete(paths: list[str]) -> None:
    for path in paths:
        spark = _written.pop(path, None)
        if spark is not None and (jvm := spark.sparkContext._jvm) is not None:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def drop(*frames: DataFrame) -> None:
    """Delete what materialise() wrote for these frames; nothing may read them afterwards."""
    delete([f._written for f in frames if hasattr(f, "_written")])


class Scratch:
    """With-block at whose end everything materialised inside it is deleted."""

    def __enter__(self) -> Scratch:
        self.before = set(_written)
        return self

    def keep(self, *frames: DataFrame) -> None:
        self.before |= {f._written for f in frames}

    def __exit__(self, *_: object) -> None:
        delete([p for p in _written if p not in self.before])


@atexit.register
def _clear() -> None:
    with contextlib.suppress(Exception):  # the gateway may be gone
        delete(list(_written))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo `modulus`, equals `remainder`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words of a UTF-8 text. bytes.lower() leaves non-ASCII bytes alone."""
    return text.lower().split()


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_bytes(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose column `name` holds about `most` bytes at a time, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)
