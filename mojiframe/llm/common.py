"""Shared helpers of the training-data operators: the shared scratch folder,
narrow input views and Arrow batch slicing."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mojiframe.session import ship  # noqa: F401

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None

#: Rows and bytes of a batch between Spark and Python: texts may be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}

#: Text bytes that one vectorised step works on; a longer single text is one step.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Only a local session may
    run without one (tests); then a scratch folder is set."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        d = tempfile.mkdtemp(prefix="mojiframe-llm-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: shuffle files of an execution go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost
    executors.  The shuffle files behind it are of no more use and go."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*tables: DataFrame, part: str = "") -> None:
    """Delete materialised tables (or one partition of them) that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, f"{t.scratch}/{part}" if part else t.scratch)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def delete_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this application from the shared folder."""
    delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def narrow(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under names of ours, so that extra columns of
    any name cannot clash: ``narrow(docs, id="doc_id", text="text")``."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in cols.items()])


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null has no remainder."""
    return F.crc32(col.cast("string").cast("binary")) % n


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not large and not pa.types.is_string(col.type) and not pa.types.is_binary(col.type):
        col = col.cast(pa.large_string())
        large = True
    _, off, data = col.buffers()
    if off is None or off.size == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(off, np.int64 if large else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` text bytes, at least one row each."""
    if batch.num_rows == 0:
        return
    _, offs = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task
    should not hold what the last one needed."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_rows(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, text (as string) and the columns to carry along, under names of ours.
    Arrow batches of the session become smaller where they have Spark's defaults."""
    conf = docs.sparkSession.conf
    for name, (default, own) in BATCHES.items():
        if conf.get(name, default) == default:
            conf.set(name, own)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       *[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)])


def map_text(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], new: str,
             limit: int = SLICE_BYTES) -> DataFrame:
    """``df`` with the columns of the DDL string ``new``.  ``make()`` runs once a
    task and gives the function from a slice of rows to the new columns."""
    fresh = StructType.fromDDL(new)
    names = [f.name for f in df.schema.fields + fresh.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for big in batches:
            for b in slices(big, "text", limit):
                yield pa.RecordBatch.from_arrays([*b.columns, *fn(b)], names=names)

    return df.mapInArrow(run, StructType(df.schema.fields + fresh.fields))


def named_again(df: DataFrame, id_col: str, keep: tuple[str, ...], *new: Column | str) -> DataFrame:
    """Undo ``text_rows``: the id, the new columns, then what was carried along."""
    return df.select(F.col("id").alias(id_col), *new, *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)])
