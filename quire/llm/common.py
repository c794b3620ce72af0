"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path
from tempfile import gettempdir
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Largest number of rows and of text bytes that a Python step holds at once.
BATCH_ROWS = 8192
BATCH_BYTES = 4 << 20
#: A word, as the contracts define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session on one machine (tests) may name none and gets a temporary one; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or f"file://{Path(gettempdir()) / 'quire-checkpoints'}"


def stored(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: for wide steps, of which a checkpoint would take several times the room. Whoever asks for it hands it to removed() when nothing reads it any more."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables that stored() made."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
        if path is not None:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned and run inside are deleted when its action ends. Else they stay until the driver collects garbage, which may be after all steps. Tables that are read twice should be cut() or stored(): a second run shuffles anew."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read back: its lineage ends there, so lost executors cost nothing, and values that depend on the row order are fixed."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def map_arrow(df: DataFrame, make: Callable[[], Callable[[list[list]], Iterable[list]]], schema: str | T.StructType, text: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """`mapInArrow` over bounded slices.

    `make` is called once in each task and returns a function from a slice, as one Python list for each input column, to one list for each output column. A slice has at most BATCH_ROWS rows and, if `text` names a string column, about `batch_bytes` bytes of it (a single longer text is a slice of its own).
    """
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, at = [f.name for f in out.fields], df.columns.index(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        work, arrow = make(), to_arrow_schema(out)
        for batch in batches:
            for part in slices(batch, at, batch_bytes):
                cols = work([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], names=names)
        del work
        trimmed()

    return df.mapInArrow(run, out)


@lru_cache(1)
def allocator():
    """The C library, where it can give memory back."""
    try:
        library = ctypes.CDLL("libc.so.6")
        library.malloc_trim(0)
        return library
    except (OSError, AttributeError):
        return None


def trimmed() -> None:
    """Gives free memory of this Python worker back to the machine: workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    if (library := allocator()) is not None:
        library.malloc_trim(0)


def slices(batch: pa.RecordBatch, at: int | None, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of at most BATCH_ROWS rows and, by the strings of column `at`, about `most` bytes."""
    start, held = 0, 0
    sizes = pa.compute.binary_length(batch.column(at)).to_pylist() if at is not None else [0] * batch.num_rows
    for i, n in enumerate(sizes):
        if i > start and (held + (n or 0) > most or i - start >= BATCH_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def word_count(text: Column) -> Column:
    """Number of WORD in `text`; 0 for null. Built in: white space is squeezed, then counted."""
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.split(blank, " "), lambda x: x != ""))).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A number in (0, 1) that the parts fix: the top 52 bits of their hash."""
    h = F.xxhash64(*[F.lit(p) if not isinstance(p, Column) else p for p in parts])
    return (F.shiftrightunsigned(h, 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
