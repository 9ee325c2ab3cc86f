"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..session import scratch_path

# Texts of one Arrow batch, and the part of a batch that is worked on at once.
BATCH_BYTES = 32 << 20
SMALL_BATCH = 8 << 20
SLICE_BYTES = 4 << 20
# Bits of the membership filters that are broadcast: 8 MiB, whatever the size of the input.
FILTER_BITS = 26


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Keep Arrow batches small in bytes; rows alone say nothing about texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return base.select(*columns) if columns else base


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from its files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """A place in the list of scratch folders, for `discard_since`."""
    return len(session._SCRATCH)


def discard_since(mark: int, *kept: DataFrame) -> None:
    """Delete the scratch folders made since the mark but for those of the kept tables."""
    spark = kept[0].sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    names = {f.rsplit("/", 2)[-2] for df in kept for f in df.inputFiles()}
    for folder in session._SCRATCH[mark:]:
        if folder.rsplit("/", 1)[-1] not in names:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def worker_cache(name: str, make):
    """An object kept for the life of a Python worker, across tasks."""
    holder = sys.modules.setdefault("_sievewright_worker", types.ModuleType("_sievewright_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in consecutive slices of about `limit` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def slot_of(column: str):
    """Bit number of a value in the membership filters."""
    return F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))


def bitmap_of(slots: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the bits of the column `slot`: no value is missed, a few others pass.

    Spark ORs the bits of a word together, so at most 2**20 words come to the driver.
    """
    words = (slots.groupBy(F.shiftright("slot", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow())
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bitmap


def passes(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 6] >> (slots & 63)) & 1 == 1
