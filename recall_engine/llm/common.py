"""What the operators share: staged tables with an owner, and whole texts as numpy arrays inside tasks.

Text columns may be null (read as empty) and of any length. Arrow batches are cut into slices of about
``SLICE_BYTES`` of text, so a task's memory follows that figure or its longest single text.
"""

from __future__ import annotations

import atexit
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.staging import new_path

SLICE_BYTES = 2 << 20
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables an operator stages below ``spark.checkpoint.dir``.

    They are dropped when the ``with`` block ends; those staged with ``keep=True``, which a returned lazy
    DataFrame still reads, when the application ends. The shuffle files of a staging job go with the job.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self._paths:
            delete(self.spark, path)

    def stage(self, df: DataFrame, label: str, keep: bool = False) -> DataFrame:
        path = new_path(self.spark, label)
        if keep:
            atexit.register(delete, self.spark, path)
        else:
            self._paths.append(path)
        before = self.spark.conf.get(_CLEAN_UP, "false")
        self.spark.conf.set(_CLEAN_UP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else untouched."""
    return F.translate(text, UPPER, LOWER)


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column without nulls, as one large string array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes in a row, and where each text starts (one more entry than texts)."""
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text; a longer text makes a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


@lru_cache(maxsize=4)
def powers(base: int, bits: int) -> np.ndarray:
    """The first 2**bits powers of ``base`` modulo 2**64."""
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)
