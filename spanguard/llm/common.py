"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import table as table

#: Bytes of text that one numpy step works on; a single longer text makes a longer step.
STEP_BYTES = 1 << 20
#: Rows that Spark sends to a Python worker at a time; whole texts of thousands of rows at once would take
#: several times their size, in the JVM and in the worker.
BATCH_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master one of its own."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir is unset; a cluster needs a folder there that all executors share")
            found = tempfile.mkdtemp(prefix="spanguard-ckpt-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def remove(spark: SparkSession, folder: str, at_exit: bool = False) -> None:
    """Delete a folder in a store that Spark reads, now or when the session's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if at_exit:
        store.deleteOnExit(path)
    else:
        store.delete(path, True)


def own_name(columns: list[str], name: str) -> str:
    """name, with underscores before it until none of the columns has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that nothing above is computed twice."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_slices(column: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole texts of about step_bytes.

    Yields (first row, row after the last, bytes, offsets of the rows in the bytes); null counts as empty.
    """
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()[:3]
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + step_bytes, side="right")) - 1)
        stop = min(stop, n)
        yield row, stop, raw[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def as_column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    found = batch.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, which bounds what a worker holds besides the batch itself."""
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            yield batch.slice(s, rows)


def _give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in small batches, by workers that give their memory back at the end of a task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(tidy, schema)
