"""What several operators of this subpackage share: tables cut from their lineage, Arrow batches, joins."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.session import shared_folder

#: Rows that a Python worker gets at once while a table is written: whole texts are wide, and memory must not follow their number.
BATCH_ROWS = 250

#: A side of a join is broadcast if it is measured to have at most so many rows and bytes of files.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Bytes of files that a partition of a table in order has, up to so many partitions.
RANGE_BYTES, MOST_RANGES = 32 << 20, 20_000


def new_folder(spark: SparkSession, what: str) -> str:
    """A name for a new folder below the one that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str = "table", batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    A lost executor then costs the tasks it ran, not the work before this table.
    The table also forgets how it was partitioned, so that a later join deals its
    rows anew and Spark can split a hot key.
    """
    path = new_folder(df.sparkSession, what)
    with small_batches(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> list[tuple]:
    """(file system, path) of each folder that a table is read from."""
    sc = df.sparkSession.sparkContext
    paths = [sc._jvm.org.apache.hadoop.fs.Path(f) for f in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})]
    return [(p.getFileSystem(sc._jsc.hadoopConfiguration()), p) for p in paths]


def drop_settled(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    for place, path in _folders(df):
        place.delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """While this is open, Python workers get at most so many rows at once: for wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def plain_state(thing) -> dict:
    """What an object of a class of this package holds, as dictionaries of plain values.

    Broadcasts are pickled by name of their classes, and workers need not have the
    package; functions travel by value and build the object again (``rebuilt``).
    """
    return {k: plain_state(v) if hasattr(v, "__dict__") and not isinstance(v, np.ndarray) else v for k, v in vars(thing).items()}


def rebuilt(kind: type, state: dict, **parts: type):
    """An object of ``kind`` with the values of ``plain_state``; ``parts`` names the classes of those that are objects themselves."""
    made = kind.__new__(kind)
    vars(made).update({k: rebuilt(parts[k], v) if k in parts and v is not None else v for k, v in state.items()})
    return made


def tidy() -> None:
    """Give freed memory back to the system. Idle workers stay with their executor, and what each keeps adds up over the stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable, keeps_pieces: bool = False) -> Callable:
    """A function over the batches of a task that leaves no freed memory behind.

    Pieces of text that earlier tasks of the worker remembered go, unless the function
    is one that uses them.
    """

    def wrapped(source: Iterator) -> Iterator:
        if not keeps_pieces:
            vars(sys.modules.get("tokenizers", ctypes)).pop("_scanloom_pieces", None)
        try:
            for n, made in enumerate(run(source)):
                yield made
                del made
                if n % 16 == 15:
                    tidy()
        finally:
            tidy()

    return wrapped


def batches(columns: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable:
    """A function for ``mapInArrow`` that turns each batch into columns of ``schema``."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            made = columns(batch)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if not isinstance(made[f.name], pa.Array) else made[f.name] for f in schema], schema=schema)

    return tidied(run)


def measured(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a settled table or columns of one, marked for broadcast if it is measured to be small in rows and bytes."""
    if sum(place.getContentSummary(path).getLength() for place, path in _folders(df)) > size:
        return df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that ``df`` has already: for columns of its rows that are dropped again."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def range_partitions(written: DataFrame, size: int = RANGE_BYTES, most: int = MOST_RANGES) -> int:
    """Partitions to deal the rows of a settled table to: each of about ``size`` bytes of its files, at least one for each core.

    Beyond ``most`` partitions each grows, as Spark samples keys for every one of them.
    """
    held = sum(place.getContentSummary(path).getLength() for place, path in _folders(written))
    return min(most, max(written.sparkSession.sparkContext.defaultParallelism, -(-held // size)))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of keys that also holds for null and null."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of ``values`` in the given order joined, and where each begins, with the end of the last."""
    n = lengths[order]
    at = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(starts[order] - at[:-1], n) + np.arange(at[-1])], at
