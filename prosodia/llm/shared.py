"""What several operators of this subpackage need: shared-storage cuts of lineage and byte views of text columns."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark) -> str:
    """The folder in spark.checkpoint.dir. Only where it is unset and Spark runs in one process, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="prosodia-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark deletes the shuffles of a query when it ends. Otherwise they stay until the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(frame: DataFrame, free: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, each row is computed once, and a lost
    executor costs no recomputation of what lies before. discard() deletes it; clear_scratch() deletes what is left.
    With ``free`` the shuffles behind the table, which nothing reads any more, are deleted once it is written."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/prosodia/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        if free:
            spark.conf.set(CLEANUP, "true")
        frame.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    made = spark.read.schema(frame.schema).parquet(path)
    made.prosodia_path = path
    return made


def _files(spark, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(*frames: DataFrame) -> None:
    """Deletes tables of materialise() that nothing will read any more."""
    for frame in frames:
        files, where = _files(frame.sparkSession, frame.prosodia_path)
        files.delete(where, True)


def clear_scratch(spark, older_than: float = 86_400.0) -> int:
    """Deletes the tables of materialise() in the shared folder that were written more than ``older_than`` seconds ago, and
    says how many. Tables that a result is still to be read from must be younger."""
    import time

    files, where = _files(spark, f"{shared_folder(spark)}/prosodia")
    if not files.exists(where):
        return 0
    old = [f.getPath() for f in files.listStatus(where) if f.getModificationTime() < (time.time() - older_than) * 1000]
    for path in old:
        files.delete(path, True)
    return len(old)


#: Keys with more than one in so many of all rows are fewer than this, so a row for each may be sent to every task.
HOT_KEYS, HOT_ROWS = 100_000, 512


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each key and in ``rows`` how often ``left`` has it.

    Keys of more than HOT_ROWS rows and one in HOT_KEYS of ``total``, all rows of ``left``, are fewer than HOT_KEYS: they
    are sent to the rows, which are not moved. All others are joined by a shuffle in which no key is frequent. ``left`` is
    read twice, so it should be a table.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = right.where(F.col(rows) > least), right.where(F.col(rows) <= least)
    here = left.join(F.broadcast(hot), keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return here.unionByName(rest)


def unused(name: str, frame: DataFrame) -> str:
    """A column name that a frame doesn't have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z only, as the contracts ask; lower() would fold other letters too."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def utf8(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def process_store(key: tuple, make: Callable):
    """What a Python worker keeps from task to task, such as a vocabulary: ``make()`` once, until another key is asked for.
    One thing is kept at a time, so that a worker that serves stage after stage holds no earlier stage's."""
    store = sys.__dict__.setdefault("_prosodia_process_store", {})
    if key not in store:
        store.clear()
        give_back()
        store[key] = make()
    return store[key]


def give_back() -> None:
    """Returns freed memory to the system, which the allocators would keep for as long as the worker lives."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], most: int = 1 << 22) -> Callable:
    """The function for mapInArrow() with batches of at most ``most`` bytes or one row, and with freed memory given back at
    the end: Python objects of a batch of long texts stay small, and results leave in small batches as well."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stack = [batch]
            while stack:
                part = stack.pop()
                if part.num_rows > 1 and part.nbytes > most:
                    half = part.num_rows // 2
                    stack += [part.slice(half), part.slice(0, half)]
                else:
                    yield part

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(small(batches))
        give_back()

    return lean_run
