"""Pieces shared by the text operators: tables in the shared folder, bit sieves, word tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import sys
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def crc_mod(col: str, mod: int) -> Column:
    """Remainder of the CRC-32 of a column written as text."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod))


class Scratch:
    """Tables written once to the session's shared folder, so that lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/opinara-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, name: str | None = None) -> None:
        """Delete a table no longer needed, or all."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


# A sieve is a bitmap of 2^SIEVE_BITS bits over hashed keys, kept as rows of 4 KiB: at most 2 MiB in
# all, whatever the number of keys. It lets a scan skip rows that are surely not wanted; rows it lets
# through are checked exactly afterwards, so a full sieve costs time and never a wrong row.
SIEVE_BITS = 24
_ROW_BITS = 15


def _slot(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))


def sieve(df: DataFrame, key: Column) -> DataFrame:
    """Bitmap rows of the keys of ``df``."""
    slots = df.select(_slot(key).alias("_s"))
    return slots.groupBy(F.shiftright("_s", _ROW_BITS).alias("_chunk")).agg(
        F.bitmap_construct_agg(F.col("_s").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).alias("_bits"))


def marked_by_sieve(df: DataFrame, bits: DataFrame, key: Column, name: str) -> DataFrame:
    """Add a flag: false where the key is surely not in the sieve. The bitmap is at most 2 MiB."""
    slot = _slot(key)
    at = slot.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    marked = df.withColumns({"_chunk": F.shiftright(slot, _ROW_BITS), "_at": at})
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(shiftright(_at, 3) + 1 as int), 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.col("_at").bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    joined = marked.join(F.broadcast(bits), "_chunk", "left")
    return joined.withColumn(name, hit).drop("_chunk", "_at", "_bits")


def pieces(batches, rows: int = 1_000):
    """Arrow batches in parts of at most ``rows`` rows, which bounds what a task builds at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def apart(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The table with its columns called ``_in0, _in1, …``, which no operator uses, and the new names of some.

    Operators that add columns of their own to a caller's table work on this and give the names back with ``toDF``.
    """
    at = {c.lower(): f"_in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))]), [at[n.lower()] for n in names]


def share_value(spark: SparkSession, value) -> Callable[[], object]:
    """Send a value to all executors once. What is returned makes the value anew, in a task.

    The value travels as bytes, its classes included, so that executors need not have this package.
    """
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(shared.value)


def process_cache(key: tuple, make: Callable[[], object]):
    """What ``make`` gives, kept across the tasks of a Python worker until another key is asked for.

    A worker holds one such table at a time, so the stages of a pipeline do not add up in memory.
    """
    store = sys.__dict__.setdefault("_opinara_cache", {})
    if key not in store:
        store.clear()
        gc.collect()
        # What the last table took goes back to the system, or it would stay with the worker.
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        store[key] = make()
    return store[key]


class WordTable(dict):
    """Numbers the words seen so far. ``grow`` makes the table rows of words not seen before.

    Holds at most ``limit`` words between calls; beyond that it starts anew, which costs time only.
    """

    def __init__(self, grow: Callable[[list[bytes]], None], reset: Callable[[], None], limit: int):
        super().__init__()
        self.fresh: list[bytes] = []
        self._grow, self._reset, self._limit = grow, reset, limit

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        self.fresh.append(word)
        return code

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self._limit:
            self.clear()
            self._reset()
        got = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            self._grow(self.fresh)
            self.fresh = []
        return got


class Rows:
    """A growing array of table rows."""

    def __init__(self, width: int | None, dtype):
        self._shape = () if width is None else (width,)
        self._dtype = dtype
        self.clear()

    def clear(self) -> None:
        self._data, self._n = np.empty((1024, *self._shape), self._dtype), 0

    def extend(self, rows: np.ndarray) -> None:
        need = self._n + len(rows)
        if need > len(self._data):
            more = np.empty((max(need, 2 * len(self._data)), *self._shape), self._dtype)
            more[: self._n] = self._data[: self._n]
            self._data = more
        self._data[self._n : need] = rows
        self._n = need

    @property
    def view(self) -> np.ndarray:
        return self._data[: self._n]
