"""What the corpus operators share: table access, the shared work folder, grouping of a sorted stream."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import _FOLDERS, _TABLES, attach, shared_dir, sweep, temporary, unwritten, written  # noqa: F401  used by the operators

#: Most keys that ``spread_join`` broadcasts, and the rows of a key that a task may always hold.
HEAVY = 10_000
LIGHT = 256

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, filler: Column, heavy: int = HEAVY) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per ``key`` and, as ``weight``, the rows that hold it.

    No key's rows meet in one task: keys with more than ``total / heavy`` of all ``total`` rows, of which there are
    at most ``heavy``, are broadcast, and their rows lie spread by ``filler``, any value of the key's type, in the
    shuffle join with the others. A row whose key the table lacks gets nulls.
    """
    cut = max(LIGHT, total // heavy)
    cols = [c for c in table.columns if c != key]
    packed = table.select(F.col(key).alias("__k"), F.struct(*cols).alias("__v"), F.col(weight).alias("__w"))
    hot = packed.where(F.col("__w") > cut).select(F.col("__k").alias("__h"), F.col("__v").alias("__hot"))
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("__h"), "left").withColumn("__s", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(filler))
    rest = packed.where(F.col("__w") <= cut).select("__k", "__v")
    out = found.join(rest, F.col("__s") == F.col("__k"), "left").withColumn("__of", F.coalesce("__hot", "__v"))
    return out.select(*rows.columns, *[F.col(f"__of.{c}").alias(c) for c in cols])


#: Tasks that a key's rows are spread over by ``salted_join``, beside what Spark splits at run time.
SALTS = 64


def salted_join(rows: DataFrame, table: DataFrame, on: Column, spread: Column, how: str = "inner") -> DataFrame:
    """A join whose common keys nobody has counted: every row of ``table`` is sent ``SALTS`` times, and the rows of a key go to as many
    tasks by ``spread``, a number that differs between them. ``table`` has few rows for each key."""
    left = rows.withColumn("__salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    right = table.withColumn("__of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, on & (F.col("__salt") == F.col("__of_salt")), how).drop("__salt", "__of_salt")


_RESIDENT: dict = {}


def resident(key, build):
    """What a worker process keeps between tasks: one object, the last that was asked for, so that stages don't add up."""
    if key not in _RESIDENT:
        release()
        _RESIDENT[key] = build()
        _trim()  # what was only needed to build it
    return _RESIDENT[key]


def release() -> None:
    """For tasks that need the memory themselves: drops what is kept, and gives freed memory back to the system."""
    _RESIDENT.clear()
    _trim()


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


class Places:
    """Distinct non-negative numbers and their places in a list, as a hash table with open addressing, for many at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.place, self.probes = np.full(size, -1, np.int64), np.full(size, -1, np.int64), 1
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # in each round the first of those that ask for a free slot takes it
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            took = free[first]
            self.keys[at[took]], self.place[at[took]] = keys[left[took]], left[took]
            rest = np.ones(len(left), bool)
            rest[took] = False
            left, at = left[rest], (at[rest] + 1) % size
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, -1 of those that are absent."""
        at = self._slot(keys)
        got = self.keys[at]
        miss = np.flatnonzero((got != keys) & (got != -1))
        for _ in range(self.probes):
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) % len(self.keys)
            got = self.keys[at[miss]]
            miss = miss[(got != keys[miss]) & (got != -1)]
        return np.where(self.keys[at] == keys, self.place[at], -1)


def slices(texts: pa.Array, rows: int = 2048, size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of the parts of a batch that are worked on together: so many rows or bytes, one row at least."""
    length = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    at = 0
    while at < len(length):
        held = np.cumsum(length[at:at + rows])
        to = at + max(1, int(np.searchsorted(held, size, "right")))
        yield at, to
        at = to


def strings(array: pa.Array) -> list[str | None]:
    """``to_pylist`` of strings, several times as fast."""
    return array.to_numpy(zero_copy_only=False).tolist()


def rarely_collect() -> None:
    """For tasks that make many small objects and no cycles."""
    gc.set_threshold(50_000, 20, 20)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """Like ``written``, in as many buckets of ``key`` as there are shuffle partitions, so that a join on it needn't move it."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.option("path", path).bucketBy(partitions(spark), key).saveAsTable(name)
    _TABLES.append(name)
    return spark.table(name)
