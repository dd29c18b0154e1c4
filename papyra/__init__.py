"""Document analytics on PySpark."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


#: Bytes of an Arrow batch between the JVM and Python, unless the session sets them: each task holds several, beside the heap.
ARROW_BYTES = 4 * 1024 * 1024
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def attach(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package (on a cluster, ship it with ``--py-files``), and keeps Arrow
    batches of long texts small where the session has Spark's default of 64 MB."""
    if spark.conf.get(_ARROW, None) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(_ARROW, ARROW_BYTES)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), top) if x)
    return spark


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """In this block, Arrow batches hold few bytes also where the session has not set their size (``attach`` sees only one that is set)."""
    before = spark.conf.get(_ARROW)
    if before in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(_ARROW, ARROW_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_ARROW, before)


#: Folders and tables that operators of this session have made, and where the frames are that read them.
_FOLDERS: list[str] = []
_TABLES: list[str] = []
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; only where that is unset and all run on
    this machine (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("papyra.work.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="papyra-")
        spark.conf.set("papyra.work.dir", base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder in it, which ``sweep`` removes."""
    _FOLDERS.append(f"{work_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}")
    return _FOLDERS[-1]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage, is computed once, and its rows stay in their partitions."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unwritten(*frames: DataFrame) -> None:
    """Deletes the tables of frames that ``written`` gave and that nothing reads any more."""
    for df in frames:
        path = _PATHS.pop(df, None)
        if path in _FOLDERS:
            _delete(df.sparkSession, path)
            _FOLDERS.remove(path)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes, at the end of the block, the tables made in it, but for those of the frames given to what it yields."""
    folders, tables, kept = len(_FOLDERS), len(_TABLES), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(_PATHS[df])
        return df

    yield keep
    for name in _TABLES[tables:]:
        spark.sql(f"drop table if exists {name}")
    del _TABLES[tables:]
    made = _FOLDERS[folders:]
    _FOLDERS[folders:] = [f for f in made if f in kept]
    for f in made:
        if f not in kept:
            _delete(spark, f)


def sweep(spark: SparkSession) -> None:
    """Deletes what the operators of this session have left in the shared folder. For after their results are read:
    a frame that an operator returned reads these tables."""
    while _TABLES:
        spark.sql(f"drop table if exists {_TABLES.pop()}")
    while _FOLDERS:
        _delete(spark, _FOLDERS.pop())


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place, from 0, in the order of some columns, nulls first: they are dealt out in ranges and counted in
    each, after the counts of the ranges before, so that they needn't meet in one task."""
    dealt = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    return dealt.join(F.broadcast(before), "_part").withColumn(name, place).drop("_part", "_n", "_before")


def totals_within(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums, up to each row in an order of its key's rows (which must tell them apart): ``name: what each row adds``.

    Rows are dealt out in ranges of the keys and the order and summed in each; what a key's parts before have is added from a row for each
    part. So the rows of a common key needn't meet in one task."""
    added = {f"_{k}": c for k, c in sums.items()}
    dealt = written(rows.withColumns(added).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "totals")
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part", *keys).agg(*[F.sum(k).alias(k) for k in added])
    before = parts.select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_key_{k}") for k in keys], *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_before{k}") for k in added])
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = dealt.select("*", *[F.sum(k).over(inside).alias(f"_inside{k}") for k in added]).join(before, same)
    return out.select(*rows.columns, *[(F.col(f"_inside_{k}") + F.col(f"_before_{k}")).alias(k) for k in sums])
