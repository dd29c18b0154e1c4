"""Exact dedup as a stateful stream.

A Structured Streaming query keys its state by the digest of the normalised text; the state lies in RocksDB
on disk, never expires, and keeps for each digest the identifier that stays, the number of rows, and a locator
(file and row) of that row's content. Texts of rows whose digest was hit are then compared byte by byte with the
text at the locator; a digest that stands for different texts is taken apart by the texts themselves. The state can
live on: ``arrivals`` takes files as they come, against a store that is kept between calls. DataFrame functions only.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..streaming.intake import exactly
from ._common import shared_dir, spread_join, temporary, written

#: Micro-batches that an available input is read in.
BATCHES = 4
#: Digests with more than one row, up to this many (32 bytes each), are broadcast; more are joined by a shuffle,
#: in which no digest's rows meet.
BROADCAST_DIGESTS = 250_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """Null as empty; A-Z lower-cased, nothing else."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _locator() -> Column:
    """The file and the row in it."""
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))


def _update(state: DataFrame, out: str, log: str) -> None:
    """Runs a stream's available input into ``out``, a folder of what each batch changed."""
    spark = state.sparkSession
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(
            lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _streamed(spark: SparkSession, path: str, schema: StructType, id_col: str, text_col: str, digest: Callable[[Column], Column], files_at_once: int, call: int | None = None) -> DataFrame:
    """The state as a stream; with the number of a call, the state also keeps the locator of a row of a digest's first call."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(exactly(path))
    first = [] if call is None else [F.min_by("locator", "call").alias("origin")]
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), digest(normalised(F.col(text_col))).alias("digest"), _locator().alias("locator"), F.lit(call).alias("call")).groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max_by("locator", "doc_id").alias("locator"), *first)


def _last(spark: SparkSession, kinds: StructType, paths: list[str]) -> DataFrame:
    """An update holds a digest's state so far, so the largest is the last."""
    return spark.read.schema(kinds).parquet(*paths).groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.max_by("locator", "group_size").alias("locator"))


def keyed_state(spark: SparkSession, path: str, schema: StructType, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256, batches: int = BATCHES) -> DataFrame:
    """Streams the Parquet table at ``path``; the final state ``digest, keep_id, group_size, locator``."""
    files = len(spark.read.schema(schema).parquet(path).inputFiles())
    state = _streamed(spark, path, schema, id_col, text_col, digest, max(1, math.ceil(files / batches)))
    out, log = shared_dir(spark, "state"), shared_dir(spark, "statelog")
    _update(state, out, log)
    return _last(spark, state.schema, [f"{out}/batch=*"])


def arrivals(spark: SparkSession, path: str, store: str, schema: StructType, id_col: str = "doc_id", text_col: str = "text",
             digest: Callable[[Column], Column] = sha256, files_at_once: int = 64) -> DataFrame:
    """The rows of the Parquet files that have come to ``path`` since the last call with this ``store``, told against all rows so far:
    ``doc_id, keep_id, group_size, kept, text_sha256, locator, hit``, as they stand after this call.

    ``store`` is a folder that is kept between calls, shared by all machines: the stream's checkpoint with its RocksDB state, what
    each batch changed, and the files of each call. Only new files are read. ``hit``: an earlier call had the digest. A text whose digest
    was there before is compared, byte by byte, with the content at a locator that the state keeps of its first call, which is read from
    the file that the locator names; texts of one digest that differ raise an error here, as their counts can't be told apart afterwards
    (``exact_duplicates`` does that over a whole table). A call that broke off is made up for by the next one. Nulls, repeated ids
    and rows as in ``exact_duplicates``; no new file, no row.
    """
    fs = spark._jvm.org.apache.hadoop.fs.Path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    known = spark.read.schema("path string, upto long").parquet(f"{store}/calls/*") if there(f"{store}/calls") else spark.createDataFrame([], "path string, upto long")
    all_files = spark.createDataFrame([(f,) for f in spark.read.schema(schema).parquet(path).inputFiles()], "path string")
    new = [r["path"] for r in all_files.join(known, "path", "left_anti").collect()]  # names of files, as Spark's own listing has them
    upto = known.agg(F.max("upto")).first()[0]
    state = _streamed(spark, path, schema, id_col, text_col, digest, files_at_once, 0 if upto is None else upto + 1)
    if not new:
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, locator string, hit boolean")
    _update(state, f"{store}/state", f"{store}/log")
    made = spark.read.schema(StructType([*state.schema.fields]).add("batch", "long")).parquet(f"{store}/state")
    mine = made.where(F.col("batch") > (-1 if upto is None else upto))
    now = written(mine.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.max_by(F.struct("locator", "origin"), "group_size").alias("l")).select("digest", "keep_id", "group_size", "l.*"), "now")
    rows = spark.read.schema(schema).parquet(*new)
    docs = rows.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    docs = docs.withColumn("digest", digest(F.col("text")))
    size = docs.groupBy("digest").agg(F.count("*").alias("here"))
    told = written(now.join(size, "digest").withColumn("hit", F.col("group_size") > F.col("here")), "told")
    spread = F.coalesce(F.col("doc_id"), F.monotonically_increasing_id()).cast("string").cast("binary")
    # the content that the first locator names, in a file of an earlier call if that had the digest, against the least and greatest text here
    shared = told.where("group_size > 1").select("digest", F.col("origin").alias("locator"), F.regexp_extract("origin", "^(.*)#", 1).alias("file"))
    places = [r["file"] for r in shared.select("file").distinct().collect()]  # names of files
    if places:
        kept_rows = spark.read.schema(schema).parquet(*places).select(_locator().alias("locator"), normalised(F.col(text_col)).alias("located"))
        located = kept_rows.join(shared.select("digest", "locator"), "locator").select("digest", "located")
        ends = docs.join(shared.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
        mixed = ends.join(located, "digest", "left").where("not (least <=> located and most <=> located)")
        if not mixed.isEmpty():
            raise ValueError("texts of one digest differ: " + mixed.select(F.lower(F.hex("digest"))).first()[0])
    spark.createDataFrame([(f, made.agg(F.max("batch")).first()[0]) for f in new], "path string, upto long").write.parquet(f"{store}/calls/{uuid.uuid4().hex[:12]}")
    rows = docs.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256"))
    out = spread_join(rows, told, "digest", "here", told.agg(F.coalesce(F.sum("here"), F.lit(0))).first()[0], spread)
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256", "locator", "hit")


def exact_duplicates(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256,
                     batches: int = BATCHES) -> DataFrame:
    """One row per row of the Parquet table at ``path``: ``doc_id, keep_id, group_size, kept, text_sha256, locator``.

    Null texts are empty texts. Of equal texts the largest id stays; if that id has several such rows, all of
    them are marked kept, as they are the same row. A null id stays only if its text has no other id. An empty
    table gives no rows; columns other than the id and the text are ignored, whatever their names. ``locator``: the
    file and row of the content that stays; null where texts of one digest had to be told apart. Only the
    given path is read, no other table beside it.
    """
    table = spark.read.parquet(path)
    if table.isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, locator string")
    with temporary(spark) as keep:  # the stream has ended: its state is in the table
        state = keep(written(keyed_state(spark, path, table.schema, id_col, text_col, digest, batches), "final"))
    total = state.agg(F.sum("group_size")).first()[0]
    hits = state.where("group_size > 1")
    docs = table.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("text"), _locator().alias("place"))
    docs = docs.withColumn("digest", digest(F.col("text")))
    spread = F.coalesce(F.col("doc_id"), F.monotonically_increasing_id()).cast("string").cast("binary")
    if hits.count() <= BROADCAST_DIGESTS:
        hit = docs.join(F.broadcast(hits.select("digest", "locator")), "digest")
    else:
        hit = spread_join(docs, hits.select("digest", "locator", "group_size"), "digest", "group_size", total, spread).where("group_size is not null")
    # the text at the locator, and the least and the greatest of the digest, combined in each task before the shuffle: all bytes are equal only if these are
    at = F.when(F.col("place") == F.col("locator"), F.col("text"))
    full = hit.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"), F.max(at).alias("located"))
    mixed = written(full.where("not (least <=> located and most <=> located)").select("digest"), "mixed")
    rows = docs.select("doc_id", "digest", (F.lower(F.hex("digest")) if digest is sha256 else F.sha2("text", 256)).alias("text_sha256"), "text")
    if mixed.isEmpty():
        out = rows.drop("text")
        apart = None
    else:
        apart = rows.join(mixed, "digest", "left_semi")
        own = apart.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = apart.join(own, ["digest", "text"]).select("doc_id", "digest", "text_sha256", "keep_id", "group_size", F.lit(None).cast("string").alias("locator"))
        out = rows.drop("text").join(mixed, "digest", "left_anti")
    out = spread_join(out, state, "digest", "group_size", total, spread)
    if apart is not None:
        out = out.select(*apart.columns).unionByName(apart)
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256", "locator")
