"""Potential duplicates as documents arrive: each batch compares its new classes with all classes so far, and no old ones again.

What is kept lies in a folder: the classes that each batch brought (title, sender, date, their least id and number of documents)
and the pairs that it found. A batch that runs again writes its own folders again; a later run goes on from the
checkpoint. Classes are named by a digest, as their least id may change; in the end pairs are told by least ids, and counts
stand beside them: the result is that of one pass over all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import attach
from ..operators import duplicates
from .intake import exactly

_CLASSES = "title string, correspondent string, created string, key string, id long, n long, batch long"
_PAIRS = "id1 string, id2 string, n1 long, n2 long, score double, batch long"


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of ``batch=<number>``; empty before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def _batch(rows: DataFrame, n: int, folder: str, chunk: int) -> None:
    spark = rows.sparkSession
    key = F.sha2(F.to_json(F.struct(*duplicates.FIELDS)), 256)
    duplicates.classes(rows).withColumn("key", key).write.mode("overwrite").parquet(f"{folder}/classes/batch={n}")
    known = _read(spark, f"{folder}/classes", _CLASSES).where(F.col("batch") <= n)
    each = known.groupBy(*duplicates.FIELDS, F.col("key").alias("id")).agg((F.min("batch") == n).alias("fresh")).withColumn("n", F.lit(0).cast("long"))
    duplicates.links(each, chunk).write.mode("overwrite").parquet(f"{folder}/pairs/batch={n}")


def arrived(stream: DataFrame, folder: str, chunk: int = duplicates.CLASSES) -> None:
    """Takes what has come of ``document_id, title, correspondent, created`` since the last run into ``folder``, and ends."""
    stream.writeStream.option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).foreachBatch(lambda rows, n: _batch(rows, n, folder, chunk)).start().awaitTermination()


def documents(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """The Parquet files of documents at ``path`` as they come."""
    return attach(spark).readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(exactly(path))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """All class pairs so far, by least ids and with the documents of each, as ``duplicates.class_pairs`` gives them over all documents;
    ``batch`` is the one that brought the pair, null for a class of several documents as a pair with itself."""
    c = _read(spark, f"{folder}/classes", _CLASSES).groupBy("key").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    side = lambda k: c.select(F.col("key").alias(f"id{k}"), F.col("id").alias(f"c{k}"), F.col("n").alias(f"m{k}"))
    pairs = _read(spark, f"{folder}/pairs", _PAIRS).drop("n1", "n2").join(side(1), "id1").join(side(2), "id2")
    turn = F.col("c1") > F.col("c2")
    pick = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    pairs = pairs.select(pick("c1", "c2").alias("id1"), pick("c2", "c1").alias("id2"), pick("m1", "m2").alias("n1"), pick("m2", "m1").alias("n2"), "score", "batch")
    own = c.where("n > 1").select(F.col("id").alias("id1"), F.col("id").alias("id2"), F.col("n").alias("n1"), F.col("n").alias("n2"), F.lit(100.0).alias("score"), F.lit(None).cast("long").alias("batch"))
    return pairs.unionByName(own)


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """What the scan counts as it goes: ``batch, documents, classes, pairs`` of each batch."""
    c = _read(spark, f"{folder}/classes", _CLASSES)
    first = c.groupBy("key").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count("*").alias("classes"))
    p = _read(spark, f"{folder}/pairs", _PAIRS).groupBy("batch").agg(F.count("*").alias("pairs"))
    d = c.groupBy("batch").agg(F.sum("n").alias("documents"))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return d.join(first, "batch", "left").join(p, "batch", "left").select("batch", "documents", zero("classes"), zero("pairs"))
