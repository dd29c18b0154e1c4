"""Incremental intake: row rules over a stream of documents, mails once each."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.issues import ocr_issue


def exactly(path: str) -> str:
    """A pattern that matches this path alone, or the path if it is a pattern: a stream reads folders or patterns, and a
    table may be one file."""
    path = path.rstrip("/")
    if any(c in path for c in "*?[{"):
        return path
    k = max(i for i, c in enumerate(path) if c.isalnum())
    return f"{path[:k]}[{path[k]}]{path[k + 1:]}"


def ocr_issues(spark: SparkSession, path: str) -> DataFrame:
    """A streaming frame of the text issues of the Parquet documents at ``path``."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(exactly(path))
    return rows.select("doc_id", ocr_issue(F.col("text")).alias("issue_type")).where("issue_type is not null")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Reads what there is, appends it to Parquet and ends; a later run goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def once_each(mails: DataFrame, overlap: str = "1 day") -> DataFrame:
    """Mails that an overlapping fetch reads twice pass once."""
    return mails.withWatermark("sent", overlap).dropDuplicatesWithinWatermark(["account", "uid"])


def poll(stream: DataFrame, out: str, checkpoint: str, seconds: int = 300, most: int | None = None) -> int:
    """Fetches every ``seconds`` (60 to 3600), ``most`` times or until it is stopped: each round reads what has come since
    the last one. Returns the rounds that were run."""
    if not 60 <= seconds <= 3600:
        raise ValueError("the interval is 60 to 3600 seconds")
    rounds = 0
    while most is None or rounds < most:
        if rounds:
            time.sleep(seconds)
        run_available(stream, out, checkpoint)
        rounds += 1
    return rounds


def totals(stream: DataFrame, key: str = "account") -> DataFrame:
    """A stream's running totals by key."""
    return stream.groupBy(key).agg(F.count("*").alias("processed"), F.sum("attachments").alias("attachments"))


def scan(spark: SparkSession, path: str, work: str) -> tuple[DataFrame, DataFrame]:
    """The text issues of the documents at ``path`` as they come, and, at the end of what there is, how many there are of each."""
    run_available(ocr_issues(spark, path), f"{work}/issues", f"{work}/log")
    found = spark.read.schema("doc_id long, issue_type string").parquet(f"{work}/issues")
    return found, found.groupBy("issue_type").agg(F.count("*").alias("issues"))
