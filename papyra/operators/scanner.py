"""A table function that tells the issues of documents as they pass and, at the end of each part, its statistics."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .. import attach, written

#: Parts that documents are dealt out to, by a hash of their id.
PARTS = 256
RESULT = StructType([StructField("kind", StringType()), StructField("document_id", LongType()), StructField("issue_type", StringType()), StructField("n", LongType())])


@udtf
class Scan:
    """``document_id, issues, part``, partitioned by part: a row ``issue`` for each issue of a document; when a part ends, rows ``total``
    with the number of each issue, and one of all documents (no issue type)."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or {"document_id", "issues", "part"} - {f.name for f in rows.dataType}:
            raise ValueError("scan takes a table of document_id, issues and part")
        return AnalyzeResult(schema=RESULT, partitionBy=[PartitioningColumn("part")], orderBy=[OrderingColumn("document_id")])

    def __init__(self) -> None:
        self.documents, self.issues = 0, Counter()

    def eval(self, row: Row) -> Iterator[tuple]:
        self.documents += 1
        for issue in row["issues"] or ():
            self.issues[issue] += 1
            yield "issue", row["document_id"], issue, 1

    def terminate(self) -> Iterator[tuple]:
        if self.documents:
            yield "total", None, None, self.documents
        for issue, n in sorted(self.issues.items()):
            yield "total", None, issue, n


def scanned(docs: DataFrame, issues: Column, parts: int = PARTS) -> DataFrame:
    """One pass over ``document_id`` and what ``issues`` (an array of names) tells: ``kind, document_id, issue_type, n``.

    A row ``issue`` for each, and a row ``total`` for each kind of issue and for all documents (null). Null ids are documents too;
    a null array is no issue. An empty table gives no rows.
    """
    spark: SparkSession = attach(docs.sparkSession)
    name, view = (f"papyra_{k}_{uuid.uuid4().hex[:12]}" for k in ("scan", "rows"))
    spark.udtf.register(name, Scan)
    docs.select(F.col("document_id").cast("long").alias("document_id"), issues.alias("issues"), F.pmod(F.xxhash64("document_id", issues), F.lit(parts)).alias("part")).createOrReplaceTempView(view)
    out = spark.sql(f"select * from {name}(table({view}))")
    spark.catalog.dropTempView(view)
    told = written(out, "scan")  # the function runs once
    totals = told.where("kind = 'total'").groupBy("kind", "issue_type").agg(F.sum("n").alias("n"))
    return told.where("kind = 'issue'").unionByName(totals.select("kind", F.lit(None).cast("long").alias("document_id"), "issue_type", "n"))
