"""Document issue rules, their report and the quality-scan flags.

Documents: ``document_id, title, correspondent, document_type, tags, created, text, note``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .duplicates import later_duplicates

SEVERITY = {"ocr_missing": "critical", "ocr_failed": "high", "ocr_low_quality": "medium", "missing_correspondent": "high", "missing_document_type": "medium", "missing_tags": "low", "invalid_date": "medium", "metadata_incomplete": "medium", "filename_mismatch": "low", "description_too_long": "low", "potential_duplicate": "medium"}


def ocr_issue(text: Column, least: int = 50, gibberish: float = 0.3) -> Column:
    """The first of the three text rules that holds."""
    return F.when(T.missing(text), "ocr_missing").when(F.length(F.trim(text, F.lit(" \n\t\r"))) < least, "ocr_failed").when(T.gibberish_ratio(text) > gibberish, "ocr_low_quality")


def issue_types(least_tags: int = 3, note_chars: int = 128) -> Column:
    """All issues of a row, in order, as an array of names."""
    lacks = [T.missing(F.col(c)) for c in ("title", "correspondent", "document_type", "created")] + [F.coalesce(F.size("tags"), F.lit(0)) < 1]
    many = sum((c.cast("int") for c in lacks[1:]), lacks[0].cast("int"))
    return F.array_compact(F.array(
        ocr_issue(F.col("text")), F.when(lacks[1], "missing_correspondent"), F.when(lacks[2], "missing_document_type"), F.when(F.coalesce(F.size("tags"), F.lit(0)) < least_tags, "missing_tags"),
        F.when(lacks[3], "invalid_date"), F.when(many > 2, "metadata_incomplete"), F.when(~lacks[0] & ~F.col("title").rlike(r"^\d{4}-\d{2}-\d{2}_"), "filename_mismatch"), F.when(F.length("note") > note_chars, "description_too_long")))


def issues(docs: DataFrame, duplicates: bool = False) -> DataFrame:
    """One row per document and issue, with its ``times``: 1, or, for ``potential_duplicate``, the pairs the document is first in.

    ``duplicates``: with the duplicate pass of the reference's scan.
    """
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("issue_type"))
    found = docs.select("document_id", F.explode(issue_types()).alias("issue_type"), F.lit(1).cast("long").alias("times"))
    if duplicates:
        found = found.unionByName(later_duplicates(docs).select("document_id", F.lit("potential_duplicate").alias("issue_type"), F.col("pairs").alias("times")))
    return found.withColumn("severity", severity)


def report(found: DataFrame) -> DataFrame:
    """Issues and documents by type: one shuffle, combined before it."""
    return found.groupBy("issue_type", "severity").agg(F.sum("times").alias("issues"), F.count_distinct("document_id").alias("documents"))


def by_severity(found: DataFrame) -> DataFrame:
    """Issues by type, a column for each severity."""
    return found.groupBy("issue_type").pivot("severity", ["critical", "high", "medium", "low"]).agg(F.sum("times")).na.fill(0)


def top_documents(found: DataFrame, most: int = 10) -> DataFrame:
    return found.groupBy("document_id").agg(F.sum("times").alias("issues")).orderBy(F.desc("issues"), "document_id").limit(most)


# The counts above which a recommendation is made.
RECOMMEND = {"ocr_missing": 0, "ocr_failed": 0, "missing_correspondent": 5, "potential_duplicate": 0, "missing_tags": 10}


def recommendations(found: DataFrame) -> DataFrame:
    over = F.element_at(F.create_map(*[F.lit(x) for kv in RECOMMEND.items() for x in kv]), F.col("issue_type"))
    return found.where(F.col("issue_type").isin(*RECOMMEND)).groupBy("issue_type").agg(F.sum("times").alias("issues")).where(F.col("issues") > over)


def scan_flags(docs: DataFrame) -> DataFrame:
    """The seven flags of the quality scan, a column each."""
    return docs.select("document_id", (T.missing(F.col("title")) | F.col("title").startswith("scan_")).alias("bad_title"), T.missing(F.col("correspondent")).alias("no_correspondent"), T.missing(F.col("document_type")).alias("no_type"),
                       (F.coalesce(F.size("tags"), F.lit(0)) < 1).alias("no_tags"), (F.coalesce(F.size("tags"), F.lit(0)) > 6).alias("many_tags"), (F.coalesce(F.length("text"), F.lit(0)) < 50).alias("short_text"), T.missing(F.col("created")).alias("no_date"))


FLAGS = ["bad_title", "no_correspondent", "no_type", "no_tags", "many_tags", "short_text", "no_date"]


def scan_score(flags: DataFrame) -> DataFrame:
    """One row: documents, issues, score 0..100 and its band."""
    total = sum((F.count_if(F.col(c)) for c in FLAGS[1:]), F.count_if(F.col(FLAGS[0])))
    d = flags.agg(F.count("*").alias("documents"), total.alias("issues"))
    d = d.withColumn("score", F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(F.try_divide("issues", "documents"), F.lit(0.0)) * 100))
    return d.withColumn("band", F.when(F.col("score") >= 90, "good").when(F.col("score") >= 70, "fair").otherwise("poor"))


def export(docs: DataFrame) -> DataFrame:
    """A row per document with issues, joined in the order of the rules."""
    return docs.select("document_id", "title", issue_types().alias("found")).where(F.size("found") > 0).select("document_id", "title", F.array_join("found", ", ").alias("issues"))
