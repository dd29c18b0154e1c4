"""Sources: document filters, mail messages and their attachments."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SIZE_LIMIT = 50 * 1024 * 1024
EXTENSIONS = [".pdf", ".png", ".jpg", ".jpeg", ".tiff"]


def filtered(docs: DataFrame, since: str | None = None, until: str | None = None, correspondent: str | None = None, any_tag: list[str] | None = None, has_ocr: bool | None = None,
             document_type: str | None = None, order: str | None = None) -> DataFrame:
    """The conjunction of the conditions that are given; dates compare as dates, an empty tag list is no condition. In the
    order of a column, descending after ``-``, ties by id."""
    out = docs
    if since:
        out = out.where(F.to_date("created") >= F.lit(since).cast("date"))
    if until:
        out = out.where(F.to_date("created") <= F.lit(until).cast("date"))
    if correspondent:
        out = out.where(F.col("correspondent") == correspondent)
    if any_tag:
        out = out.where(F.arrays_overlap("tags", F.array(*map(F.lit, any_tag))))
    if has_ocr is not None:
        out = out.where((F.coalesce(F.length("text"), F.lit(0)) > 0) == has_ocr)
    if document_type:
        out = out.where(F.col("document_type") == document_type)
    if order:
        out = out.orderBy(F.desc(order[1:]) if order.startswith("-") else F.asc(order), "document_id")
    return out


def by_id(table: DataFrame, ids: list[int], id_col: str = "id") -> DataFrame:
    """The rows of some ids: a filter that reaches the scan."""
    return table.where(F.col(id_col).isin(ids))


def first_names(dim: DataFrame, page: int = 100) -> DataFrame:
    """A dimension's first page of names."""
    return dim.select("name").orderBy("name").limit(page)


def staged(spark: SparkSession, path: str) -> DataFrame:
    """``path, month, filename`` of ``<month>/*.pdf`` under a staging folder; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(f"{path.rstrip('/')}/*/")
    return found.select("path", F.element_at(F.split("path", "/"), -2).alias("month"), F.element_at(F.split("path", "/"), -1).alias("filename"))


def allowed(name: Column, extensions: list[str] = EXTENSIONS) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1)).isin(extensions)


def messages(mails: DataFrame, now: str) -> DataFrame:
    """``uid, content`` (MIME bytes) to a row per mail: subject, sender, date (``now`` if there is none that can be read), plain body."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            rows = []
            for uid, raw in zip(d["uid"], d["content"]):
                m = email.message_from_bytes(bytes(raw), policy=email.policy.default)
                body = m.get_body(("plain", "html"))
                try:
                    sent = m["date"].datetime.isoformat()
                except (AttributeError, ValueError, TypeError):
                    sent = None
                try:
                    text = body.get_content() if body else ""
                except (LookupError, ValueError):
                    text = (body.get_payload(decode=True) or b"").decode("utf-8", "replace")
                rows.append((uid, str(m["subject"] or ""), str(m["from"] or ""), sent, text))
            yield pd.DataFrame(rows, columns=["uid", "subject", "sender", "sent", "body"])

    d = mails.select("uid", "content").mapInPandas(run, "uid string, subject string, sender string, sent string, body string")
    return d.withColumn("sent", F.coalesce(F.try_to_timestamp("sent"), F.lit(now).cast("timestamp")))


def searched(docs: DataFrame, query: str) -> DataFrame:
    """Rows whose text holds the query, case aside."""
    return docs.where(F.lower("text").contains(query.lower()))


def magic(content: Column) -> Column:
    """The kind of file that the first bytes tell."""
    h = F.hex(F.substring(content, 1, 8))
    return F.when(h.startswith("25504446"), "pdf").when(h.startswith("FFD8"), "jpeg").when(h == "89504E470D0A1A0A", "png").when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff")


def attachments(mails: DataFrame) -> DataFrame:
    """``uid, content`` (MIME bytes) to a row per attachment that is allowed: by disposition, extension, size and first bytes.

    A date that can't be read is null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            rows = []
            for uid, raw in zip(d["uid"], d["content"]):
                m = email.message_from_bytes(bytes(raw), policy=email.policy.default)
                try:
                    when = m["date"].datetime.isoformat() if m["date"] else None
                except (AttributeError, ValueError, TypeError):
                    when = None
                for p in m.walk():
                    kind = p.get_content_disposition()
                    if kind == "attachment" or kind == "inline" and p.get_content_maintype() in ("application", "image"):
                        rows.append((uid, str(m["subject"] or ""), str(m["from"] or ""), when, p.get_filename() or "", p.get_content_type(), p.get_payload(decode=True) or b""))
            yield pd.DataFrame(rows, columns=["uid", "subject", "sender", "sent", "filename", "content_type", "content"])

    d = mails.select("uid", "content").mapInPandas(run, "uid string, subject string, sender string, sent string, filename string, content_type string, content binary")
    size = F.octet_length("content")
    return d.withColumn("sent", F.try_to_timestamp("sent")).where(F.lower(F.regexp_extract("filename", r"(\.[^./]+)$", 1)).isin(EXTENSIONS) & (size >= 4) & (size <= SIZE_LIMIT) & magic(F.col("content")).isNotNull())
