"""Line dedup by site-relative frequency: a line that a large share of its site's pages hold is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._common import spread_join, temporary, written

#: A line is dropped if more than this share of its host's pages hold it ...
RATIO = 0.08
#: ... and the pages that hold it are at least so many.
MIN_PAGES = 5
#: Boilerplate lines (16 bytes each) up to this many are broadcast; more are joined by a shuffle, in which the pages of
#: a large host don't meet.
BROADCAST_LINES = 250_000
#: Hosts' page totals up to this many are broadcast; more are joined in the same way.
BROADCAST_HOSTS = 250_000
#: Most hosts whose lists of lines are broadcast in that shuffle.
LARGE_HOSTS = 1_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _norm(line: Column) -> Column:
    """Lines are equal when identical without outer spaces, tabs and carriage returns."""
    return F.btrim(line, F.lit(" \t\r"))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(_norm(line)))


def _host(host: Column) -> Column:
    """A host, or none, as a key that equals itself."""
    return F.struct(host.isNull().alias("none"), F.coalesce(host.cast("string"), F.lit("")).alias("name"))


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``host`` (none, name), ``line`` (a digest) of the lines to drop. Counts are per host and line, combined before the shuffle."""
    d = docs.select(_host(F.col(host_col)).alias("host"), F.col(text_col).cast("string").alias("text"))
    total = written(d.groupBy("host").agg(F.count("*").alias("total")), "hosts")
    held = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: _norm(x) != ""), _digest))
    pages = d.select("host", F.explode(held).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    if total.count() <= BROADCAST_HOSTS:
        of = pages.join(F.broadcast(total), "host")
    else:
        pages = written(pages, "lines")
        size = pages.groupBy("host").agg(F.count("*").alias("lines"))
        of = spread_join(pages, total.join(size, "host"), "host", "lines", pages.count(), F.struct(F.lit(True).alias("none"), F.hex("line").alias("name")))
    return of.where(F.col("pages") > F.col("total") * ratio).select("host", "line", "pages", "total")


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text`` without its boilerplate lines, and ``n_lines``, ``n_dropped`` added.

    Every page stays, also if nothing is left of it. Blank lines are neither counted nor dropped. A line
    repeated on a page counts as one page; every occurrence of it is dropped. Null hosts are a host; null
    texts stay null, with 0 lines. Repeated rows are pages of their own, and null ids change nothing: ids aren't
    read. A ratio that is just reached keeps the line. An empty table gives no rows. Extra columns stay, except that ``n_lines`` and ``n_dropped`` of the same name are replaced.
    """
    with temporary(docs.sparkSession) as kept:
        found = kept(written(boilerplate(docs, ratio, min_pages, host_col, text_col).select("host", "line", "total"), "boilerplate"))
    # a host has at most (its mean lines a page) / ratio of them, however many pages it has: a bounded list
    bad = found.groupBy("host").agg(F.collect_list("line").alias("__bad"), F.max("total").alias("__total")).withColumnRenamed("host", "__host")
    plain = docs.withColumn("__host", _host(F.col(host_col))).withColumn("__text", F.col(text_col).cast("string"))
    if found.count() <= BROADCAST_LINES:
        out = plain.join(F.broadcast(bad), "__host", "left")
    else:
        filler = F.struct(F.lit(True).alias("none"), F.monotonically_increasing_id().cast("string").alias("name"))
        out = spread_join(plain, bad, "__host", "__total", docs.count(), filler, LARGE_HOSTS)
    lines = _lines(F.col("__text"))
    keep = F.filter(F.col("__lines"), lambda x: (_norm(x) == "") | ~F.array_contains(F.col("__bad"), _digest(x)))
    out = out.withColumn("__lines", F.coalesce(lines, F.array().cast("array<string>"))).withColumn("__kept", F.when(F.col("__bad").isNull(), F.col("__lines")).otherwise(keep))
    text = F.when(F.col("__text").isNotNull(), F.array_join("__kept", "\n"))
    return out.withColumn(text_col, text).withColumn("n_lines", F.size("__lines")).withColumn("n_dropped", F.size("__lines") - F.size("__kept")).drop("__host", "__text", "__bad", "__total", "__lines", "__kept")
