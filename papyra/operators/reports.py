"""Reports as tables of sections: the quality report, corpus statistics, and what a service's limit lets through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import written
from . import issues

SECTION = "section string, ord long, key string, value string"
# German labels of the sections, and of the lines of the first.
TITLES = {"summary": "Zusammenfassung", "by_type": "Probleme nach Typ", "recommendations": "Empfehlungen", "top_documents": "Am stärksten betroffene Dokumente"}
LABELS = ["Gesamtzahl der Probleme", "Betroffene Dokumente", "Kritische Probleme", "Hohe Priorität", "Mittlere Priorität", "Niedrige Priorität"]
#: How many of each kind a statistics report shows.
MOST = {"correspondent": 20, "type": 15, "tag": 10}


def _ranked(rows: DataFrame, section: str, order: list[Column], key: str, value: str, most: int | None = None) -> DataFrame:
    """The first rows of a table that has few (types of issues) or is cut to few, numbered from 1."""
    top = rows.orderBy(*order) if most is None else rows.orderBy(*order).limit(most)
    place = F.row_number().over(Window.orderBy(*order)).cast("long")  # over the rows of a section
    return top.select(F.lit(section).alias("section"), place.alias("ord"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))


def sections(found: DataFrame, most: int = 10) -> DataFrame:
    """The issues ``document_id, issue_type, severity, times`` as ``section, ord, key, value``: a summary, the types by number, what is
    recommended, and the documents with most issues. Issues are read once, and counted by document and type before that."""
    counted = written(found.groupBy("document_id", "issue_type", "severity").agg(F.sum("times").alias("times")), "counted")
    of = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("times"))), F.lit(0)).cast("string")
    totals = [F.coalesce(F.sum("times"), F.lit(0)).cast("string"), F.count_distinct("document_id").cast("string"), *[of(s) for s in ("critical", "high", "medium", "low")]]
    lines = F.array(*[F.struct(F.lit(k + 1).cast("long").alias("ord"), F.lit(n).alias("key"), c.alias("value")) for k, (n, c) in enumerate(zip(LABELS, totals))])
    summary = counted.agg(lines.alias("l")).select(F.explode("l").alias("l"))
    types = counted.groupBy("issue_type").agg(F.sum("times").alias("issues"))
    named = lambda k: F.lit(TITLES[k])
    return summary.select(named("summary").alias("section"), "l.ord", "l.key", "l.value").unionByName(
        _ranked(types, TITLES["by_type"], [F.desc("issues"), F.col("issue_type")], "issue_type", "issues")).unionByName(
        _ranked(issues.recommendations(counted), TITLES["recommendations"], [F.desc("issues"), F.col("issue_type")], "issue_type", "issues")).unionByName(
        _ranked(issues.top_documents(counted, most), TITLES["top_documents"], [F.desc("issues"), F.col("document_id")], "document_id", "issues"))


def corpus(docs: DataFrame) -> DataFrame:
    """``correspondent, document_type, created, tags, text`` to ``section, key, documents, with_ocr``: by correspondent, type, month and tag,
    and over all (null key), in one pass. Missing senders and types are ``Unassigned``, documents without a date have no month,
    a tag counts once for each time a document has it."""
    one = lambda s, k: F.struct(F.lit(s).alias("section"), k.cast("string").alias("key"))
    owner = lambda c: F.coalesce(c, F.lit("Unassigned"))
    month = F.when(F.length("created") >= 7, F.left("created", F.lit(7)))
    fixed = F.array(one("overview", F.lit(None)), one("correspondent", owner(F.col("correspondent"))), one("type", owner(F.col("document_type"))), one("month", month))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: one("tag", t))
    each = docs.select(F.explode(F.concat(fixed, tags)).alias("s"), F.coalesce(F.length("text") > 0, F.lit(False)).alias("ocr"))
    return each.where("s.section = 'overview' or s.key is not null").groupBy("s.section", "s.key").agg(F.count("*").alias("documents"), F.count_if("ocr").alias("with_ocr"))


def statistics(docs: DataFrame, most: dict[str, int] = MOST) -> DataFrame:
    """What a statistics report shows of ``corpus``: totals, all months, the commonest senders, types and tags: ``section, ord, key, documents``."""
    c = written(corpus(docs), "corpus")
    parts = [c.where("section in ('overview', 'month')").select("section", F.lit(None).cast("long").alias("ord"), "key", "documents")]
    for s, n in most.items():
        order = [F.desc("documents"), F.col("key")]
        top = c.where(F.col("section") == s).orderBy(*order).limit(n)
        parts.append(top.select("section", F.row_number().over(Window.orderBy(*order)).cast("long").alias("ord"), "key", "documents"))  # over the rows shown
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def limited(requests: DataFrame, key: str, at: str, most: int, window: float, order: list[str]) -> DataFrame:
    """When a limiter lets requests begin that come at ``at`` (seconds): at most ``most`` in any ``window`` seconds of a key, in the order
    of their coming (ties by ``order``). ``place`` (from 0), ``start``, ``waited``.

    The i-th may begin when it has come and a window after the (i - most)-th has begun; along every most-th request, that is a
    running maximum of ``at`` less a window for each before.
    """
    if most < 1:
        raise ValueError("a limit is 1 or more")
    placed = requests.withColumn("place", (F.row_number().over(Window.partitionBy(key).orderBy(at, *order)) - 1).cast("long"))
    turns = F.floor(F.col("place") / most)
    chain = Window.partitionBy(key, F.pmod("place", F.lit(most))).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    start = turns * F.lit(float(window)) + F.max(F.col(at) - turns * F.lit(float(window))).over(chain)
    return placed.withColumn("start", start).withColumn("waited", F.col("start") - F.col(at))


def spaced(requests: DataFrame, key: str, at: str, spacing: float, order: list[str]) -> DataFrame:
    """The same for a limiter that keeps a fixed time between two requests of a key: a window with one request in it."""
    return limited(requests, key, at, 1, spacing, order)


def suggested(results: DataFrame, fields: list[str]) -> DataFrame:
    """``field, rows``: how many results have a suggestion for each field."""
    one = results.agg(*[F.count(F.col(f)).alias(f) for f in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("rows")) for f in fields])).alias("s")).select("s.field", "s.rows")


def enriched(docs: DataFrame, texts: DataFrame, first: str, last: str) -> DataFrame:
    """Documents created from one day to another with the text that ``texts(document_id, ocr)`` has for them; a document for which
    there is none, or whose fetch failed (a null text), stays as it is: ``fetched`` tells. Of several texts of an id the greatest."""
    day = F.to_date("created")
    kept = docs.where((day >= F.lit(first).cast("date")) & (day <= F.lit(last).cast("date")))
    one = texts.groupBy("document_id").agg(F.max("ocr").alias("ocr"))
    return kept.join(one, "document_id", "left").withColumn("fetched", F.col("ocr").isNotNull())
