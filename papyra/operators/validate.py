"""OCR and metadata validation, and the repair of extracted metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.similarity import indel_ratio, like_length

# Known document types.
DOCUMENT_TYPES = ["Rechnung", "Quittung", "Vertrag", "Angebot", "Bestellung", "Lieferschein", "Mahnung", "Gutschrift", "Stornierung", "Kontoauszug", "Bescheinigung", "Bestätigung", "Mitteilung", "Schreiben", "Brief", "E-Mail", "Notiz", "Protokoll", "Bericht", "Antrag", "Formular", "Bescheid", "Urkunde", "Zeugnis", "Zertifikat", "Nachweis", "Versicherung", "Kündigung", "Widerspruch", "Einspruch", "Stellungnahme"]
PLACEHOLDER = r"^(untitled|document\d*$|scan\d*$|img_?\d*$|[0-9]+$)"
#: Names of the own household or firm, which can't be a sender: configuration, empty by default.
RECIPIENTS: list[str] = []


def _held(d: DataFrame) -> DataFrame:
    """A row's values as they are, for the optimizer not to compute them again in each place where they are used."""
    return d.select(F.explode(F.array(F.struct(*d.columns))).alias("r")).select("r.*")


def ocr(docs: DataFrame, least: int = 50, confident: float = 0.7) -> DataFrame:
    """``document_id, text, confidence`` to validity, errors (without their figures), language and score."""
    d = docs.withColumn("t", F.coalesce(F.trim("text", F.lit(" \n\t\r")), F.lit("")))
    # counts and language are structs that are computed once; what is made of them is cheap
    d = d.select("document_id", "confidence", T.missing(F.col("text")).alias("none"), T.language_struct(F.col("t")).alias("l"), F.size(T.defects(F.col("t"))).alias("defects"), T.counts(F.col("t")).alias("c"))
    share = lambda k, of="c.chars", places=3: T.rounded(T.ratio(F.col(f"c.{k}"), F.col(of)), places)
    d = _held(d).select("document_id", "confidence", "none", "defects", F.col("l.name").alias("language"), F.col("l.confidence").alias("language_confidence"), F.col("c.chars").alias("chars"), F.col("c.n_words").alias("n_words"),
                        share("letters", "c.n_words", 2).alias("mean_word"), share("special").alias("special_ratio"), share("upper").alias("upper_ratio"), share("digit").alias("digit_ratio"))
    errors = F.when(F.col("none"), F.array(F.lit("Kein OCR-Text vorhanden"))).otherwise(F.array_compact(F.array(
        F.when(F.col("chars") < least, "OCR-Text zu kurz"), F.when(F.col("confidence") < confident, "OCR-Konfidenz zu niedrig"), F.when(F.col("defects") > 0, "Mögliche OCR-Fehler erkannt"),
        F.when(F.col("language") == "unknown", "Sprache konnte nicht erkannt werden"), F.when((F.col("language") == "english") & (F.col("language_confidence") > 0.7), "Text ist möglicherweise nicht auf Deutsch"))))
    d = d.withColumn("errors", errors)
    off = lambda c, by: F.when(c, F.lit(by)).otherwise(F.lit(0.0))
    score = F.lit(1.0) - F.size("errors") * 0.15 - off(F.col("special_ratio") > 0.2, 0.1) - off(F.col("upper_ratio") > 0.5, 0.1) - off(F.col("digit_ratio") > 0.3, 0.1) - off((F.col("mean_word") < 3) | (F.col("mean_word") > 15), 0.1)
    score = score - off(F.col("n_words") < 10, 0.2) + off(F.coalesce(F.col("confidence") > 0.9, F.lit(False)), 0.1) + off(F.col("language") == "german", 0.1)
    d = d.withColumn("score", F.when(F.col("none"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))))
    return d.select("document_id", ((F.size("errors") == 0) | (F.col("score") >= 0.5) & (F.col("chars") >= least)).alias("is_valid"), "errors", "language", "score")


def ocr_summary(results: DataFrame) -> DataFrame:
    bands = {"excellent": (0.9, 2), "good": (0.7, 0.9), "fair": (0.5, 0.7), "poor": (-1, 0.5)}
    return results.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.bround(F.try_divide(F.count_if("is_valid"), F.count("*")), 3).alias("rate"), F.bround(F.avg("score"), 3).alias("mean_score"),
                       *[F.count_if((F.col("score") >= a) & (F.col("score") < b)).alias(k) for k, (a, b) in bands.items()])


def languages(results: DataFrame) -> DataFrame:
    """How many texts there are of each language."""
    return results.groupBy("language").agg(F.count("*").alias("n"))


def error_histogram(results: DataFrame) -> DataFrame:
    return results.select(F.explode("errors").alias("e")).groupBy(F.split_part("e", F.lit(":"), F.lit(1)).alias("error")).agg(F.count("*").alias("n"))


def title_errors(c: Column) -> list[Column]:
    return [F.when(T.missing(c), "Titel fehlt"), F.when(~T.missing(c) & (F.length(c) < 3), "Titel zu kurz"), F.when(F.length(c) > 255, "Titel zu lang"), F.when(F.lower(c).rlike(PLACEHOLDER), "Titel scheint ein Platzhalter zu sein")]


def correspondent_errors(c: Column, recipients: list[str] = RECIPIENTS) -> list[Column]:
    own = [F.when(F.exists(F.array(*map(F.lit, recipients)), lambda k: F.contains(F.lower(c), k)), "Empfänger als Absender")] if recipients else []
    return [F.when(T.missing(c), "Korrespondent fehlt"), *own, F.when(c.rlike(r'[<>{}\[\]\\]'), "Ungültige Zeichen im Korrespondenten"), F.when(~T.missing(c) & (F.length(c) < 2), "Korrespondent zu kurz")]


def tag_errors(tags: Column, least: int = 3, most: int = 7) -> list[Column]:
    n, low = F.coalesce(F.size(tags), F.lit(0)), F.transform(tags, F.lower)
    bad = F.exists(tags, lambda t: (F.length(t) < 2) | (F.length(t) > 50) | t.rlike("^[0-9]+$"))
    return [F.when(n < 1, "Tags fehlen"), F.when((n > 0) & (n < least), "Zu wenige Tags"), F.when(n > most, "Zu viele Tags"), F.when((n > 0) & bad, "Ungültige Tags gefunden"), F.when((n > 0) & (F.size(F.array_distinct(low)) != F.size(low)), "Doppelte Tags gefunden")]


def metadata(docs: DataFrame) -> DataFrame:
    """``document_id, title, correspondent, document_type, tags, note`` to errors."""
    note, kind = F.col("note"), F.col("document_type")
    errors = F.array_compact(F.array(*title_errors(F.col("title")), *correspondent_errors(F.col("correspondent")), F.when(T.missing(kind), "Dokumenttyp fehlt").when(~kind.isin(DOCUMENT_TYPES), "Unbekannter Dokumenttyp"), *tag_errors(F.col("tags")),
                                     F.when(F.length(note) < 10, "Beschreibung zu kurz").when(F.length(note) > 128, "Beschreibung zu lang")))
    return docs.select("document_id", errors.alias("errors")).withColumn("is_valid", F.size("errors") == 0)


def repaired_tags(tags: Column, least: int = 2, most: int = 4) -> Column:
    """Trimmed, longer than one character, distinct, padded with TagN, cut."""
    t = F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda x: F.length(x) > 1))
    pad = F.transform(F.filter(F.sequence(F.lit(1), F.lit(least)), lambda i: i > F.size(t)), lambda i: F.concat(F.lit("Tag"), i.cast("string")))
    return F.slice(F.concat(t, pad), 1, most)


def suggest_type(names: DataFrame, least: float = 80.0) -> DataFrame:
    """``name`` to the nearest of the 31 known types, ties to the first by name: a fixed list, so no join grows. Only types whose length allows
    the ratio are compared."""
    known = names.sparkSession.createDataFrame([(t,) for t in DOCUMENT_TYPES], "kind string")
    pairs = names.join(F.broadcast(known), like_length(F.col("name"), F.col("kind"), least), "left").withColumn("score", indel_ratio(F.col("name"), F.col("kind")))
    best = pairs.groupBy("name").agg(F.max("score").alias("score"), F.max_by("kind", F.struct("score", F.transform(F.split("kind", ""), lambda c: -F.ascii(c)))).alias("kind"))
    return best.select("name", F.when(F.col("score") >= least, F.col("kind")).alias("suggestion"))
