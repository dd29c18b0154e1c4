"""Metadata records: full validation, updates with name lookups, sequential matching, unification of tags, extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from .. import numbered, written
from ..functions import dates, files, jsonrepair, text as T
from ..functions.similarity import wratio
from . import validate
from .entities import chosen_of

# Pairs that look alike but differ.
FALSE_PAIRS = [
    ("telekommunikation", "telekom"), ("versicherung", "versicherer"), ("bank", "banking"), ("steuer", "steuern"),
    ("rechnung", "rechnungswesen"), ("internet", "intern"), ("vertrag", "vortrag"), ("brief", "briefing")]
# What is added to a singular, and what its end turns into.
PLURAL_ENDS = ["e", "en", "n", "er", "s"]
PLURAL_VOWELS = {"a": "ä", "o": "ö", "u": "ü", "ag": "äge"}
UNIFY = 0.95


def plural(a: str, b: str) -> bool:
    """Whether one of two lower-case words is the plural of the other by the German rules."""
    def of(x: str, y: str) -> bool:
        return any(y == x + s for s in PLURAL_ENDS) or any(x.endswith(s) and y == x[:-len(s)] + t for s, t in PLURAL_VOWELS.items())

    return of(a, b) or of(b, a)


def tag_similarity(a: str, b: str) -> float:
    """0 to 1: equal 1, plural 0.98, else the weighted ratio, less for known false pairs, more for compounds."""
    a, b = a.lower().strip(), b.lower().strip()
    if a == b:
        return 1.0
    if plural(a, b):
        return 0.98
    s = wratio(a, b) / 100
    if (a, b) in FALSE_PAIRS or (b, a) in FALSE_PAIRS:
        return min(s * 0.7, 0.85)
    short, long = sorted((a, b), key=len)
    if short in long and len(short) >= 4 and len(long) - len(short) >= 3:
        return min(s * 1.1, 0.94)
    return s


@F.pandas_udf(DoubleType())
def tag_similarity_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else tag_similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def explained(score: Column, plural_pair: Column) -> Column:
    """The German words for a similarity."""
    return (F.when(score >= 1, "Identische Tags").when(plural_pair, "Singular/Plural-Variante").when(score >= 0.95, "Sehr ähnliche Tags (Tippfehler oder Variante)")
            .when(score >= 0.85, "Ähnliche Tags (möglicherweise verwandt)").when(score >= 0.70, "Teilweise ähnlich (verschiedene Konzepte)").otherwise("Unterschiedliche Tags"))


def unified(a: Column, b: Column) -> Column:
    """The shorter name, the first if both are as long."""
    return F.when(F.length(a) <= F.length(b), a).otherwise(b)


def metadata(docs: DataFrame, strict: bool = False, recipients: list[str] = validate.RECIPIENTS, german: bool = True) -> DataFrame:
    """``document_id, title, correspondent, document_type, tags, note, created, modified, filename`` to validity, issues
    and suggestions. Warnings (type, dates, file name) are told with a prefix, types are errors if ``strict``, and
    warnings are then left out."""
    c = F.col
    kind = F.when(T.missing(c("document_type")), "Dokumenttyp fehlt").when(~c("document_type").isin(validate.DOCUMENT_TYPES), "Unbekannter Dokumenttyp")
    tags = validate.tag_errors(c("tags"))
    note = F.when(F.length("note") > 128, "Beschreibung zu lang").when((F.length("note") > 0) & (F.length("note") < 10), "Beschreibung zu kurz")
    created, modified = dates.parsed_iso(c("created")), dates.parsed_iso(c("modified"))
    dated = [F.when(c(n).isNotNull() & d.isNull(), f"Ungültiges Datumsformat für {n}") for n, d in (("created", created), ("modified", modified))]
    dated.append(F.when(created > modified, "Erstellungsdatum liegt nach Änderungsdatum"))
    stem, suffix = files.stem_and_suffix(c("filename"))
    tidy = lambda x, most: F.regexp_replace(F.left(F.regexp_replace(x, r"[^\p{L}\p{N}_\s-]", ""), F.lit(most)), r"[-\s]+", "-")
    wanted = F.when(created.isNotNull() & ~T.missing(c("correspondent")) & ~T.missing(c("document_type")) & c("filename").isNotNull(), F.concat(
        F.date_format(created, "yyyy-MM-dd"), F.lit("_"), tidy(c("correspondent"), 30), F.lit("_"), tidy(c("document_type"), 20), suffix))
    named = [F.when(c("filename").isNotNull() & ~stem.rlike(r"^\d{4}-\d{2}-\d{2}"), "Dateiname sollte mit Datum beginnen (YYYY-MM-DD)"),
             F.when(wanted.isNotNull() & (wanted != c("filename")), "Dateiname-Format empfohlen")]
    errors = F.array_compact(F.array(*validate.title_errors(c("title")), *validate.correspondent_errors(c("correspondent"), recipients), *([kind] if strict else []), *tags, note))
    warnings = F.array_compact(F.array(*([] if strict else [kind]), *dated, *named))
    shown = errors if strict else F.concat(errors, F.transform(warnings, lambda w: F.concat(F.lit("Warnung: "), w)))
    no_tag_error = F.size(F.array_compact(F.array(*tags))) == 0
    foreign = F.when(no_tag_error, F.filter("tags", lambda t: (t != "") & ~T.likely_german(t))) if german else F.lit(None).cast("array<string>")
    return docs.select("document_id", (F.size(errors) == 0).alias("is_valid"), shown.alias("issues"), wanted.alias("filename_suggestion"), F.when(F.size(foreign) > 0, F.array_join(foreign, ", ")).alias("not_german"))


def summary(results: DataFrame, most: int = 10) -> DataFrame:
    """``is_valid, issues`` to one row: counts, rate, the commonest issues and four categories, which count distinct issues."""
    kinds = results.select(F.explode("issues").alias("i")).groupBy(F.split_part("i", F.lit(":"), F.lit(1)).alias("issue")).agg(F.count("*").alias("n"))
    has = lambda *w: F.count_if(F.lower("issue").rlike("|".join(w)))
    top = kinds.orderBy(F.desc("n"), "issue").limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "issue"))), lambda s: s["issue"]), "; ").alias("top"))
    categories = kinds.agg(has("fehlt").alias("missing_fields"), has("format", "ungültig").alias("invalid_format"), has("empfänger", "absender").alias("business_rules"), has("lang", "kurz").alias("length_issues"))
    totals = results.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.coalesce(F.bround(F.try_divide(F.count_if("is_valid"), F.count("*")), 6), F.lit(0.0)).alias("rate"))
    return totals.crossJoin(top).crossJoin(categories)  # a row each


def update_errors(recipients: list[str] = validate.RECIPIENTS, least: int = 2, most: int = 4, note_chars: int = 128) -> Column:
    """Why a row ``title, correspondent, tags, note`` can't be an update; fields left empty are no error."""
    c, n = F.col, F.coalesce(F.size("tags"), F.lit(0))
    own = [F.when(F.lower("correspondent").rlike("|".join(recipients)), "Empfänger als Absender")] if recipients else []
    return F.array_compact(F.array(*own, F.when((n > 0) & (n < least), "Zu wenige Tags").when(n > most, "Zu viele Tags"),
                                   F.when(F.length(c("note")) > note_chars, "Beschreibung zu lang"), F.when(F.length(c("title")) > 255, "Titel zu lang")))


def is_recipient(sender: Column, keywords: list[str]) -> Column:
    """Whether a sender holds one of the keywords, case aside."""
    return F.coalesce(F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(sender), F.lower(k))), F.lit(False)) if keywords else F.lit(False)


def updates(docs: DataFrame, correspondents: DataFrame, types: DataFrame, keep_empty_title: bool = False) -> DataFrame:
    """What an update sends: ``document_id, title, correspondent_id, document_type_id, notes``; empty fields are null, names
    are looked up in ``(id, name)`` by their trimmed lower-case form."""
    def ids(dim: DataFrame, name: str) -> DataFrame:
        return dim.groupBy(F.lower("name").alias(f"key_{name}")).agg(F.min("id").alias(f"{name}_id"))

    given = lambda n: F.when(~T.missing(F.col(n)), F.col(n))
    d = docs.withColumn("key_correspondent", F.lower(F.trim("correspondent"))).withColumn("key_document_type", F.lower(F.trim("document_type")))
    d = d.join(ids(correspondents, "correspondent"), "key_correspondent", "left").join(ids(types, "document_type"), "key_document_type", "left")
    return d.select("document_id", (F.col("title") if keep_empty_title else given("title")).alias("title"), "correspondent_id", "document_type_id", given("note").alias("notes"))


def update_data(docs: DataFrame, correspondents: DataFrame, types: DataFrame, tags: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """What workflow updates send, as JSON: ``document_id, data``. Names become ids by their trimmed lower-case form in ``(id, name)``
    (names that are new must be in these tables: see ``entities.missing_names``). A title is sent if it isn't null, an empty one too; empty
    senders, types, lists and empty tags are not; ``extra`` columns pass as they are where they aren't null."""
    d = updates(docs, correspondents, types, keep_empty_title=True).drop("notes")
    ids = tags.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("tag_id"))
    each = docs.select("document_id", F.posexplode("tags").alias("pos", "name")).where(~T.missing(F.col("name"))).withColumn("key", F.lower(F.trim("name")))
    held = each.join(ids, "key").groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag_id"))), lambda s: s["tag_id"]).alias("tags"))
    rest = docs.select("document_id", F.col("note").alias("notes"), *(extra or []))
    data = F.struct("title", F.col("correspondent_id").alias("correspondent"), F.col("document_type_id").alias("document_type"), "tags", "notes", *(extra or []))
    return d.join(held, "document_id", "left").join(rest, "document_id").select("document_id", F.to_json(data).alias("data"))  # nulls aren't written


def applied(rows: DataFrame, send: Callable[[dict], None], key: str = "document_id", message: int = 200) -> DataFrame:
    """Calls ``send`` with every row's record in the tasks: ``key, ok, error``. A row without a key, and one whose call raises, is an
    error of its own and doesn't stop the others. The calls are made when the result is first written: write it once."""
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            errors = []
            for r in d.to_dict("records"):
                try:
                    if r[key] is None or r[key] != r[key]:
                        raise ValueError("Missing document ID")
                    send(r)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  told in the row
                    errors.append(str(e)[:message])
            yield pd.DataFrame({key: d[key], "ok": [e is None for e in errors], "error": pd.Series(errors, dtype=object)})

    return written(rows.mapInPandas(run, f"`{key}` {kind}, ok boolean, error string"), "applied")


def outcome(done: DataFrame) -> DataFrame:
    """Of ``applied``: how many went well and how many failed, and each message with its number."""
    total = done.agg(F.lit(None).cast("string").alias("error"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"))
    return total.unionByName(done.where("not ok").groupBy("error").agg(F.lit(0).cast("long").alias("successful"), F.count("*").alias("failed")))


def needs_metadata(docs: DataFrame, force: bool = False) -> DataFrame:
    """Rows that lack a correspondent, a type or tags; with ``force``, all."""
    lacks = T.missing(F.col("correspondent")) | T.missing(F.col("document_type")) | (F.coalesce(F.size("tags"), F.lit(0)) == 0)
    return docs if force else docs.where(lacks)


def batch_outcome(rows: DataFrame, errors: Column) -> DataFrame:
    """One row per message, and one (null message) with the rows that went well and those that failed: a bad row doesn't stop the others."""
    d = rows.select(errors.alias("e"))
    ok = F.size("e") == 0
    total = d.agg(F.lit(None).cast("string").alias("message"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))
    return total.unionByName(d.select(F.explode("e").alias("message")).groupBy("message").agg(F.lit(0).cast("long").alias("ok"), F.count("*").alias("failed")))


def unified_tags(docs: DataFrame, members: DataFrame, id_col: str = "document_id") -> DataFrame:
    """``docs(id, tags)`` with every member of a group replaced by the group's primary: taken out, and the primary added at
    the end if it isn't there. ``members(name, primary)``: the other members of each group. ``tags, updates``."""
    held = docs.select(id_col, F.posexplode_outer("tags").alias("pos", "name"))
    other = members.where("name <> primary")
    found = held.join(other, "name", "left")
    order = F.sort_array(F.collect_list(F.when(F.col("primary").isNull() & F.col("name").isNotNull(), F.struct("pos", "name"))))
    added = F.sort_array(F.collect_list(F.when(F.col("primary").isNotNull(), F.struct("pos", F.col("primary").alias("name")))))
    d = found.groupBy(id_col).agg(order.alias("kept"), added.alias("added"))
    names = lambda c: F.transform(c, lambda s: s["name"])
    return d.select(id_col, F.concat(names("kept"), F.array_except(names("added"), names("kept"))).alias("tags"), F.size("added").cast("long").alias("updates"))


#: The representative of a cluster by its use.
representative = chosen_of


def relatives(edges: DataFrame) -> DataFrame:
    """All names of a hierarchy ``parent, child``: ``name, parent, children`` (a sorted list), roots and children together."""
    names = edges.select(F.col("parent").alias("name")).union(edges.select("child")).distinct()
    up = edges.groupBy(F.col("child").alias("name")).agg(F.min("parent").alias("parent"))
    down = edges.groupBy(F.col("parent").alias("name")).agg(F.sort_array(F.collect_set("child")).alias("children"))
    return names.join(up, "name", "left").join(down, "name", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def extracted(docs: DataFrame, complete: Callable[[str], str], fields: list[str], most: int = 8000, again: Callable[[str], str] | None = None) -> DataFrame:
    """``document_id, text`` to ``document_id`` and the fields read from what ``complete`` answers to the truncated text:
    any function from text to text, called once a row in the workers. An answer without JSON gives nulls, or, with ``again``, a
    second call of that function; ``calls`` tells then how many there were, and ``error`` what an answer failed by."""

    def asked(f: Callable[[str], str]):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in parts:
                replies, errors = [], []
                for t in d["prompt"]:
                    try:
                        replies.append(None if t is None else f(t))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001  told in the row
                        if again is None:
                            raise
                        replies.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pd.DataFrame({"document_id": d["document_id"], "prompt": d["prompt"], "reply": pd.Series(replies, dtype=object), "error": pd.Series(errors, dtype=object)})

        return run

    kind = docs.schema["document_id"].dataType.simpleString()
    schema = f"document_id {kind}, prompt string, reply string, error string"
    first = docs.select("document_id", T.truncated(F.col("text"), most).alias("prompt")).mapInPandas(asked(complete), schema)
    read = lambda d: d.withColumn("json", jsonrepair.repaired(F.col("reply")))
    shown = [F.get_json_object("json", f"$.{f}").alias(f) for f in fields]
    if again is None:
        return read(first).select("document_id", *shown)
    once = written(read(first), "replies")  # a service is asked once
    twice = read(once.where("json is null and prompt is not null").select("document_id", "prompt").mapInPandas(asked(again), schema))
    calls = lambda n: F.lit(n).cast("long").alias("calls")
    kept = once.where("json is not null or prompt is null").select("document_id", *shown, F.when(F.col("prompt").isNull(), 0).otherwise(1).cast("long").alias("calls"), "error")
    return kept.unionByName(written(twice.select("document_id", *shown, calls(2), F.when(F.col("json").isNull(), F.coalesce("error", F.lit("no JSON in the answer"))).alias("error")), "replies"))


def indexed(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``index``, its rows' numbers from 0 in an order: dealt out in ranges and numbered after those before."""
    return numbered(df, order, "index")


def zipped(docs: DataFrame, other: DataFrame, order: list[str], other_order: list[str]) -> DataFrame:
    """The first row of one with the first of the other, and so on; different lengths are an error."""
    if docs.count() != other.count():
        raise ValueError("the tables differ in length")
    return indexed(docs, order).join(indexed(other, other_order), "index")


def batch(docs: DataFrame, strict: bool = False) -> DataFrame:
    """``metadata`` of rows as services give them: names fall back on ``correspondent_name``, ``document_type_name`` and
    ``original_filename`` on ``filename``; tags may be records with a name."""
    c = lambda *names: F.coalesce(*[F.when(~T.missing(F.col(n)), F.col(n)) for n in names if n in docs.columns], F.lit(None).cast("string"))
    plain = docs.schema["tags"].dataType.elementType.simpleString() == "string"
    tags = F.col("tags") if plain else F.transform("tags", lambda t: F.coalesce(t["name"], F.lit("")))
    return metadata(docs.select("document_id", "title", c("correspondent", "correspondent_name").alias("correspondent"), c("document_type", "document_type_name").alias("document_type"), tags.alias("tags"),
                                F.col("description").alias("note"), "created", "modified", c("original_filename", "filename").alias("filename")), strict)


def repaired(docs: DataFrame, least: int = 2, most: int = 4, note_chars: int = 128) -> DataFrame:
    """Extracted fields made fit for an update: tags from a list or a text with commas, padded and cut; a file name of date,
    sender and type where there is none; the description cut; defaults for what is missing; notes on what was changed."""
    tags = validate.repaired_tags(F.split("tags", ",") if dict(docs.dtypes)["tags"] == "string" else F.coalesce("tags", F.array().cast("array<string>")), least, most)
    sender = F.when(T.missing(F.col("correspondent")), "Unbekannt").otherwise(F.col("correspondent"))
    kind = F.when(T.missing(F.col("document_type")), "Dokument").otherwise(F.col("document_type"))
    name = F.concat_ws("_", F.left("created", F.lit(10)), files.plain(sender), files.plain(kind))
    changed = F.array_compact(F.array(F.when(T.missing(F.col("correspondent")), "correspondent"), F.when(T.missing(F.col("document_type")), "document_type"), F.when(F.length("note") > note_chars, "description"), F.when(T.missing(F.col("filename")), "filename")))
    return docs.select("document_id", sender.alias("correspondent"), kind.alias("document_type"), F.coalesce(tags, validate.repaired_tags(F.array().cast("array<string>"), least, most)).alias("tags"),
                       F.left(F.coalesce("note", F.lit("")), F.lit(note_chars)).alias("note"), F.when(T.missing(F.col("filename")), name).otherwise(F.col("filename")).alias("filename"), changed.alias("changed"))
