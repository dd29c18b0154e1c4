"""File names, senders and document types of attachments."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .text import once

# Transliteration, types by keyword in order, free-mail domains, reserved names.
UMLAUTS = {"ä": "ae", "Ä": "Ae", "ö": "oe", "Ö": "Oe", "ü": "ue", "Ü": "Ue", "ß": "ss", "€": "EUR", "§": "par", "&": "und", "@": "at", "#": "nr", "%": "prozent", "+": "plus", "°": "grad"}
TYPES = {
    "Rechnung": ["rechnung", "invoice", "bill"], "Vertrag": ["vertrag", "contract", "agreement"], "Angebot": ["angebot", "quote", "quotation", "offer"],
    "Bestellung": ["bestellung", "order", "purchase"], "Lieferschein": ["lieferschein", "delivery"], "Mahnung": ["mahnung", "reminder", "dunning"],
    "Quittung": ["quittung", "receipt"], "Bescheinigung": ["bescheinigung", "certificate"], "Antrag": ["antrag", "application"],
    "Kündigung": ["kündigung", "cancellation", "termination"], "Bestätigung": ["bestätigung", "confirmation"], "Gutschrift": ["gutschrift", "credit"],
    "Lastschrift": ["lastschrift", "debit"], "Überweisung": ["überweisung", "transfer"], "Kontoauszug": ["kontoauszug", "statement"]}
INVOICE = ["rechnung", "invoice", "bill", "abrechnung", "faktura", "quittung", "zahlungsbeleg"]
RECEIPT = ["kassenbon", "kassenzettel", "beleg", "bon", "receipt", "kassenschein", "kassenbeleg"]
FREE_MAIL = ["gmail", "outlook", "yahoo", "gmx", "web", "mail", "email"]
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"{x}{i}" for x in ("COM", "LPT") for i in range(1, 10))]


def replace_umlauts(c: Column) -> Column:
    for a, b in UMLAUTS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def sanitised_stem(c: Column, most: int = 200) -> Column:
    """Transliterated, decomposed; only letters, digits, ``_ - .`` and spaces as ``_``, runs as one, ends trimmed."""
    c = F.regexp_replace(nfkd(replace_umlauts(c)), r"[^A-Za-z0-9_\-. ]", "")
    c = F.btrim(F.regexp_replace(F.regexp_replace(c, r"\s+", "_"), "_+", "_"), F.lit("_-"))
    return F.when(F.length(c) == 0, "document").otherwise(F.left(c, F.lit(most)))


def plain(c: Column, keep: str = "_-") -> Column:
    """Transliterated and decomposed; letters, digits, ``keep`` and white space as one ``_``, runs of it as one, ends trimmed."""
    c = F.regexp_replace(nfkd(replace_umlauts(c)), "[^a-zA-Z0-9" + keep.replace("-", "\\-") + r"\s]", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"\s+", "_"), "_{2,}", "_"), F.lit("_-"))


def base_name(path: Column) -> Column:
    """The last part of a path; separators at its end don't count."""
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)


def stem_and_suffix(path: Column) -> tuple[Column, Column]:
    """As of a path's last part: the suffix begins at its last dot, unless that is its first or last character."""
    name = base_name(path)
    cut = name.rlike(r"^.+\.[^.]+$") & ~name.rlike(r"^\.+[^.]*$")
    suffix = F.when(cut, F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise("")
    return F.left(name, F.length(name) - F.length(suffix)), suffix


def normalised_path(path: Column) -> Column:
    """Separators as one, without those at the end and without ``.`` parts."""
    c = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(?<=^|/)\\./", "")
    return F.when(c == "/", c).otherwise(F.regexp_replace(F.regexp_replace(c, "/\\.?$", ""), "^$", "."))


def sanitised(name: Column, most: int = 200, keep_suffix: bool = True) -> Column:
    """A file name safe to store: a plain stem, ``document`` if nothing is left, cut to ``most``, the suffix in lower case."""
    stem, suffix = stem_and_suffix(name) if keep_suffix else (name, F.lit(""))
    suffix = F.lower(suffix) if keep_suffix else suffix
    stem = F.when(suffix == "", plain(name)).otherwise(plain(stem))
    stem = F.when(stem == "", "document").otherwise(stem)
    whole = F.btrim(F.concat(F.left(stem, F.lit(most) - F.length(suffix)), suffix), F.lit("."))
    reserved = F.upper(F.split_part(whole, F.lit("."), F.lit(1))).isin(RESERVED)
    return F.when(name.isNull() | (name == ""), "unnamed_file").when(reserved, F.concat(F.lit("file_"), whole)).otherwise(whole)


def mail_attachment_name(sender: Column, subject: Column, name: Column, most: int | None = None) -> Column:
    """``sender_domain_subject_name.suffix``, the first parts cut to 50 and 80 characters."""
    parts = F.concat(F.split_part(sender, F.lit("@"), F.lit(1)), F.lit("_"), F.split_part(F.split_part(sender, F.lit("@"), F.lit(2)), F.lit("."), F.lit(1)))
    who = F.left(plain(F.when(sender.contains("@"), parts).otherwise(sender)), F.lit(50))
    suffix = F.lower(stem_and_suffix(name)[1])
    body = F.regexp_replace(F.concat_ws("_", who, F.left(plain(subject), F.lit(80)), sanitised(name, keep_suffix=False)), "_{2,}", "_")
    return F.concat(body, suffix) if most is None else F.when(F.length(body) + F.length(suffix) > most, F.concat(F.left(body, F.lit(most) - F.length(suffix)), suffix)).otherwise(F.concat(body, suffix))


def shortened(name: Column, most: int = 128) -> Column:
    """A name of at most ``most`` characters: parts like dates come first, then those longer than two characters in order,
    the last one cut if more than five characters are left for it."""
    date = r"^\d{4}.*\d{2}.*\d{2}"
    of = once(base_name(name), lambda n: F.struct(*[c.alias(k) for k, c in zip(("stem", "suffix"), stem_and_suffix(n))]))
    # each value that is used more than once is computed once: names of whole lines have thousands of parts
    given = F.struct(plain(once(of, lambda x: F.when(x["suffix"] == "", name).otherwise(x["stem"]))).alias("base"), F.lower(of["suffix"]).alias("suffix"))

    def kept(parts: Column, room: Column) -> Column:
        start = F.struct(room.alias("left"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("full"))

        def whole(acc: Column, p: Column) -> Column:
            return F.struct((acc["left"] - F.length(p) - 1).alias("left"), F.array_append(acc["kept"], p).alias("kept"), F.lit(False).alias("full"))

        def take_date(acc: Column, p: Column) -> Column:
            return F.when(F.length(p) + 1 <= acc["left"], whole(acc, p)).otherwise(acc)

        def take(acc: Column, p: Column) -> Column:
            cut = F.struct(acc["left"].alias("left"), F.array_append(acc["kept"], F.left(p, acc["left"] - 1)).alias("kept"), F.lit(True).alias("full"))
            return F.when(acc["full"], acc).when(F.length(p) + 1 <= acc["left"], whole(acc, p)).when(acc["left"] > 5, cut).otherwise(acc)

        dated = F.filter(parts, lambda p: p.rlike(date))
        other = F.filter(parts, lambda p: (F.length(p) > 2) & ~p.rlike(date))
        return F.aggregate(other, F.aggregate(dated, start, take_date), take)["kept"]

    def named(g: Column) -> Column:
        base, suffix = g["base"], g["suffix"]
        room = F.lit(most) - F.length(suffix)
        short = once(F.split(base, r"[_\-\s]+"), lambda parts: once(kept(parts, room), lambda k: F.when((F.size(parts) > 1) & (F.size(k) > 0), F.array_join(k, "_")).otherwise(F.left(base, room))))
        first = F.btrim(F.concat(F.when(F.length(base) <= room, base).otherwise(short), suffix), F.lit("_-."))
        filled = once(first, lambda x: F.when((x == "") | (x == suffix) | (F.concat(F.lit("."), x) == suffix), F.concat(F.lit("document"), suffix)).otherwise(x))
        return once(filled, lambda x: F.when(F.length(x) > most, F.concat(F.rtrim(F.left(x, room), F.lit("_-.")), suffix)).otherwise(x))

    return F.when(name.isNull() | (name == ""), "document.pdf").otherwise(once(given, named))


def windows_name(name: Column) -> Column:
    """Without reserved and control characters, names of devices with a prefix, 200 characters with the suffix."""
    c = F.rtrim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(". "))
    c = F.when(F.upper(F.split_part(c, F.lit("."), F.lit(1))).isin(RESERVED), F.concat(F.lit("file_"), c)).otherwise(c)
    ext = F.regexp_extract(c, r"\.([^.]*)$", 1)
    cut = F.when(c.contains("."), F.concat(F.left(F.left(c, F.length(c) - F.length(ext) - 1), F.greatest(F.lit(0), F.lit(199) - F.length(ext))), F.lit("."), ext)).otherwise(F.left(c, F.lit(200)))
    return F.when(c == "", "unnamed_file").when(F.length(c) > 200, cut).otherwise(c)


def posix_name(name: Column) -> Column:
    """Without NUL and separators and the dots in front; at most 255 bytes, characters of the stem go first."""
    c = F.replace(F.replace(name, F.lit("\0"), F.lit("")), F.lit("/"), F.lit("_"))
    c = F.when(c.rlike(r"^\.+$"), F.right(c, F.lit(1))).otherwise(F.ltrim(c, F.lit(".")))
    ext = F.regexp_extract(c, r"(\.[^.]*)$", 1)
    stem = F.left(c, F.length(c) - F.length(ext))
    # the longest beginning of the stem whose bytes fit
    room = F.greatest(F.lit(1), F.lit(255) - F.octet_length(ext))
    fits = F.aggregate(F.split(stem, ""), F.struct(F.lit(0).alias("n"), F.lit(0).alias("b"), F.lit(False).alias("end")), lambda a, x: F.when(
        a["end"] | (a["b"] + F.octet_length(x) > room), F.struct(a["n"].alias("n"), a["b"].alias("b"), F.lit(True).alias("end"))).otherwise(
        F.struct((a["n"] + 1).alias("n"), (a["b"] + F.octet_length(x)).alias("b"), F.lit(False).alias("end"))))["n"]
    return F.when((c == "") | (c == "."), "unnamed_file").when(F.octet_length(c) > 255, F.concat(F.left(stem, F.greatest(F.lit(1), fits)), ext)).otherwise(c)


def _holds(words: list[str], kind: Column, name: Column, subject: Column) -> Column:
    text = F.lower(F.concat_ws(" ", name, subject))
    return F.coalesce(F.lower(kind).rlike("|".join(words)), F.lit(False)) | text.rlike("|".join(words))


def is_invoice(kind: Column, name: Column, subject: Column) -> Column:
    return _holds(INVOICE, kind, name, subject)


def is_receipt(kind: Column, name: Column, subject: Column) -> Column:
    return _holds(RECEIPT, kind, name, subject)


def attachment_tags(kind: Column, name: Column, subject: Column, sender: Column, sent: Column, price: Column | None = None, most: int = 4) -> Column:
    """Type, price, year and sender: distinct, in this order, at most ``most``."""
    first = F.when(kind.isNotNull() & (kind != ""), F.when(is_invoice(kind, name, subject), "Rechnung").when(is_receipt(kind, name, subject), "Kassenbon").when(~kind.isin("Rechnung", "Kassenbon"), kind))
    own = F.array_compact(F.array(first, price_tag(price) if price is not None else F.lit(None).cast("string"), F.date_format(sent, "yyyy")))
    own = F.when(F.size(own) < most, F.array_compact(F.array_append(own, sender_tag(sender)))).otherwise(own)
    return F.slice(F.array_distinct(own), 1, most)


def description(kind: Column, sender: Column, sent: Column, subject: Column) -> Column:
    """Type, sender and date, and as much of the subject as 100 characters leave; 128 at most."""
    head = F.concat_ws(" ", F.when(kind != "", kind), F.concat(F.lit("von "), correspondent(sender)), F.date_format(sent, "dd.MM.yyyy"))
    more = (F.length(head) < 100) & subject.isNotNull() & (subject != "")
    return F.left(F.when(more, F.concat(head, F.lit(" - "), F.left(subject, F.lit(100) - F.length(head)))).otherwise(head), F.lit(128))


def target_directory(base: str, sender: Column, sent: Column, by_date: bool = False, by_sender: bool = False) -> Column:
    """The base folder, then year and month, then the sender, where asked for."""
    parts = [F.lit(base)] + ([F.date_format(sent, "yyyy"), F.date_format(sent, "MM-MMMM")] if by_date else []) + ([sanitised(correspondent(sender), keep_suffix=False)] if by_sender else [])
    return F.concat_ws("/", *parts)


def numbered(name: Column, turn: Column) -> Column:
    """The name of the ``turn``-th file of a name, from 0: the first keeps it, later ones get a counter before the suffix."""
    stem, suffix = stem_and_suffix(name)
    return F.when(turn == 0, name).otherwise(F.concat(stem, F.lit("_"), turn.cast("string"), suffix))


def name_error(c: Column) -> Column:
    """The first rule that a file name breaks, null if none."""
    out = F.when(c.isNull() | (c == ""), "empty").when(F.length(c) > 255, "too long").when(c.contains("..") | c.contains("/") | c.contains("\\"), "path").when(c.contains("\0"), "null byte")
    return out.when(c.rlike(r'[<>:"|?*]'), "reserved character").when(F.upper(F.split_part(c, F.lit("."), F.lit(1))).isin(RESERVED), "reserved name")


def document_type(name: Column, subject: Column) -> Column:
    text, out = F.lower(F.concat_ws(" ", name, subject)), None
    for kind, keys in TYPES.items():
        hit = text.rlike("|".join(keys))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.when(F.lower(name).rlike(r"\.(jpg|jpeg|png|tiff)$"), "Scan")


def correspondent(sender: Column) -> Column:
    """The display name, else the local part."""
    bare = F.when(sender.contains("<") & sender.contains(">"), F.regexp_extract(sender, "<([^>]*)>", 1)).otherwise(sender)
    name = F.when(sender.contains("<"), F.btrim(F.split_part(sender, F.lit("<"), F.lit(1)), F.lit(" \"'")))
    return F.when(name != "", name).otherwise(F.split_part(bare, F.lit("@"), F.lit(1)))


def sender_tag(sender: Column) -> Column:
    label = F.split_part(F.split_part(F.split_part(sender, F.lit("@"), F.lit(2)), F.lit(">"), F.lit(1)), F.lit("."), F.lit(1))
    name = F.trim(F.split_part(sender, F.lit("<"), F.lit(1)))
    capital = F.concat(F.upper(F.left(label, F.lit(1))), F.lower(F.substring(label, 2, 1000)))
    return F.when(sender.contains("@") & (label != "") & ~label.isin(FREE_MAIL), capital).when(
        sender.contains("<") & (name != "") & (F.length(name) < 20), F.split_part(name, F.lit(" "), F.lit(1)))


def price_tag(price: Column) -> Column:
    n = F.regexp_extract(price, r"\d+[,.]?\d*", 0)
    return F.when(n != "", F.concat(F.replace(n, F.lit("."), F.lit(",")), F.lit("€")))
