"""Licence scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Texts and templates are sequences of five-word shingles. A template of ``WIDE`` shingles or more is looked for in
windows of ``WIDE`` that start every ``WIDE / 2`` shingles, a shorter one in windows of ``NARROW`` that start every
``NARROW / 2``, one of ``TINY`` or fewer in windows of its own size at every shingle. Of a template, all runs of a
window's length and of three quarters of it are kept (the whole, if it is shorter): a window that lies in an unedited
occurrence equals one, and of a shorter occurrence some window holds at least such a run, so that the two have a
similarity of 5 / 8 or more. An edited word takes five shingles: one within a window of ``WIDE`` leaves 27 of 37.

Each of ``SEEDS`` hash functions gives two bands of two rows: the two least values of a window's shingles, and the two
greatest, which are the least of the function turned round. At a similarity s both rows agree with a probability of
about s ** 2, and a window meets its run in some band with 1 - (1 - s ** 2) ** (2 * SEEDS): 0.997 at 5 / 8, 0.9998 at
27 / 37, and neighbouring windows add to it. A window of a tiny template can only be equal, so it has one band.
Candidates are then verified by the share of the template's distinct shingles that the text holds. DataFrame functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._common import salted_join, written

SHINGLE = 5
WIDE = 32
NARROW = 8
#: Of so many shingles, all must be held to reach the containment.
TINY = 4
SEEDS = 6
CONTAINMENT = 0.8
#: Shingles of a text that are held at once; windows begin in each of these parts and may reach into the next.
CHUNK = 4096
#: Candidate documents up to this many are broadcast as bare ids; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Band keys and shingles of all templates up to this many are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
# Fixed: notices of public licences (a parameter: any table license_id, text takes their place).
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


_FOUND = "doc_id long, license_id string, containment double, first_word long, last_word long"


def templates(spark: SparkSession, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(sorted(texts.items()), "license_id string, text string")


def _words(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def _shingle(words: Column, at: Column) -> Column:
    return F.xxhash64(F.slice(words, at, SHINGLE))


def _with_words(d: DataFrame, id_col: str) -> DataFrame:
    return d.where(F.size("words") >= SHINGLE).select(id_col, "words", (F.size("words") - SHINGLE + 1).alias("n"))


def _stride(window: int) -> int:
    return 1 if window <= TINY else window // 2


def _window_of(n: Column) -> Column:
    """The window that a template of so many shingles is looked for in."""
    return F.when(n <= TINY, n).when(n < WIDE, NARROW).otherwise(WIDE)


def _seeds(window: int) -> range:
    return range(1 if window <= TINY else SEEDS)


def _keys(windows: DataFrame, keys: list[str]) -> DataFrame:
    """``windows(keys, w, seed, size, hs, at)`` to a row for each band's ``key``.

    The window is the ``size`` shingles from ``at`` on, fewer at the end, whose values by each hash function are in ``hs``.
    """
    values = F.slice(F.get("hs", "seed"), F.col("at"), F.col("size"))
    held = windows.select(*keys, "w", "seed", F.when(F.col("w") <= TINY, values).otherwise(F.sort_array(values)).alias("s"))
    low = F.xxhash64("w", "seed", F.lit(0), F.get("s", F.lit(0)), F.get("s", F.lit(1)))
    high = F.xxhash64("w", "seed", F.lit(1), F.get("s", F.size("s") - 1), F.get("s", F.size("s") - 2))
    return held.select(*keys, F.explode(F.when(F.col("w") <= TINY, F.array(F.xxhash64("w", "s"))).otherwise(F.array(low, high))).alias("key"))


def _permuted(seed: int) -> Column:
    return F.transform("h", lambda x: F.xxhash64(x, F.lit(seed)))


def _hashes(d: DataFrame, keys: list[str], most: Column) -> DataFrame:
    """``keys, m, hs``: of the ``m`` shingles from ``from`` on, ``most`` at most, the values by each hash function."""
    upto = F.least(F.col("n") - F.col("from"), most)
    h = d.select(*keys, upto.alias("m"), F.transform(F.sequence(F.lit(1), upto), lambda i: _shingle(F.col("words"), F.col("from") + i)).alias("h"))
    return h.select(*keys, "m", F.array(F.col("h"), *map(_permuted, range(1, SEEDS))).alias("hs"))


def _text_windows(d: DataFrame, keys: list[str], windows: list[int]) -> DataFrame:
    """All windows of the texts ``d(keys, words, n)``: place, size and hash function are one number, so that a sequence holds them."""
    parts = d.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(CHUNK))).alias("from"))
    h = _hashes(parts, keys, F.lit(CHUNK + WIDE - 1))
    last = lambda w: F.least(F.lit(CHUNK), F.greatest(F.lit(1), F.col("m") - w + _stride(w)))
    one = lambda w, seed, at: at * 512 + (w * 8 + seed)
    of = F.concat(*[F.sequence(one(w, seed, F.lit(1)), one(w, seed, last(w)), F.lit(512 * _stride(w))) for w in windows for seed in _seeds(w)])
    each = h.select(*keys, "hs", F.explode(of).alias("code"))
    w = F.shiftright("code", 3).bitwiseAND(63)
    return each.select(*keys, "hs", w.alias("w"), F.col("code").bitwiseAND(7).alias("seed"), w.alias("size"), F.shiftright("code", 9).alias("at"))


def _template_runs(t: DataFrame) -> DataFrame:
    """All runs of the templates ``t(license_id, words, n)`` that a window may hold."""
    h = _hashes(t.withColumn("from", F.lit(0)), ["license_id", "n"], F.col("n")).withColumn("w", _window_of(F.col("n")))
    whole, part = F.least("w", "n"), F.ceil(F.col("w") * 3 / 4).cast("int")
    h = h.select("*", F.explode(F.when((F.col("w") > TINY) & (F.col("n") > part), F.array(whole, part)).otherwise(F.array(whole))).alias("size"))
    h = h.select("license_id", "hs", "w", "size", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)).alias("at"))
    return h.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("w") <= TINY, 0).otherwise(SEEDS - 1))).alias("seed"))


def _joined(rows: DataFrame, table: DataFrame, key: str, spread: Column, most: int) -> DataFrame:
    """``rows`` with the rows of a table that is broadcast up to ``most`` rows; a key of more meets its table's rows in several tasks."""
    if table.count() <= most:
        return rows.join(F.broadcast(table), key)
    return salted_join(rows, table.withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"), spread).drop("__key")


def scan(docs: DataFrame, notices: DataFrame, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template found: ``doc_id, license_id, containment, first_word, last_word``.

    ``notices(license_id, text)`` are the templates. Words are case-folded runs of letters and digits. Null, empty
    and texts of fewer than five words hold nothing, and a template of fewer than five words is never found. Repeated
    ids are one document, as are rows without an id, whose matches have a null id; an empty table gives no rows; other
    columns are ignored, whatever their names. Very long texts are worked on in parts, none is cut.
    """
    t = notices.select(F.col("license_id").cast("string").alias("license_id"), _words(F.col("text")).alias("words"))
    t = _with_words(t, "license_id")
    whole = t.select("license_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: _shingle(F.col("words"), i)))).alias("shingle"))
    whole = written(whole, "shingles")
    sizes = whole.groupBy("license_id").agg(F.count("*").alias("size"))
    asked = written(_keys(_template_runs(t), ["license_id"]).distinct(), "bands")
    windows = sorted(r[0] for r in t.select(_window_of(F.col("n")).cast("int")).distinct().collect())  # six at most
    if not windows:
        return docs.sparkSession.createDataFrame([], _FOUND)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def words(d: DataFrame) -> DataFrame:
        return _with_words(d.select("doc_id", _words(F.col("text")).alias("words")), "doc_id")

    met = _joined(_keys(_text_windows(words(texts), ["doc_id"], windows), ["doc_id"]), asked, "key", F.xxhash64("doc_id"), BROADCAST_KEYS).select("doc_id", "license_id").distinct()
    met = written(met, "met")
    ids = met.select(F.col("doc_id").alias("__id")).distinct()
    same = F.expr("doc_id <=> __id")
    some = texts.join(F.broadcast(ids), same, "left_semi") if met.count() <= BROADCAST_IDS else salted_join(texts, ids, same, F.xxhash64("text"), "left_semi")
    # exact: the distinct shingles of the template that the candidate's text holds
    close = words(some).select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: _shingle(F.col("words"), i))).alias("at", "shingle"))
    held = _joined(close, whole, "shingle", F.xxhash64("doc_id", "at"), BROADCAST_KEYS).groupBy("doc_id", "license_id").agg(
        F.count_distinct("shingle").alias("held"), (F.min("at") + 1).alias("first_word"), (F.max("at") + SHINGLE).alias("last_word"))
    found = held.join(met.select(F.col("doc_id").alias("__id"), F.col("license_id").alias("__license")), F.expr("doc_id <=> __id and license_id = __license"), "left_semi")
    return _joined(found, sizes, "license_id", F.xxhash64("doc_id"), BROADCAST_KEYS).withColumn("containment", F.col("held") / F.col("size")).where(
        F.col("containment") >= containment).select("doc_id", "license_id", "containment", F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"))
