"""Record operators, sinks and sources: queries without SQL against plain code on the whole result, and edge cases."""

import json
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from papyra.functions import dates, files, text as T
from papyra.functions.similarity import indel, wratio
from papyra import settings
from papyra.operators import calls, records, stats, validate
from papyra.plans import catalogue
from papyra.sources import mailbox, sinks, tables
from papyra.streaming import intake

DIR = "/root/testdata/sf0.001"


def run(spark, name):
    return [tuple(r) for r in catalogue.queries()[name](spark, DIR).collect()]


def tag_rows(spark):
    return sorted((r["pos"], r["name"], r["document_count"]) for r in catalogue.tags(spark, DIR).collect())


def groups_of(rows, least=85.0):
    left, out = list(rows), []
    while left:
        seed = left[0]
        out.append([seed, *(r for r in left[1:] if indel(seed[1].lower(), r[1].lower()) >= least)])
        left = [r for r in left if r not in out[-1]]
    return out


def test_tag_groups(spark):
    want = {(g[0][0], r[0], r[1]) for g in groups_of(tag_rows(spark)) for r in g}
    assert set(run(spark, "q32_tag_groups")) == want and any(a != b for a, b, _ in want)


def test_hierarchy(spark):
    want = set()
    for g in groups_of(tag_rows(spark)):
        top = min(g, key=lambda r: (-r[2], len(r[1]), r[0]))
        want |= {(top[1], r[1]) for r in g if r is not top}
    assert set(run(spark, "q33_hierarchy")) == want


def test_best_match(spark):
    tags = tag_rows(spark)
    got = {r[0]: r[1:] for r in run(spark, "q34_best_match")}
    names = {" ".join(w.capitalize() for w in n.split()) for _, n, _ in tags}
    assert got.keys() == names
    for n in names:
        score, _, best = max((wratio(n.lower(), t.lower()), -p, t) for p, t, _ in tags)
        assert got[n] == (best if score >= 95 else None, pytest.approx(score))


@pytest.mark.parametrize("a, b, score", [("Steuer", "steuern", 0.98), ("Bank", "banking", None), ("x", " X ", 1.0), ("Rechnung", "Rechnungen", 0.98), ("Versicherung", "Versicherungsschein", None), ("abc", "xyz", 0.0)])
def test_tag_similarity(a, b, score):
    got = records.tag_similarity(a, b)
    assert got == records.tag_similarity(b, a) and (score is None or got == score)
    if (a, b) == ("Bank", "banking"):
        assert got == pytest.approx(min(wratio("bank", "banking") / 100 * 0.7, 0.85))
    if a == "Versicherung":
        assert got == pytest.approx(min(wratio("versicherung", "versicherungsschein") / 100 * 1.1, 0.94))


def test_similarity_query(spark):
    rows = run(spark, "q68_tag_similarity")
    assert rows and all(s == pytest.approx(records.tag_similarity(a, b)) and u == (s >= 0.95) and x == (a if len(a) <= len(b) else b) for a, b, s, u, x, _ in rows)
    assert {w for *_, w in rows} >= {"Singular/Plural-Variante", "Unterschiedliche Tags"}


def test_sequential_match(spark):
    known = sorted(n for _, n, _ in tag_rows(spark))
    got = {}
    for key, *m in run(spark, "q69_sequential_match"):
        got.setdefault(key, []).append(tuple(m))
    for r in spark.read.parquet(f"{DIR}/part.parquet").collect():
        pool, want = list(known), []
        for t in (" ".join(w.capitalize() for w in r["p_name"].split()), r["p_brand"], r["p_brand"] + " ", r["p_type"]):
            best = max(range(len(pool)), key=lambda k: (wratio(t.lower().strip(), pool[k].lower().strip()), -k))
            score = wratio(t.lower().strip(), pool[best].lower().strip())
            want.append((t, pool[best] if score >= 95 else None, score))
            if score < 95:
                pool.append(t)
        assert sorted(got[r["p_partkey"]], key=str) == sorted(want, key=str)
    assert any(m and m.startswith("Brand") for ms in got.values() for _, m, _ in ms)  # an earlier proposal became a candidate


def shortened(name, most):
    stem, dot, ext = name.rpartition(".")
    ext = dot + ext.lower()
    for a, b in files.UMLAUTS.items():
        stem = stem.replace(a, b)
    import unicodedata

    base = re.sub("_{2,}", "_", re.sub(r"\s+", "_", re.sub(r"[^a-zA-Z0-9_\-\s]", "", unicodedata.normalize("NFKD", stem)))).strip("_-")
    room = most - len(ext)
    if len(base) <= room:
        return (base + ext).strip("_-.")
    parts, kept, left = re.split(r"[_\-\s]+", base), [], room
    if len(parts) > 1:
        is_date = lambda p: re.match(r"\d{4}.*\d{2}.*\d{2}", p)
        for p in filter(is_date, parts):
            if len(p) + 1 <= left:
                kept.append(p)
                left -= len(p) + 1
        for p in parts:
            if not is_date(p) and len(p) > 2:
                if len(p) + 1 <= left:
                    kept.append(p)
                    left -= len(p) + 1
                elif left > 5:
                    kept.append(p[:left - 1])
                    break
    out = ("_".join(kept) if kept else base[:room]) + ext
    return out.strip("_-.")


def test_short_names(spark):
    text = {r["doc_id"]: r["text"].split("\n")[0] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = dict(run(spark, "q76_short_name"))
    assert got == {i: shortened(t.split("\n")[0] + " 2024-05-06.PDF", 64) for i, t in text.items()}
    assert max(map(len, got.values())) <= 64


def test_mail_names_of_whole_first_lines(spark, tmp_path):
    lines = ["!" * 250 + "Rechnung", "a" + "?" * 400 + "bc d", "kurz", "x" * 300]
    spark.createDataFrame([(i, f"{t}\nmehr") for i, t in enumerate(lines)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, catalogue.queries()["q75_mail_name"](spark, str(tmp_path)).collect()))
    assert got == {i: f"info_acme_{t}_scan_pdfPDF.pdf" for i, t in enumerate(["Rechnung", "abc_d", "kurz", "x" * 80])}
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(duck.execute(catalogue.oracle_sql()["q75_mail_name"]).fetchall())


def against_sql(spark, path, name, texts):
    """The rows of a query over such documents and those of its SQL, in order, NaN told from null."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    told = lambda rows: sorted(tuple("NaN" if x != x else x for x in r) for r in rows)
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    return told(map(tuple, catalogue.queries()[name](spark, str(path)).select(*columns).collect())), told(want.fetchall())


# nothing, blanks, white space of Java only, what lower case makes two of, letters, capitals and digits of newer Unicode, and what is in no table
ODD_TEXTS = [None, "", " ", "\n\t\r ", "\x0c" * 3, "\x0b", "a\x0bb  c", " \xa0a\x85b\u2028", "bİbcdf İ", "ΑΣ ΟΔΟΣ", "a\u0870\U000323af b\U000323b0", "\u2c2f\U00010570A", "\U00011f501\U0001e4f9", "a\U0001f600\u0301!"]


def test_metrics_of_odd_texts_equal_sql(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "q02_text_metrics", ODD_TEXTS)
    assert got == want and got[0][1:] == (None,) * 7 and got[1][1:] == (0, 0, None) + ("NaN",) * 4


def test_validator_metrics_of_odd_texts_and_ties_equal_sql(spark, tmp_path):
    ties = ["!" * 203 + "a" * 197, "A" * 511 + "1" * 512 + "b" * 977, "1" * 29 + "a" * 1971]
    got, want = against_sql(spark, tmp_path, "q03_validator_metrics", ODD_TEXTS + ties)
    assert got == want and got[0][1:] == (None,) * 3 and got[1][1:] == got[2][1:] == ("NaN",) * 3
    assert got[len(ODD_TEXTS)] == (len(ODD_TEXTS), 0.507, 0.0, 0.0)


def plan_of(spark, name):
    return catalogue.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()


def test_counts_are_taken_once(spark):
    assert plan_of(spark, "q03_validator_metrics").count("regexp_extract_all(") == 3 and plan_of(spark, "q02_text_metrics").count("regexp_extract_all(") == 3
    d = spark.createDataFrame([(1, "Ab 1!"), (2, ""), (3, None)], "k int, t string")
    got = {r[0]: tuple(r)[2:] for r in T.measured(d, F.col("t"), "upper_ratio", "n_words").collect()}
    want = {r[0]: tuple(r)[1:] for r in d.select("k", *[T.metrics(F.col("t"))[n] for n in ("upper_ratio", "n_words")]).collect()}
    assert got == want and got[1] == (0.2, 2)


def test_short_names_are_computed_once(spark):
    assert len(plan_of(spark, "q76_short_name")) < 10_000
    names = ["Rechnung vom 2024-05-06 " + "wort " * 3000 + ".PDF", "a/b/" + "x" * 200, ".PDF", "", None, "2024-01-02 " * 12 + "ab abcd", "ÄÖ ß.Txt", "a" * 70 + " b.pdf", "___.pdf", "dir/", "ab cd ef" * 9]
    got = [r[1] for r in spark.createDataFrame(list(enumerate(names)), "k int, n string").select("k", files.shortened(F.col("n"), 64)).orderBy("k").collect()]
    assert got == ["Rechnung_vom_2024" + "_wort" * 8 + ".pdf", "ab" + "x" * 62, "PDF", "document.pdf", "document.pdf", "_".join(["2024"] * 12), "AeOe_ss.txt", "a" * 59 + ".pdf", "document.pdf", "dir", "_".join(["efab"] * 8)]


def test_types_of_like_length_only(spark):
    d = spark.createDataFrame([(n,) for n in ("rechnung", "rechnungen", "brief", "", "x", "zertifikat", "e-mail", "vertrag" * 9, "notizen")], "name string")
    want = {r["name"]: max(((indel(r["name"], k), [-ord(c) for c in k], k) for k in validate.DOCUMENT_TYPES)) for r in d.collect()}
    got = validate.suggest_type(d)
    assert {r[0]: r[1] for r in got.collect()} == {n: k if s >= 80 else None for n, (s, _, k) in want.items()}
    assert "aggregate(split" not in got._jdf.queryExecution().optimizedPlan().toString()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name, want", [("", "unnamed_file"), (None, "unnamed_file"), ("Über größe.PDF", "Ueber_groesse.pdf"), ("con.txt", "file_con.txt"), ("???.doc", "document.doc"), ("a" * 300 + ".pdf", "a" * 196 + ".pdf"), (".hidden", "hidden")])
def test_sanitised(spark, name, want):
    assert one(spark, files.sanitised(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize("name, want", [("ä" * 200 + ".pdf", "ä" * 125 + ".pdf"), ("...", "unnamed_file"), ("..a/b", "a_b"), ("", "unnamed_file"), ("x" * 300, "x" * 255)])
def test_posix(spark, name, want):
    assert one(spark, files.posix_name(F.lit(name))) == want


@pytest.mark.parametrize("name, want", [("nul.txt", "file_nul.txt"), ("a<b>:c", "a_b__c"), ("x. .", "x"), ("...", "unnamed_file"), ("y" * 250 + ".pdf", "y" * 196 + ".pdf")])
def test_windows(spark, name, want):
    assert one(spark, files.windows_name(F.lit(name))) == want


@pytest.mark.parametrize("path, stem, suffix", [("a/b.tar.gz", "b.tar", ".gz"), (".env", ".env", ""), ("x.", "x.", ""), ("a/b/", "b", ""), ("n", "n", "")])
def test_stem(spark, path, stem, suffix):
    s, x = files.stem_and_suffix(F.lit(path))
    assert (one(spark, s), one(spark, x)) == (stem, suffix)


def test_paths_and_mail_names(spark):
    assert one(spark, files.normalised_path(F.lit("a//b/./c/"))) == "a/b/c" and one(spark, files.normalised_path(F.lit("/"))) == "/"
    assert one(spark, files.mail_attachment_name(F.lit("info@acme.example"), F.lit("Ihre Rechnung!"), F.lit("Scan 1.PDF"))) == "info_acme_Ihre_Rechnung_Scan_1PDF.pdf"
    assert len(one(spark, files.mail_attachment_name(F.lit("info@acme.example"), F.lit("s" * 300), F.lit("a.pdf"), 60))) == 60


def test_dates(spark):
    import datetime as dt

    assert dates.quarter_range(2024, 4) == (dt.date(2024, 10, 1), dt.date(2024, 12, 31))
    with pytest.raises(ValueError):
        dates.quarter_range(2024, 5)
    assert one(spark, dates.parsed_iso(F.lit("2024-01-02T03:04:05Z"))) is not None and one(spark, dates.parsed_iso(F.lit("2024"))) is None


def test_likely_german(spark):
    assert [one(spark, T.likely_german(F.lit(x))) for x in ("Rechnung", "über", "invoice", "mit x", "mitx", "")] == [True, True, False, True, False, False]


def test_metadata_strict_and_warnings(spark):
    rows = [(1, "Titel", "Example GmbH", "Rechnung", ["aa", "bb", "cc"], None, "2024-01-05", "2024-01-01", "x.pdf"), (2, None, None, "foo", [], "short", None, None, None), (3, "Titel", "Acme AG", "Brief", ["Rechnung", "Mahnung", "Zeitung"], "a long enough note", "2024-01-05", "2024-02-01", "2024-01-05_Acme-AG_Brief.pdf")]
    d = spark.createDataFrame(rows, "document_id long, title string, correspondent string, document_type string, tags array<string>, note string, created string, modified string, filename string")
    got = {r["document_id"]: r for r in records.metadata(d, recipients=["acme"]).collect()}
    assert got[1]["is_valid"] and got[1]["issues"] == ["Warnung: Erstellungsdatum liegt nach Änderungsdatum", "Warnung: Dateiname sollte mit Datum beginnen (YYYY-MM-DD)", "Warnung: Dateiname-Format empfohlen"]
    assert got[1]["filename_suggestion"] == "2024-01-05_Example-GmbH_Rechnung.pdf" and got[1]["not_german"] == "aa, bb, cc"
    assert got[2]["issues"] == ["Titel fehlt", "Korrespondent fehlt", "Tags fehlen", "Beschreibung zu kurz", "Warnung: Unbekannter Dokumenttyp"]
    assert got[3]["issues"] == ["Empfänger als Absender"] and got[3]["not_german"] is None
    strict = {r["document_id"]: r["issues"] for r in records.metadata(d, strict=True).collect()}
    assert strict[1] == [] and "Unbekannter Dokumenttyp" in strict[2]


def test_unified_tags(spark):
    d = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b", "x"]), (3, []), (4, None), (5, ["c", "b", "a"])], "document_id long, tags array<string>")
    m = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a")], "name string, primary string")
    got = {r[0]: (r[1], r[2]) for r in records.unified_tags(d, m).collect()}
    assert got == {1: (["a"], 2), 2: (["x", "a"], 1), 3: ([], 0), 4: ([], 0), 5: (["a"], 2)}


def test_extraction(spark):
    d = spark.createDataFrame([(1, "T one"), (2, None), (3, "bad")], "document_id long, text string")
    got = {r[0]: r[1] for r in records.extracted(d, lambda t: "nothing" if t == "bad" else json.dumps({"title": t}), ["title"]).collect()}
    assert got == {1: "T one", 2: None, 3: None}


def test_csv_and_json(spark, tmp_path):
    d = spark.createDataFrame([(1, 'say "hi", you', ["a", "b"], True), (2, None, None, False)], "document_id long, title string, tags array<string>, has_ocr boolean").coalesce(1)
    sinks.write_csv(d, f"file://{tmp_path}/c")
    text = "".join(p.read_text() for p in sorted(Path(tmp_path, "c").glob("part-*")))
    assert text == '﻿Dokument-ID,Titel,Tags,OCR vorhanden\n1,"say ""hi"", you","a, b",Ja\n2,,,Nein\n'
    sinks.write_csv(d.where("false"), f"file://{tmp_path}/none")
    assert "".join(p.read_text() for p in sorted(Path(tmp_path, "none").glob("part-*"))) == ""
    sinks.write_json(d, f"file://{tmp_path}/j", "2024-01-01T00:00:00")
    assert spark.read.json(f"file://{tmp_path}/j/metadata").first()["record_count"] == 2 and spark.read.json(f"file://{tmp_path}/j/data").count() == 2
    with pytest.raises(ValueError):
        sinks.write_quality_report(d, str(tmp_path), "pdf")
    with pytest.raises(ValueError):
        sinks.write_statistics({"a": d}, str(tmp_path), "csv")
    sinks.write_statistics({"by_type": d}, f"file://{tmp_path}/s", "json", "now")
    assert spark.read.json(f"file://{tmp_path}/s/by_type/data").count() == 2
    found = spark.createDataFrame([(1, "x", "low", 3)], "document_id long, issue_type string, severity string, other int")
    sinks.write_quality_report(found, f"file://{tmp_path}/q", "csv")
    assert "Schweregrad" in "".join(p.read_text() for p in Path(tmp_path, "q").glob("part-*"))
    assert sinks.sidecar(spark.createDataFrame([("a.pdf", bytearray(b"x"), 1)], "filename string, content binary, size int")).first()[:] == ("a.pdf.json", '{"filename":"a.pdf","size":1}')


def test_ledger(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    assert sinks.load_ledger(spark, path).first()["cost"] == 0.0
    usage = spark.createDataFrame([("m", 1.5, 10), ("n", 2.0, 1)], "model string, cost double, tokens long")
    sinks.save_ledger(stats.ledger(usage, 3.0), path)
    got = {r["model"]: (r["cost"], r["tokens"], r["alert"]) for r in sinks.load_ledger(spark, path).collect()}
    assert got == {"m": (1.5, 10, False), "n": (2.0, 1, False), None: (3.5, 11, True)}


def test_staged_and_messages(spark, tmp_path):
    from email.message import EmailMessage

    for m, n in (("2024-01", "a.pdf"), ("2024-02", "b.pdf"), ("2024-02", "c.txt")):
        Path(tmp_path, m).mkdir(exist_ok=True)
        Path(tmp_path, m, n).write_bytes(b"%PDF")
    assert {(r["month"], r["filename"]) for r in tables.staged(spark, f"file://{tmp_path}").collect()} == {("2024-01", "a.pdf"), ("2024-02", "b.pdf")}
    m = EmailMessage()
    m["From"], m["Subject"] = "A <a@b.example>", "=?utf-8?q?Gr=C3=BC=C3=9Fe?="
    m.set_content("Guten Tag")
    r = tables.messages(spark.createDataFrame([("1", bytearray(m.as_bytes()))], "uid string, content binary"), "2024-05-06 00:00:00").first()
    assert (r["subject"], r["body"].strip(), str(r["sent"])) == ("Grüße", "Guten Tag", "2024-05-06 00:00:00")


def test_streams_read_one_path(spark, tmp_path):
    base = f"file://{tmp_path}"
    spark.createDataFrame([(1, ""), (2, "")], "doc_id long, text string").write.parquet(f"{base}/d.parquet")
    spark.createDataFrame([(9, "")], "doc_id long, text string").write.parquet(f"{base}/d.parquet.old")
    intake.run_available(intake.ocr_issues(spark, f"{base}/d.parquet"), f"{base}/out", f"{base}/log")
    assert {r["doc_id"] for r in spark.read.parquet(f"{base}/out").collect()} == {1, 2}
    with pytest.raises(ValueError):
        intake.poll(None, "", "", 5)
    # a second round reads only what is new
    spark.createDataFrame([(3, "")], "doc_id long, text string").write.mode("append").parquet(f"{base}/d.parquet")
    intake.poll(intake.ocr_issues(spark, f"{base}/d.parquet"), f"{base}/out", f"{base}/log", 60, 1)
    assert Counter(r["doc_id"] for r in spark.read.parquet(f"{base}/out").collect()) == {1: 1, 2: 1, 3: 1}


def test_mails_once_each(spark, tmp_path):
    base = f"file://{tmp_path}"
    kinds = "account string, uid string, sent timestamp"
    for part in (["1", "2"], ["2", "3"]):
        spark.createDataFrame([("a", u) for u in part], "account string, uid string").withColumn("sent", F.lit("2024-01-01").cast("timestamp")).write.mode("append").parquet(f"{base}/m")
    got = intake.once_each(spark.readStream.schema(kinds).parquet(f"{base}/m"))
    intake.run_available(got, f"{base}/out", f"{base}/log")
    assert sorted(r["uid"] for r in spark.read.parquet(f"{base}/out").collect()) == ["1", "2", "3"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "is_valid boolean, issues array<string>")
    assert records.summary(none).first()["total"] == 0
    assert stats.matching(spark.createDataFrame([], "parent string, child string")).first()["unified"] == 0
    assert records.unified_tags(spark.createDataFrame([], "document_id long, tags array<string>"), spark.createDataFrame([], "name string, primary string")).count() == 0


@pytest.mark.parametrize("chunk", [4096, 3])
def test_groups_in_rounds(spark, chunk):
    import random

    from papyra.operators import entities

    r = random.Random(5)
    base = ["".join(r.choice("abcd ") for _ in range(n)) for n in (1, 4, 9, 20, 70, 70)]
    names = sorted({b[:k] + r.choice("abxy") * j + b[k:] for b in base for k in range(0, len(b), 2) for j in (0, 1, 2)} | {base[3].upper()})
    r.shuffle(names)
    rows = [(k, n, 0) for k, n in enumerate(names)]
    d = spark.createDataFrame([(k, n) for k, n, _ in rows], "pos long, name string")
    got = {tuple(x) for x in entities.greedy_groups(d, chunk=chunk).collect()}
    assert got == {(g[0][0], x[0], x[1]) for g in groups_of(rows) for x in g}
    want = {(a, b) for a in {n.lower() for n in names} for b in {n.lower() for n in names} if a < b and indel(a, b) >= 85}
    assert {(x["a"], x["b"]) for x in entities.tag_pairs(d).collect()} == want


def test_numbers_of_new_names(spark):
    from papyra.operators import entities

    names = spark.createDataFrame([(f" N{i % 50}",) for i in range(200)] + [("old",)], "name string").repartition(6)
    got = sorted(tuple(r) for r in entities.missing_names(names, spark.createDataFrame([(7, "OLD")], "id long, name string")).collect())
    assert got == [(8 + k, n) for k, n in enumerate(sorted({f"N{i}" for i in range(50)}, key=str.lower))]


def test_best_match_in_blocks(spark):
    from papyra.operators import entities

    n = spark.createDataFrame([("Rechnung",), ("xyz",)], "name string")
    t = spark.createDataFrame([(1, "rechnung"), (0, "Rechnung "), (2, "x")], "pos long, name string")
    plain = sorted(map(tuple, entities.best_match(n, t).collect()))
    assert sorted(map(tuple, entities.best_match(n, t, block=1).collect())) == plain and plain[0][1] == "Rechnung "


def test_retries_and_fallback():
    waits, tries = [], []

    @calls.retrying(ValueError, tries=3, jitter=0.0, cap=1.5, sleep=waits.append)
    def f(x):
        tries.append(x)
        if len(tries) < 3:
            raise ValueError
        return x

    assert f(1) == 1 and waits == [1.0, 1.5] and len(tries) == 3
    with pytest.raises(KeyError):
        calls.retrying(KeyError, tries=2, sleep=waits.append)(lambda: {}["x"])()
    waits.clear()

    def busy(prompt):
        raise calls.Busy("later")

    def fine(prompt):
        return prompt.upper(), 3, 0.1

    own = [calls.Provider("b", 2, fine), calls.Provider("a", 1, busy), calls.Provider("c", 2, fine), calls.Provider("off", 0, fine, False)]
    assert [p.name for p in calls.ordered(own)] == ["a", "b", "c"]
    assert calls.completed("x", own, sleep=waits.append) == ("X", "b", 3, 0.1, None) and waits == [60.0, 60.0]
    assert calls.completed("x", [], sleep=waits.append)[4] == "no provider is enabled"
    assert calls.health(own) == {"a": False, "b": True, "c": True}
    told = []
    assert calls.with_progress([5, 6], lambda x: x + 1, lambda *a: told.append(a)) == [6, 7] and told == [(1, 2, 5), (2, 2, 6)]


def test_settings(tmp_path):
    p = tmp_path / ".env"
    p.write_text("# comment\nMIN_TAGS=3\nexport MAX_TAGS='7'\nBASE_URL=https://x.example\nnonsense\n")
    s = settings.load(str(p), {"API_TOKEN": "t", "MIN_TAGS": "1"})
    assert (s.min_tags, s.max_tags, s.base_url) == (1, 7, "https://x.example") and s.problems() == ([], [])
    assert "api_token is required" in settings.load(env={}).problems()[0]
    with pytest.raises(ValueError):
        settings.load(env={"MIN_TAGS": "x"})
    env = {"EMAIL_ACCOUNT_1_USERNAME": "u", "EMAIL_ACCOUNT_1_PORT": "143", "EMAIL_ACCOUNT_3_USERNAME": "w", "EMAIL_ACCOUNT_3_ENABLED": "false"}
    assert [(a["account"], a["port"], a["folder"]) for a in settings.accounts(env)] == [("account 1", 143, "INBOX")]


def test_mailbox(spark, tmp_path):
    import datetime as dt

    assert mailbox.search() == "ALL" and mailbox.search(True, dt.date(2024, 3, 5), 'a"b') == 'UNSEEN SINCE "05-Mar-2024" FROM "a\\"b"'
    assert mailbox.since(None, dt.datetime(2024, 1, 2)) == dt.datetime(2024, 1, 1) and mailbox.since(None, None) is None
    mails = spark.createDataFrame([("a", "1"), ("a", "2")], "account string, uid string")
    assert [r["uid"] for r in mailbox.unprocessed(mails, mails.where("uid = '1'")).collect()] == ["2"]
    files = spark.createDataFrame([("1", "d", "x.pdf", bytearray(b"one")), ("2", "d", "x.pdf", bytearray(b"two"))], "uid string, directory string, filename string, content binary")
    assert mailbox.write_files(mailbox.attachment_files(files), str(tmp_path)).agg(F.sum("bytes")).first()[0] == 6
    assert (tmp_path / "d/x.pdf").read_bytes() == b"one" and (tmp_path / "d/x_1.pdf").read_bytes() == b"two" and len(list((tmp_path / "d").iterdir())) == 2
    with pytest.raises(Exception):
        mailbox.write_files(spark.createDataFrame([("../x", bytearray(b"y"))], "path string, content binary"), str(tmp_path)).collect()
    with pytest.raises(ValueError):
        records.zipped(mails, mails.where("uid = '1'"), ["uid"], ["uid"])


def test_scan_and_its_end(spark, tmp_path):
    base = f"file://{tmp_path}"
    spark.createDataFrame([(1, ""), (2, "short"), (3, "der die das und oder " * 9)], "doc_id long, text string").write.parquet(f"{base}/d")
    found, end = intake.scan(spark, f"{base}/d", f"{base}/work")
    assert found.count() == 2 and {tuple(r) for r in end.collect()} == {("ocr_missing", 1), ("ocr_failed", 1)}
