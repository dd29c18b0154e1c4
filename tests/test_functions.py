import datetime as dt

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from papyra.functions import dates, files, jsonrepair, similarity as S, text as T
from papyra.operators import entities, issues, validate
from papyra.sources import tables


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text("abcä ", max_size=12), st.text("abcä ", max_size=12))
def test_indel(a, b):
    assert S.lcs(a, b) == plain_lcs(a, b) == S.lcs(b, a)
    assert 0 <= S.indel(a, b) <= 100 and (S.indel(a, b) == 100) == (a == b)


def test_known_ratios():
    assert round(S.indel("rechnung", "rechnungen"), 1) == 88.9
    assert S.wratio("a b", "b a") == 95.0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("a, b, same", [("Rechnung", "rechnungen", True), ("Vertrag", "Verträge", True), ("Auto", "Autos", True), ("Bank", "Bänke", False)])
def test_plural(spark, a, b, same):
    assert one(spark, S.plural_pair(F.lit(a), F.lit(b))) is same


def test_ranges():
    ref = dt.date(2024, 1, 31)
    assert dates.quick_range("last_quarter", ref) == (dt.date(2023, 10, 1), dt.date(2023, 12, 31))
    assert dates.quick_range("last_month", ref) == (dt.date(2023, 12, 1), dt.date(2023, 12, 31))
    assert dates.between_months("2024-01", "2024-02") == (dt.date(2024, 1, 1), dt.date(2024, 2, 29))
    with pytest.raises(ValueError):
        dates.between_months("2024-03", "2024-02")


@pytest.mark.parametrize("name, found", [("x_2024-05-06.pdf", "2024-05-06"), ("2024_05_06", "2024-05-06"), ("a20240506b", "2024-05-06"), ("06.05.2024", "2024-05-06"), ("06-05-2024", "2024-05-06"), ("2024-02-31", "2024-02-31"), ("2024-13-01", None), ("none", None)])
def test_date_in_name(spark, name, found):
    assert one(spark, dates.date_in_name(F.lit(name))) == found


@pytest.mark.parametrize("reply, ok", [('{"a": 1}', True), ('x ```json\n{"a": 1}\n``` y', True), ('so {"a": {"b": {"c": 1}}} there', True), ('title: "T"\nnumber: 3', True), ("nothing", False), (None, False)])
def test_json_repair(spark, reply, ok):
    assert (one(spark, jsonrepair.repaired(F.lit(reply).cast("string"))) is not None) is ok


def test_files(spark):
    assert one(spark, files.sanitised_stem(F.lit("Über größe & Co.pdf"))) == "Ueber_groesse_und_Co.pdf"
    assert one(spark, files.correspondent(F.lit('"Example GmbH" <info@example.org>'))) == "Example GmbH"
    assert one(spark, files.correspondent(F.lit("info@example.org"))) == "info"
    assert one(spark, files.sender_tag(F.lit("A <x@acme.example>"))) == "Acme"
    assert one(spark, files.price_tag(F.lit("EUR 12.50"))) == "12,50€"
    assert one(spark, files.name_error(F.lit("con.txt"))) == "reserved name"


def test_issue_rules(spark):
    rows = [(1, "2024-01-02_a", "s", "t", ["a", "b", "c"], "2024", "der die das und oder aber " * 5, "n"), (2, None, None, None, [], None, None, "x" * 200), (3, "scan", "s", "t", ["a"], "x", "short", None)]
    d = spark.createDataFrame(rows, "document_id long, title string, correspondent string, document_type string, tags array<string>, created string, text string, note string")
    got = {r[0]: r[1] for r in d.select("document_id", issues.issue_types()).collect()}
    assert got[1] == [] and got[2] == ["ocr_missing", "missing_correspondent", "missing_document_type", "missing_tags", "invalid_date", "metadata_incomplete", "description_too_long"]
    assert got[3] == ["ocr_failed", "missing_tags", "filename_mismatch"]


def test_language(spark):
    assert one(spark, T.language(F.lit("der Hund und die Katze"))[0]) == "german"
    assert one(spark, T.language(F.lit("the dog and the cat"))[0]) == "english"
    assert one(spark, T.language(F.lit("123"))[0]) == "unknown"


def test_greedy_groups_follow_the_order(spark):
    d = spark.createDataFrame([(0, "rechnung"), (1, "rechnungen"), (2, "vertrag")], "pos long, name string")
    assert {tuple(r) for r in entities.greedy_groups(d).collect()} == {(0, 0, "rechnung"), (0, 1, "rechnungen"), (2, 2, "vertrag")}


def test_repaired_tags(spark):
    assert one(spark, validate.repaired_tags(F.array(F.lit(" a1 "), F.lit("x")))) == ["a1", "Tag2"]


def test_attachments(spark):
    from email.message import EmailMessage

    m = EmailMessage()
    m["From"], m["Subject"], m["Date"] = "A <a@b.example>", "Rechnung", "not a date"
    m.set_content("hi")
    m.add_attachment(b"%PDF-1.4 x", maintype="application", subtype="pdf", filename="r.pdf")
    m.add_attachment(b"nothing!", maintype="application", subtype="pdf", filename="fake.pdf")
    m.add_attachment(b"%PDF-1.4 x", maintype="application", subtype="octet-stream", filename="r.exe")
    got = tables.attachments(spark.createDataFrame([("1", bytearray(m.as_bytes()))], "uid string, content binary")).collect()
    assert [(r["filename"], r["sent"]) for r in got] == [("r.pdf", None)]


def test_page_type_beyond_the_first_characters(spark, tmp_path):
    from papyra.plans import catalogue

    spark.createDataFrame([(1, "https://x.example/a", "<p>" + "x " * 400 + "invoice</p>"), (2, "https://x.example/b", "<p>nothing</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["kind"] for r in catalogue.queries()["q49_doc_type_guess"](spark, f"file://{tmp_path}").collect()}
    assert got[1] is not None and got[2] is None
