"""The duplicate pass against plain code."""

import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.functions.similarity import indel, lcs
from papyra.operators import duplicates
from papyra.plans import catalogue

DIR = "/root/testdata/sf0.001"


def plain(rows):
    text = lambda v: "none" if v is None else str(v).lower()
    return {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1:] if sum(indel(text(x), text(y)) for x, y in zip(a[1:], b[1:])) >= 270 - 1e-9}


def expanded(rows):
    of = {}
    for r in rows:
        if r["document_id"] is not None:
            of.setdefault(r["id1"], []).append(r["document_id"])
    return {(x, y) if x < y else (y, x) for r in rows if r["document_id"] is None for x in of[r["id1"]] for y in of[r["id2"]] if x != y}, sum(map(len, of.values()))


@pytest.mark.parametrize("least", [70.0, 81.0, 90.0, 95.0, 100.0])
def test_title_links(least):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdeß 日"), n)) for n in (0, 1, 3, 20, 63, 64, 65, 90, 150)]
    texts = []
    for t in base:
        for k in (0, 0, 1, 2, 6, 12):
            u = list(t)
            for _ in range(k):
                u.insert(int(rng.integers(0, len(u) + 1)), "x") if rng.random() < 0.5 or not u else u.pop(int(rng.integers(0, len(u))))
            texts.append("".join(u))
    for own in (True, False):
        p, q, s = duplicates.title_links(texts, texts, least, own)
        want = {(i, j): indel(a, b) for i, a in enumerate(texts) for j, b in enumerate(texts) if (i < j or not own) and indel(a, b) >= least - 1e-9}
        assert dict(zip(zip(p.tolist(), q.tolist()), s.tolist())) == want and len(p) == len(want)


def test_letters_leave_out_pairs_and_lose_none():
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("eeeennnniiissrratdhulcgmobwfkzvp     "), 60)) for _ in range(300)] + ["", "日" * 60, "x" * 90]
    flat, n = duplicates._points(texts)
    first, halves = duplicates._levels(flat, n, flat, n)
    one, two = (np.bitwise_count(x[:, None] & y[None, :]) + np.minimum(rest_x[:, None], rest_y[None, :]) for x, rest_x, y, rest_y in halves)
    of = set(first.tolist())
    order = np.array([[lcs("".join(c for c in a if ord(c) in of), b) for b in texts[-40:]] for a in texts])
    exact = np.array([[lcs(a, b) for b in texts[-40:]] for a in texts])
    assert (order <= one[:, -40:]).all() and (exact <= order + two[:, -40:]).all()
    enough = 70.0 / 200 * (n[:, None] + n[None, -40:])
    # half of the characters in order and the letters of the others leave out most of what letters leave
    assert (order + two[:, -40:] >= enough)[:300].mean() < 0.25 * (one + two >= enough.max())[:300].mean() + 0.05


LETTERS = "eeeennnniiissrratdhulcgmobwfkzvp     ", "aaaaaoooeeessnnrrllidtcumpqñóáéí     "


@functools.cache
def near_copies():
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list(LETTERS[k % 2]), n)) for k, n in enumerate(rng.choice([60, 60, 60, 45, 20], 420))]
    for t in texts[:60]:  # copies near the bounds
        for k in (1, 3, 6, 9, 14):
            u = list(t)
            for _ in range(min(k, len(u))):
                u[int(rng.integers(0, len(u)))] = str(rng.choice(list(LETTERS[0])))
            texts.append("".join(u))
    texts = sorted({*texts, "", "日本" * 30, "日本" * 29 + "語", "x" * 130, "x" * 126})
    return texts, [(i, j, indel(a, b)) for i, a in enumerate(texts) for j, b in enumerate(texts[i + 1:], i + 1)]


@pytest.mark.parametrize("least", [70.0, 81.0, 90.0, 95.0])
def test_many_texts_and_near_copies(least, monkeypatch):
    texts, scores = near_copies()
    want = {(i, j) for i, j, score in scores if score >= least - 1e-9}
    for few, cells in ((256, 1 << 30), (4, 1 << 30), (4, 5000)):  # also with order and letters looked at for each, and with few texts at once
        monkeypatch.setattr(duplicates, "_FEW", few)
        monkeypatch.setattr(duplicates, "_CELLS", cells)
        p, q, _ = duplicates.title_links(texts, texts, least, True)
        assert set(zip(p.tolist(), q.tolist())) == want and len(p) == len(want) > 60
        p, q, _ = duplicates.title_links(texts[:300], texts[300:], least)
        assert set(zip(p.tolist(), (q + 300).tolist())) == {(i, j) for i, j in want if i < 300 <= j} and len(p) == len(set(zip(p.tolist(), q.tolist())))


def test_blocks_leave_out_texts_of_other_letters():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list(LETTERS[k % 2]), 60)) for k in range(8192)]
    flat, n = duplicates._points(texts)
    counts = duplicates._counted(duplicates._frequent(flat), flat, n).astype(np.uint8)
    counts = np.ascontiguousarray(counts[duplicates._places(counts)].T)
    apart = duplicates._apart(counts, counts[:, 640:704])
    exact = np.abs(counts[:, :, None].astype(int) - counts[:, None, 640:704]).sum(axis=0)
    assert (apart <= exact.min(axis=1)).all() and (apart <= 6).mean() < 0.6 and not apart[640:704].any()


def test_documents_are_read_once(spark):
    """The report's pairs come from classes and members that were taken once, not from the documents at each use."""
    d = catalogue.docs(spark, DIR)
    assert any("documents" in f for f in d.inputFiles()) and not any("documents" in f for f in duplicates.later_duplicates(d).inputFiles())


def test_duplicates_across_senders_dates_and_nulls(spark):
    rows = [(1, "Rechnung vom Mai", "src1", "2024-01-15"), (2, "rechnung vom mai", "src2", "2024-01-15"), (3, "Rechnung vom Mai", None, None), (4, "Rechnung vom Mai", None, None), (5, "Rechnung vom Juni", "SRC1", "2024-01-15"),
            (6, None, "src1", "2024-01-15"), (7, "none", "src1", "2024-01-15"), (8, "", "src1", "2024-01-16"), (9, "", "src1", "2024-01-15"), (10, "Rechnung vom Mai", "src1", "2024-01-16"), (11, "Rechnung vom Mai", "src19", None), (12, "Rechnung vom Mai", "src1", "2024-01-15")]
    d = spark.createDataFrame(rows, "document_id long, title string, correspondent string, created string")
    got, n = expanded(duplicates.duplicates(d).collect())
    want = plain(rows)
    assert got == want and n == len(rows) and {(1, 2), (3, 4), (1, 10)} <= want
    later = {r["document_id"]: r["pairs"] for r in duplicates.later_duplicates(d).collect()}
    assert later == {i: sum(a == i for a, _ in want) for i in {a for a, _ in want}}


def test_query_and_chunks(spark):
    rows = [tuple(r) for r in catalogue.docs(spark, DIR).select("document_id", "title", "correspondent", "created").orderBy("document_id").collect()]
    want = plain(rows)
    got, n = expanded(catalogue.queries()["q30_near_duplicates"](spark, DIR).collect())
    assert got == want and n == len(rows) and want
    d = catalogue.docs(spark, DIR)
    small = {(r[0], r[1]) for r in duplicates.class_pairs(d, chunk=3).collect()}
    assert small == {(r[0], r[1]) for r in duplicates.class_pairs(d).collect()}
    assert duplicates.duplicates(d.where(F.lit(False))).count() == 0


def test_report_with_duplicates(spark):
    q = catalogue.queries()
    rows = [tuple(r) for r in catalogue.docs(spark, DIR).select("document_id", "title", "correspondent", "created").orderBy("document_id").collect()]
    want = plain(rows)
    first = {a: sum(x == a for x, _ in want) for a in {a for a, _ in want}}
    report = {tuple(r) for r in q["q59_full_quality_report"](spark, DIR).collect()}
    assert report - {tuple(r) for r in q["q23_quality_report"](spark, DIR).collect()} == {("potential_duplicate", "medium", len(want), len(first))}
    other = {r["document_id"]: r["n"] for r in catalogue.issues.issues(catalogue.docs(spark, DIR)).groupBy("document_id").agg(F.count("*").alias("n")).collect()}
    all_of = {i: other.get(i, 0) + first.get(i, 0) for i in {*other, *first}}
    top = sorted(all_of.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert [tuple(r) for r in q["q60_full_top_documents"](spark, DIR).collect()] == top
    assert ("potential_duplicate", len(want)) in {tuple(r) for r in q["q61_full_recommendations"](spark, DIR).collect()}
