"""Paged source, sinks with commit, streams that go on, folds, constraints and the nearest name, against plain code."""

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import papyra
from papyra.functions.similarity import wratio
from papyra.operators import entities, folds, issues, nearest, scanner
from papyra.plans import catalogue
from papyra.sources import commits, paged, storage
from papyra.streaming import duplicates as arrivals, ledger, mail

DIR = "/root/testdata/sf0.001"


# --- an independent weighted ratio, by the public definition: dynamic programming, windows one by one

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def ratio(a, b):
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def partial(a, b):
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0 if b else 100.0
    windows = {b[max(0, i):i + len(a)] for i in range(1 - len(a), len(b))}
    return max(ratio(a, w) for w in windows if w)


def by_words(a, b, score):
    x, y = set(a.split()), set(b.split())
    sort = score(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    if not x or not y:
        return sort if score is partial else max(sort, 0.0)
    both = sorted(x & y)
    if score is partial:
        return 100.0 if both else max(sort, score(" ".join(sorted(x - y)), " ".join(sorted(y - x))))
    if both and (x <= y or y <= x):
        return 100.0
    first, second = (" ".join(both + sorted(z)) for z in (x - y, y - x))
    return max([sort, score(first, second)] + ([score(" ".join(both), first), score(" ".join(both), second)] if both else []))


def weighted(a, b):
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    if times < 1.5:
        return max(ratio(a, b), 0.95 * by_words(a, b, ratio))
    scale = 0.9 if times <= 8 else 0.6
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * by_words(a, b, partial))


def some_names(seed, n):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghäß") for _ in range(rnd.randint(1, 9))) for _ in range(30)]
    return [rnd.choice([" ", "  "]).join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(n)]


def test_weighted_ratio_against_plain_code():
    from papyra.functions.similarity import wratio

    a, b = some_names(1, 40), some_names(2, 40)
    for x in a:
        for y in b + [x[:len(x) // 2], x + "x"]:
            assert wratio(x, y) == pytest.approx(weighted(x, y)), (x, y)


def test_bounds_are_never_exceeded():
    a, b = some_names(3, 60) + ["", "a"], some_names(4, 60) + ["", "äß" * 40]
    u = nearest.bounds(nearest.Names(a), nearest.Names(b))
    assert all(u[i, j] >= weighted(x, y) for i, x in enumerate(a) for j, y in enumerate(b))


@pytest.mark.parametrize("block", [nearest.BLOCK, 7])
def test_nearest_against_all_pairs(spark, block):
    names, known = [n.title() for n in some_names(5, 30)] + ["", None], [*some_names(6, 40), "ABC", "abc "]
    tags = spark.createDataFrame(list(enumerate(known)), "pos long, name string")
    got = {r["name"]: (r["tag"], r["score"]) for r in nearest.nearest(spark.createDataFrame([(n,) for n in names], "name string"), tags, block).collect()}
    assert got.keys() == set(names) - {None}
    for n, (tag, score) in got.items():
        all_scores = [weighted(n.lower().strip(), k.lower().strip()) for k in known]
        assert score == pytest.approx(max(all_scores)) and all_scores[known.index(tag)] == pytest.approx(max(all_scores))
    same = spark.createDataFrame([(4, "abc "), (3, "x"), (2, "ABC"), (5, "Abc")], "pos long, name string")
    assert [r["tag"] for r in nearest.nearest(spark.createDataFrame([("aBC",)], "name string"), same, block).collect()] == ["ABC"]  # the first of equal ones
    assert nearest.nearest(tags.select("name"), tags.where("false")).count() == 0


def test_few_pairs_are_scored(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("etaoinshrdlucmfw") for _ in range(rnd.randint(3, 10))) for _ in range(3000)]
    known = list(dict.fromkeys(" ".join(rnd.choices(words, k=rnd.randint(2, 3))) for _ in range(4000)))
    asked = [k[:3] + "q" + k[4:] for k in known[::40]]
    tags = spark.createDataFrame(list(enumerate(known)), "pos long, name string")
    d = nearest.nearest(spark.createDataFrame([(a,) for a in asked], "name string"), tags).agg(F.sum("scored"), F.min("score")).first()
    assert d[0] < 0.05 * len(asked) * len(known) and d[1] > 85


def test_matching_in_order(spark):
    known = some_names(8, 12)
    tags = spark.createDataFrame(list(enumerate(known)), "pos long, name string")
    rows = [(1, [known[0].upper(), "Neu eins", "neu eins ", None, "Neu zwei"]), (2, None), (3, []), (1, ["Neu eins", known[3]])]
    d = spark.createDataFrame(rows, "id long, tags array<string>").withColumn("matches", F.lit("x"))
    want = []
    for k, proposed in rows:
        pool, out = list(known), []
        for t in proposed or []:
            if t is None:
                out.append((None, None, None))
                continue
            best = max(range(len(pool)), key=lambda j: (weighted(t.lower().strip(), pool[j].lower().strip()), -j))
            score = weighted(t.lower().strip(), pool[best].lower().strip())
            out.append((t, pool[best] if score >= 95 else None, pytest.approx(score)))
            if score < 95:
                pool.append(t)  # a candidate of the later ones
        want.append((k, out))
    got = [(r["id"], [tuple(m) for m in r["matches"]]) for r in nearest.matched(d, tags).collect()]
    assert sorted(got, key=lambda r: (r[0], len(r[1]))) == sorted(want, key=lambda r: (r[0], len(r[1])))


# --- paged source

def laid(spark, tmp_path, page=10):
    d = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang", F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("doc_id").cast("int")).alias("day"), F.when(F.col("doc_id") % 5 > 0, F.left("text", F.lit(9))).alias("t"))
    return d, paged.laid_down(d, f"file://{tmp_path}/pages", ["lang", "doc_id"], ["doc_id", "lang", "day"], page)


def test_only_pages_that_a_filter_allows_are_read(spark, tmp_path):
    d, client = laid(spark, tmp_path)
    read = lambda *c: paged.paged(spark, client, d.schema, c, per_task=1)
    rows, of = read(), lambda x: x.rdd.getNumPartitions()
    assert rows.columns == [*d.columns, "_page", "_error"] and of(rows) == 20
    key = lambda x: sorted(map(str, x.select(*d.columns).collect()))
    assert key(rows) == key(d)
    day = dt.date(2024, 3, 1)
    for conditions, cond, most in (([("lang", "=", "de")], "lang = 'de'", 8), ([("lang", "=", "de"), ("doc_id", ">", 50)], "lang = 'de' and doc_id > 50", 6), ([("lang", "in", ["fr", "es"]), ("day", ">=", day)], "lang in ('fr', 'es') and day >= date'2024-03-01'", 12),
                                   ([("t", ">", "T")], "t > 'T'", 20), ([("lang", "=", "xx")], "lang = 'xx'", 1), ([("doc_id", "<=", 3), ("doc_id", "<", 3)], "doc_id < 3", 4)):
        got = read(*conditions)
        assert key(got) == key(d.where(cond)) and of(got) <= most, cond
    # what is put on a frame is Spark's: several scans of one frame don't mix
    de = read(("lang", ">=", "de"))
    assert key(de.where("doc_id < 50").unionByName(de.where("t is null"))) == sorted(key(d.where("lang >= 'de' and doc_id < 50")) + key(d.where("lang >= 'de' and t is null")))
    plan = read(("lang", "=", "de"), ("t", ">", "A"))._jdf.queryExecution().executedPlan().toString()
    assert "(t#" in plan and "= de" not in plan  # judged by the service
    for bad in (("lang", "~", "x"), ("nope", "=", 1), ("lang", "=", None)):
        with pytest.raises(ValueError):
            read(bad)


def test_a_page_that_fails(spark, tmp_path):
    d, client = laid(spark, tmp_path)

    class Failing(paged.FilePages):
        def rows(self, page, conditions):
            if page == 4:
                raise OSError("gone")
            return super().rows(page, conditions)

    bad = Failing(f"file://{tmp_path}/pages", d.schema, ["lang"])
    with pytest.raises(Exception, match="gone"):
        paged.paged(spark, bad, d.schema, retries=0).count()
    kept = paged.paged(spark, bad, d.schema, retries=1, on_error="keep")
    assert [(r["_page"], r["_error"], r["doc_id"]) for r in kept.where("_error is not null").collect()] == [(4, "OSError: gone", None)]
    assert kept.count() == 191 and paged.until_error(kept).count() == 40 and paged.until_error(paged.paged(spark, client, d.schema)).count() == 200
    with pytest.raises(ValueError):
        paged.paged(spark, bad, d.schema, on_error="?")
    with pytest.raises(ValueError):
        paged.FilePages("x", spark.createDataFrame([], "a double").schema, ["a"])


# --- sinks

def test_csv_file(spark, tmp_path):
    d = spark.createDataFrame([(i, f'T "{i}", ü', ["a", "b"], i % 2 == 0) for i in range(50)], "document_id long, title string, tags array<string>, has_ocr boolean").repartition(5).orderBy("document_id")
    out = f"file://{tmp_path}/out"
    commits.csv_file(d, out, "report.csv")
    lines = open(f"{tmp_path}/out/report.csv", encoding="utf-8").read().split("\n")
    assert lines[0] == "﻿Dokument-ID,Titel,Tags,OCR vorhanden" and lines[1:-1] == [f'{i},"T ""{i}"", ü","a, b",{"Ja" if i % 2 == 0 else "Nein"}' for i in range(50)] and lines[-1] == ""
    commits.csv_file(d, out, "parts.csv", one_file=10)
    parts = sorted(os.listdir(f"{tmp_path}/out/parts.csv"))
    assert "".join(open(f"{tmp_path}/out/parts.csv/{p}", encoding="utf-8").read() for p in parts).split("\n") == lines
    commits.csv_file(d.where("false"), out, "report.csv")
    assert open(f"{tmp_path}/out/report.csv", encoding="utf-8").read() == lines[0] + "\n" and sorted(os.listdir(f"{tmp_path}/out")) == ["parts.csv", "report.csv"]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    d = spark.range(40).repartition(4).select(F.col("id").alias("document_id"))
    commits.csv_file(d, out, "a.csv")
    before = open(f"{tmp_path}/out/a.csv").read()
    fail = F.when(F.col("document_id") == 33, F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("document_id"))
    with pytest.raises(Exception, match="boom"):
        commits.csv_file(d.select(fail.alias("document_id")), out, "a.csv")
    assert open(f"{tmp_path}/out/a.csv").read() == before and os.listdir(f"{tmp_path}/out") == ["a.csv"]
    files = d.select(F.concat(F.lit("m/"), "document_id", F.lit(".pdf")).alias("path"), F.col("document_id").cast("string").cast("binary").alias("content"), F.col("document_id").alias("uid"))
    for path in (F.lit("../x"), F.lit("/etc/x"), F.lit(None).cast("string")):
        with pytest.raises(Exception):
            commits.files(files.withColumn("path", F.when(F.col("uid") == 3, path).otherwise(F.col("path"))), f"{out}/files")
        assert not list(commits.stored(f"{out}/files"))
    commits.files(files, f"{out}/files")
    got = dict(commits.stored(f"{out}/files"))
    assert got == {f"m/{i}.pdf": len(str(i)) for i in range(40)} | {f"m/{i}.pdf.json": len(f'{{"uid":{i}}}') for i in range(40)} and [c["files"] for c in commits.committed(f"{out}/files")] == [80]
    storage.put(f"{out}/files/.staging/lost/x", b"x")
    assert commits.cleaned(f"{out}/files") >= 1 and commits.cleaned(f"{out}/files") == 0 and dict(commits.stored(f"{out}/files")) == got


# --- streams

def mails_of(spark, a, b):
    n = F.col("id")
    return spark.range(a, b).select(F.concat(F.lit("acc"), n % 3).alias("account"), (F.floor(n / 3) + 1).alias("uid"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("sent"), F.concat(F.lit("Subject: ü"), n).alias("content"))


def test_mail_goes_on_where_it_stopped(spark, tmp_path):
    box, out, log = (f"file://{tmp_path}/{x}" for x in ("box", "out", "log"))
    mail.delivered(mails_of(spark, 0, 90), box, 10)
    server = mail.FolderServer(box)
    key = lambda d: sorted((r["account"], r["uid"], bytes(r["content"]).decode()) for r in d.collect())
    assert mail.taken(mail.mails(spark, server, most=7), out, log).count() == 21
    assert mail.taken(mail.mails(spark, server), out, log).count() == 90  # another session would begin here
    mail.delivered(mails_of(spark, 90, 120), box, 10)
    got = mail.taken(mail.mails(spark, server), out, log)
    assert key(got) == sorted((f"acc{n % 3}", n // 3 + 1, f"Subject: ü{n}") for n in range(120))
    assert mail.taken(mail.mails(spark, server), out, log).count() == 120


def test_an_account_that_fails_keeps_its_place(spark, tmp_path):
    box, out, log = (f"file://{tmp_path}/{x}" for x in ("box", "out", "log"))
    mail.delivered(mails_of(spark, 0, 30), box, 10)

    class Down(mail.FolderServer):
        def uids(self, account, after, asked):
            if account == "acc1":
                raise OSError("no connection")
            return super().uids(account, after, asked)

    assert {r["account"] for r in mail.taken(mail.mails(spark, Down(box)), out, log).collect()} == {"acc0", "acc2"}
    got = mail.taken(mail.mails(spark, mail.FolderServer(box)), out, log)
    assert got.count() == 30 and got.select("account", "uid").distinct().count() == 30


def test_the_search_reaches_back_a_day():
    asked = []

    class Server:
        def accounts(self):
            return ["a"]

        def uids(self, account, after, since):
            asked.append((after, since))
            return [5, 6, 7]

    r = mail._Reader(Server(), 2)
    first = r.latestOffset()
    assert first["a"]["uid"] == 6 and asked[0] == (0, None)
    r.latestOffset()
    assert asked[1][0] == 6 and asked[1][1] == dt.datetime.fromisoformat(first["a"]["checked"]) - dt.timedelta(days=1)
    assert [p.uids for p in r.partitions({}, {"a": {"uid": 7, "checked": None}})] == [[5, 6, 7]] and r.partitions({"a": {"uid": 7, "checked": None}}, {"a": {"uid": 7, "checked": None}}) == []


def test_ledger_goes_on_and_alerts_once(spark, tmp_path):
    src, out, log = (f"file://{tmp_path}/{x}" for x in ("in", "out", "log"))
    schema = "model string, tokens long, cost double"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    now = lambda: {r["model"]: tuple(r)[1:] for r in ledger.kept(ledger.usage(spark, src, schema), 1.0, out, log).collect()}
    put([("a", 10, 0.5), (None, None, 0.25), ("a", 1, None)])
    assert now() == {"a": (2, 11, 0.5, 0), "unknown": (1, 0, 0.25, 0), "total": (3, 11, 0.75, 0)}
    put([("b", 5, 0.25)])
    assert now()["total"] == (4, 16, 1.0, 0)  # the limit is reached, not passed
    put([("b", 5, 0.000001)])
    put([("a", 5, 3.0)])
    assert now() == {"a": (3, 16, 3.5, 0), "b": (2, 10, 0.25, 0), "unknown": (1, 0, 0.25, 0), "total": (6, 26, 4.0, 1)}
    assert now()["total"] == (6, 26, 4.0, 1)


def test_duplicates_in_two_arrivals(spark, tmp_path):
    d = catalogue.docs(spark, DIR).select("document_id", "title", "correspondent", "created")
    src, state = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    schema = "document_id long, title string, correspondent string, created string"
    for part in (1, 0):  # smaller ids of known classes come later
        d.where(F.col("document_id") % 2 == part).coalesce(1).write.mode("append").parquet(src)
        arrivals.arrived(arrivals.documents(spark, src, schema), state, chunk=3 if part else 4096)
    key = lambda x: sorted((r["id1"], r["id2"], r["n1"], r["n2"], round(r["score"], 9)) for r in x.collect())
    from papyra.operators import duplicates

    want = key(duplicates.class_pairs(d))
    assert key(arrivals.found(spark, state)) == want and len({r["batch"] for r in arrivals.found(spark, state).collect()} - {None}) == 2
    told = {r["batch"]: tuple(r)[1:] for r in arrivals.counts(spark, state).collect()}
    assert sum(t[0] for t in told.values()) == d.count() and sum(t[1] for t in told.values()) == duplicates.classes(d).count() and sum(t[2] for t in told.values()) == sum(a != b for a, b, *_ in want)


# --- table function, folds, constraints

def test_scan_in_one_pass(spark):
    d = spark.createDataFrame([(1, ["x", "y"]), (2, []), (None, ["x"]), (1, None), (3, ["x", "x"])], "document_id long, found array<string>")
    got = sorted(map(tuple, scanner.scanned(d, F.col("found"), parts=2).collect()), key=str)
    assert got == sorted([("issue", 1, "x", 1), ("issue", 1, "y", 1), ("issue", None, "x", 1), ("issue", 3, "x", 1), ("issue", 3, "x", 1), ("total", None, None, 5), ("total", None, "x", 4), ("total", None, "y", 1)], key=str)
    assert scanner.scanned(d.where("false"), F.col("found")).count() == 0
    with pytest.raises(Exception, match="document_id, issues and part"):
        spark.udtf.register("bad_scan", scanner.Scan)
        spark.sql("select * from bad_scan(table(select 1 as a))").collect()


@pytest.mark.parametrize("held", [folds.HELD, 2])
def test_folds_merge(spark, held, monkeypatch):
    monkeypatch.setattr(folds, "HELD", held)
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice(["Rechnung", "rechnungen", "Brief", "brief", None, ""]), rnd.choice(["Rechnung", "Brief", ""])) for _ in range(300)]
    rows += [("hot", "Rechnungen", "Rechnung")] * 500
    got = {r["cluster"]: tuple(r)[1:] for r in folds.likeness(spark.createDataFrame(rows, "cluster string, name string, representative string").repartition(9)).collect()}
    for k in ("a", "b", None, "hot"):
        own = [r for r in rows if r[0] == k]
        s = [ratio(n.lower(), c.lower()) for _, n, c in own if n is not None and n != c]
        assert got[k] == (len(own), len(s), min(s), max(s), pytest.approx(sum(s) / len(s)))
    tree = {r["parent"]: (r["children"], r["documents"]) for r in folds.tree(spark.createDataFrame([("p", "x", 2), ("p", "a", 1), ("p", "x", 3), ("q", None, 5)], "parent string, child string, documents long").repartition(3)).collect()}
    assert tree == {"p": (["a", "x"], 6), "q": ([], 0)}
    assert folds.likeness(spark.createDataFrame([], "cluster string, name string, representative string")).count() == 0


def test_tag_analysis(spark):
    rows = [("c", "Rechnung", "Rechnung"), ("c", "Rechnungen", "Rechnung"), ("d", "Brief", "Brief"), ("d", "Briefx", "Brief"), ("d", "Brieg", "Brief"), ("e", "allein", "allein")]
    total = spark.range(10)
    r = folds.tag_analysis(spark.createDataFrame(rows, "cluster string, name string, representative string"), total).first()
    one, two = ratio("rechnungen", "rechnung"), (ratio("briefx", "brief") + ratio("brieg", "brief")) / 2
    mean = (one + two) / 2
    assert (r["total"], r["clusters"], r["clustered"], r["removable"], r["smallest"], r["largest"], r["safe_merges"]) == (10, 2, 5, 3, 2, 3, 0)
    assert r["mean_similarity"] == pytest.approx(mean, abs=1e-6) and r["duplication"] == 0.5 and r["reduction"] == 0.3 and r["consistency"] == pytest.approx(1 - mean / 100, abs=1e-3) and r["organisation"] == 0.95
    none = folds.tag_analysis(spark.createDataFrame([], "cluster string, name string, representative string"), total).first()
    assert (none["clusters"], none["clustered"], none["consistency"], none["organisation"], none["duplication"]) == (0, 0, 1.0, 1.0, 0.0)


def plain_groups(rows, apart, themes, least=85.0):
    """One tag after the other, as they come."""
    same = lambda n: n.lower().strip()
    blocked = {frozenset((same(a), same(b))) for a, b in apart}
    themes = {same(t) for t in themes}
    taken, out = set(), []
    for p, n in rows:
        if p in taken:
            continue
        out.append((p, p, n))
        for q, m in rows:
            if q > p and q not in taken and frozenset((same(n), same(m))) not in blocked and (same(n) in themes) == (same(m) in themes) and ratio(n.lower(), m.lower()) >= least:
                taken.add(q)
                out.append((p, q, m))
        taken.add(p)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_under_constraints(spark, seed):
    rnd = random.Random(seed)
    base = ["Telekom", "Versicherung", "Rechnungen", "Vertragsdaten"]
    rows = [(k, "".join(c for c in rnd.choice(base) if rnd.random() > 0.06) + rnd.choice(["", "s", "en"])) for k in range(40)]
    names = [n for _, n in rows]
    apart = [(rnd.choice(names), rnd.choice(names).upper()) for _ in range(60)] + [(None, "x")]
    themes = rnd.sample(names, 5)
    t = spark.createDataFrame(rows, "pos long, name string")
    a, th = spark.createDataFrame(apart, "a string, b string"), spark.createDataFrame([(x,) for x in themes], "name string")
    got = sorted(map(tuple, entities.greedy_groups(t, apart=a, themes=th).collect()))
    assert got == plain_groups(rows, apart[:-1], themes) and got != sorted(map(tuple, entities.greedy_groups(t).collect()))
    edges = {tuple(r) for r in entities.hierarchy_apart(t.withColumn("document_count", F.lit(1)), a, th).collect()}
    for group in {g for g, _, _ in got}:
        own = [(p, n) for g, p, n in got if g == group]
        plain = [n for _, n in own if not re.search("(en|er|s|e)$", n)]
        top = plain[0] if plain else min((len(n), p, n) for p, n in own)[2]
        assert {(top, n) for p, n in own if n != top} <= edges


def test_tables_are_swept(spark):
    papyra.sweep(spark)
    entities.greedy_groups(spark.createDataFrame([(k, "a" * (k + 1)) for k in range(12)], "pos long, name string")).collect()
    assert len(papyra._FOLDERS) <= 3  # one of edges, one state, not one for each round
    papyra.sweep(spark)
    assert not papyra._FOLDERS


def test_scan_query_reads_every_issue(spark):
    d = catalogue.whole_docs(spark, DIR)
    got = scanner.scanned(d, issues.issue_types())
    assert got.where("kind = 'issue'").count() == issues.issues(d).count()


# --- reports, limiter, updates

def test_json_file(spark, tmp_path):
    import json

    out = f"file://{tmp_path}/out"
    d = spark.createDataFrame([(i, f'T "{i}" ü' if i % 3 else None, ["a"]) for i in range(30)], "document_id long, title string, tags array<string>").repartition(4).orderBy("document_id")
    commits.json_file(d, out, "report.json", "2024-01-15T10:00:00", version="2")
    got = json.load(open(f"{tmp_path}/out/report.json", encoding="utf-8"))
    assert got["metadata"] == {"generated_at": "2024-01-15T10:00:00", "generator": "papyra", "version": "2", "record_count": 30}
    assert got["data"] == [{"document_id": i, "title": f'T "{i}" ü' if i % 3 else None, "tags": ["a"]} for i in range(30)]
    commits.json_file(d, out, "parts.json", "x", one_file=10)
    assert json.loads("".join(open(f"{tmp_path}/out/parts.json/{p}", encoding="utf-8").read() for p in sorted(os.listdir(f"{tmp_path}/out/parts.json"))))["data"] == got["data"]
    commits.json_file(d.where("false"), out, "none.json", "x")
    assert json.load(open(f"{tmp_path}/out/none.json"))["metadata"]["record_count"] == 0


@pytest.mark.parametrize("most", [1, 2, 5])
def test_limiter_against_plain_code(spark, most):
    from papyra.operators import reports

    rnd = random.Random(most)
    rows = [(rnd.choice("ab"), round(rnd.random() * 20, 2), i) for i in range(120)]
    got = {r["i"]: (r["start"], r["waited"]) for r in reports.limited(spark.createDataFrame(rows, "k string, at double, i long"), "k", "at", most, 1.5, ["i"]).collect()}
    for k in "ab":
        begun = []
        for _, at, i in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            begun.append(max([at] + begun[-1:] + ([begun[-most] + 1.5] if len(begun) >= most else [])))
            assert got[i] == (pytest.approx(begun[-1]), pytest.approx(begun[-1] - at))
    with pytest.raises(ValueError):
        reports.limited(spark.createDataFrame(rows, "k string, at double, i long"), "k", "at", 0, 1.0, ["i"])


def test_report_of_nothing(spark):
    from papyra.operators import reports

    none = spark.createDataFrame([], "document_id long, issue_type string, severity string, times long")
    assert [(r["key"], r["value"]) for r in reports.sections(none).orderBy("ord").collect()] == [(n, "0") for n in reports.LABELS]
    empty = catalogue.whole_docs(spark, DIR).where("false")
    assert reports.corpus(empty).count() == 0 and reports.statistics(empty).count() == 0
    assert [tuple(r) for r in reports.suggested(spark.createDataFrame([("a", None), ("b", "c")], "x string, y string"), ["x", "y"]).collect()] == [("x", 2), ("y", 1)]


def test_updates_and_isolated_errors(spark):
    import json

    from papyra.operators import records

    dim = lambda *names: spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "id long, name string")
    rows = [(1, "", " ACME ", "Rechnung", ["b", "", "A", None], "n", 7), (2, None, "", None, [], None, None), (3, "t", "unknown", "x", None, "", 0)]
    d = spark.createDataFrame(rows, "document_id long, title string, correspondent string, document_type string, tags array<string>, note string, archive_serial_number long")
    got = {r["document_id"]: json.loads(r["data"]) for r in records.update_data(d, dim("acme"), dim("brief", "rechnung"), dim("a", "b"), ["archive_serial_number"]).collect()}
    assert got == {1: {"title": "", "correspondent": 1, "document_type": 2, "tags": [2, 1], "notes": "n", "archive_serial_number": 7}, 2: {}, 3: {"title": "t", "notes": "", "archive_serial_number": 0}}

    def send(row):
        if row["document_id"] == 3:
            raise OSError("x" * 300)

    done = records.applied(d.unionByName(d.where("document_id = 1").withColumn("document_id", F.lit(None).cast("long"))).repartition(3), send)
    assert sorted((str(r["document_id"]).removesuffix(".0"), r["ok"], r["error"]) for r in done.collect()) == sorted([("1", True, None), ("2", True, None), ("3", False, "x" * 200), ("None", False, "Missing document ID")])
    assert {(r["error"], r["successful"], r["failed"]) for r in records.outcome(done).collect()} == {(None, 2, 2), ("x" * 200, 0, 1), ("Missing document ID", 0, 1)}


def test_enriched_rows_stay(spark):
    from papyra.operators import reports

    d = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-03-31"), (3, "2024-04-01"), (4, None)], "document_id long, created string")
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "c")], "document_id long, ocr string")
    assert sorted((r["document_id"], r["ocr"], r["fetched"]) for r in reports.enriched(d, t, "2024-01-01", "2024-03-31").collect()) == [(1, "b", True), (2, None, False)]


def test_a_second_call_for_answers_without_json(spark):
    from papyra.operators import records

    rows = [(1, "good"), (2, "bad"), (3, None), (4, "raise"), (5, "never")]
    d = spark.createDataFrame(rows, "document_id long, text string")

    def first(t):
        if t == "raise":
            raise OSError("down")
        return f'{{"title": "{t}"}}' if t == "good" else "no json"

    got = {r["document_id"]: tuple(r)[1:] for r in records.extracted(d, first, ["title"], again=lambda t: "?" if t == "never" else f'{{"title": "second {t}"}}').collect()}
    assert got == {1: ("good", 1, None), 2: ("second bad", 2, None), 3: (None, 0, None), 4: ("second raise", 2, None), 5: (None, 2, "no JSON in the answer")}


def test_running_totals_of_a_common_key(spark):
    from papyra.operators import stats
    from papyra.sources import mailbox

    rows = [(None if i % 9 == 0 else 1 if i % 3 else i % 5, i, None if i % 7 == 0 else i / 8) for i in range(500)]
    got = {r["i"]: (r["so_far"], r["cost_so_far"]) for r in stats.running(spark.createDataFrame(rows, "k long, i long, cost double").repartition(7), "k", "i").collect()}
    for i in range(500):
        own = [c or 0 for k, j, c in rows if k == rows[i][0] and j <= i]
        assert got[i] == (len(own), pytest.approx(sum(own), abs=1e-4))
    files = spark.createDataFrame([(i, "d", "scan.pdf") for i in range(40)] + [(40, "d", "x.pdf")], "uid long, directory string, filename string").repartition(5)
    paths = {r["uid"]: r["path"] for r in mailbox.attachment_files(files).collect()}
    assert paths[0] == "d/scan.pdf" and paths[40] == "d/x.pdf" and [paths[i] for i in range(1, 40)] == [f"d/scan_{i}.pdf" for i in range(1, 40)]


def test_masking(spark):
    from papyra.functions import text as T

    def plain(msg):
        for mark in T.SECRETS:
            if mark in msg and msg.split(mark)[1].split():
                msg = msg.replace(mark + msg.split(mark)[1].split()[0], f"{mark}[MASKED]")
        return msg

    rows = ["Token abc def Token abc Token xyz", "Bearer  abc", "api_key=1 password=p secret=", "password=a.b*c password=a.b*c", "token abc", "", "secret=x\nsecret=x y", "Token Token a"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", T.masked(F.col("t")).alias("m"), T.all_masked(F.col("t")).alias("a")).collect()
    assert [r["m"] for r in got] == [plain(r) for r in rows] and got[4]["a"] == "token [MASKED]" and got[0]["a"] == "Token [MASKED] def Token [MASKED] Token [MASKED]"


def test_pairs_of_tags_that_rows_repeat_are_scored_once(spark, monkeypatch):
    scored = []
    monkeypatch.setattr(nearest, "wratio", lambda a, b: scored.append((a, b)) or wratio(a, b))
    rows = [{"name": n, "tag": "zz", "score": 10.0} for n in ("Apfel rot", "Birne gelb", "apfel  rot", None, "Birne gelb ")]
    first = nearest._in_order(rows, 95.0)
    n = len(scored)
    assert nearest._in_order(rows, 95.0) == first and len(scored) == n and [m["match"] for m in first] == [None, None, "Apfel rot", None, "Birne gelb"]


def test_files_are_written_in_small_batches(spark, tmp_path, monkeypatch):
    key, held = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)

    def seen(frame):
        held.append(spark.conf.get(key))
        return of(frame)

    of = type(spark.range(0)).write.fget
    monkeypatch.setattr(type(spark.range(0)), "write", property(seen))
    commits.files(spark.createDataFrame([("a.txt", b"x" * 10)], "path string, content binary"), str(tmp_path))
    assert held == [str(papyra.ARROW_BYTES)] and spark.conf.get(key) == before and storage.get(f"{tmp_path}/a.txt") == b"x" * 10
