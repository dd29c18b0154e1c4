"""Spelling variants, the conversations' prefix trie and substring dedup against plain code."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from papyra.llm import _common, exactdedup, prefixtrie, quality, spelling, substrings
from papyra.llm.queries import op11_spelling_variants, op12_prefix_trie, op13_substring_dedup

DIR = "/root/testdata/sf0.001"
CLASH = "word n near best form root n_near form_n dir size key rest depth conv part place digest chars length at lo leaf under edge slice ids texts bits bucket hits smaller id".split()


def clashing(d):
    return d.withColumns({c: F.lit("x") for c in CLASH if c not in d.columns})


# --- spelling

def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    return sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % 199 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form, count = {}, {}
    for w in n:
        c = [u for u in n if near(w, u)]
        best = min(c, key=lambda u: (-n[u], u), default=None)
        form[w], count[w] = best if best is not None and n[best] >= 5 * n[w] else None, len(c)

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], count[w], n[form[w]] if form[w] else None) for w in n)


def variants_of(d):
    return sorted(tuple(r) for r in d.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("most", [spelling.MOST, 40])
def test_spelling_against_plain_code(spark, most):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randint(5, 8))) for _ in range(250)]
    words += ["prefixes" + "".join(rnd.choice("xs") for _ in range(rnd.randint(0, 6))) for _ in range(60)] + ["a" * k for k in range(5, 40)] + ["ÀB×÷cdefg", "straßen", "chain", "chains", "chainss"]
    rows = [(i, rnd.choice([" ", "\n", "1", "–"]).join(rnd.choices(words, [1 / (k + 1) for k in range(len(words))], k=400))) for i in range(60)]
    rows += [(None, "chains " * 60 + "chainss " * 6 + "Chainsx " * 400), (7, None), (8, ""), (9, "-- 12")] + [(3, "straßen straszen")] * 5
    d = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = variants_of(spelling.variants(d, most=most))
    assert got == plain_variants(rows) and sum(r[1] is not None for r in got) > 20


def test_spelling_chains_repeats_and_empty(spark):
    rows = [(1, f"{w} " * k) for w, k in (("abcdef", 3125), ("abcdeg", 625), ("abcdhg", 125), ("abcihg", 25), ("abjihg", 5), ("zzzzzz", 5), ("zzzzzy", 5))]
    got = {r[0]: r[1:3] for r in variants_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {r[0]: r[1:3] for r in plain_variants(rows)} and got["abjihg"][1] == "abcdef" and got["zzzzzy"] == (None, "zzzzzy")
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spelling_of_a_very_long_text(spark, monkeypatch):
    text = "wonderful " * 30 + "x" * 3000 + " wonderfull" * 30
    assert [w for p in spelling._pieces(text, 7) for w in p] == text.encode().split()
    rows = [(1, text)]
    assert variants_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_variants(rows)


def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert variants_of(op11_spelling_variants(spark, DIR)) == plain_variants(rows)


# --- prefix trie

def plain_trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    seq = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    new = {}
    for c in seq:
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        new[c] = seq.get(base, [])[:h] + seq[c][h:]
    held = defaultdict(list)
    for c, s in new.items():
        for d in range(len(s) + 1):
            held[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for k in held:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(held, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(held[k]) - 1) * len(k[-1][1]) if k else 0)
    for k, m in held.items():
        ends = ",".join(str(c) for c in sorted(m) if len(new[c]) == len(k))
        out.append((min(m), len(k), min(held[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(d):
    return sorted((tuple(r) for r in d.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def conversations(seed):
    rnd = random.Random(seed)
    rows = [(c, rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bé", "ccc", None]))
            for c in [*range(30), 100, 150, 151, 152, 250, 251, 252, -3, -100, -150, 301, 302, 303] for t in range(rnd.randint(1, 9))]
    rows += [(400, t, "user", "x" * t) for t in range(40)] + [(405, t, "user", "x" * t) for t in range(25)]  # a long one, and a prefix of it
    return rows + [(None, 0, "user", "q"), (7, 0, "user", "a"), (7, 0, "user", "a")] + [(1000 + c, 0, "user", "same") for c in range(50)]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_plain_code(spark, seed, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 3)
    rows = conversations(seed)
    d = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert trie_of(prefixtrie.trie(d)) == plain_trie(rows)


def test_trie_without_rows(spark):
    assert prefixtrie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert prefixtrie.trie(spark.createDataFrame([(None, 1, "user", "a")], "conv_id long, turn long, role string, text string")).count() == 0


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_of(op12_prefix_trie(spark, DIR)) == plain_trie(rows)


# --- substrings

def plain_kept(rows):
    least, inf = {}, float("inf")
    words = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x or "")
    own = lambda d: inf if d is None else d
    for d, x in rows:
        w = words(x)
        for i in range(len(w) - 12):
            k = tuple(w[i:i + 13])
            least[k] = min(least.get(k, inf), own(d))
    out = []
    for d, x in rows:
        w = words(x)
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if least[tuple(w[i:i + 13])] < own(d):
                gone[i:i + 13] = [True] * 13
        out.append((d, len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [substrings.SLICE_BYTES, 300])
def test_substrings_against_plain_code(spark, size, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE_BYTES", size)
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 3))) for _ in range(3000)]
    rows = []
    for d in range(120):
        t = []
        for _ in range(rnd.randint(0, 8)):
            i = rnd.randint(0, 2900)
            t += base[i:i + rnd.randint(1, 60)] + [str(rnd.random()) for _ in range(rnd.randint(0, 5))] + ["x" * rnd.choice([1023, 1024, 5000])] * (rnd.random() < 0.2)
        rows.append((rnd.choice([d, d, d, 5, None]), rnd.choice([" ", "\n", "  \t", "  "]).join(t)))
    rows += [(1, None), (2, ""), (3, " \n "), (None, None), (7, "a b " * 40), (8, "b a " * 40), (900, " ".join(base)), (3, " ".join(base[:14])), (901, " ".join(base[:13])), (902, " ".join(base[1:13])), (904, " ".join(base)), (904, " ".join(base))]
    d = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    found = substrings.without_repeats(d)
    got = found.collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == plain_kept(rows)
    for r in got:  # runs are apart, and hold what was removed
        assert sum(s["length"] for s in r["repeats"]) == r["n_removed"] and all(a["start"] + a["length"] < b["start"] for a, b in zip(r["repeats"], r["repeats"][1:]))
    assert substrings.without_repeats(d.where("false")).count() == 0


def test_a_passage_in_all_documents_and_a_long_text(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own{i} {passage} end{i}") for i in range(400)] + [(1000, " ".join(f"u{i}" for i in range(200_000)) + " " + passage), (1001, "u5 " + " ".join(f"u{i}" for i in range(100, 300)) + " x")]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got[0] == (0, rows[0][1]) and all(got[i] == (60, f"own{i} end{i}") for i in range(1, 400)) and got[1000][0] == 60 and got[1001] == (200, "u5 x")


def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op13_substring_dedup(spark, DIR).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in plain_kept(rows))


# --- exact dedup with a store, and joins whose common keys nobody has counted

def arrived(d):
    return sorted((tuple(r) for r in d.select("doc_id", "keep_id", "group_size", "kept", "hit").collect()), key=str)


def test_arrivals_against_a_store(spark, tmp_path):
    docs, store = f"file://{tmp_path}/docs", f"file://{tmp_path}/store"
    schema = spark.createDataFrame([], "doc_id long, text string, x string").schema
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(docs)
    put([(1, "Same", "a"), (2, "same", "b"), (3, "other", None), (None, None, None)])
    call = lambda: exactdedup.arrivals(spark, docs, store, schema)
    assert arrived(call()) == sorted([(1, 2, 2, False, False), (2, 2, 2, True, False), (3, 3, 1, True, False), (None, None, 1, True, False)], key=str)
    assert call().count() == 0  # nothing has come
    put([(9, "SAME", "c"), (8, "new", "d"), (0, "Other", None), (7, "", None)])
    put([(9, "same", "e")])
    # only the new rows, against all: old digests are hit
    assert arrived(call()) == sorted([(9, 9, 4, True, True), (9, 9, 4, True, True), (8, 8, 1, True, False), (0, 3, 2, False, True), (7, 7, 2, True, True)], key=str)
    whole = {(r["text_sha256"], r["keep_id"], r["group_size"]) for r in exactdedup.exact_duplicates(spark, docs).collect()}
    assert {(r["text_sha256"], r["keep_id"], r["group_size"]) for r in exactdedup.exact_duplicates(spark, docs).where("keep_id in (9, 3, 8, 7)").collect()} <= whole


def test_arrivals_compare_bytes_with_the_content_at_the_locator(spark, tmp_path):
    docs, store = f"file://{tmp_path}/docs", f"file://{tmp_path}/store"
    schema = spark.createDataFrame([], "doc_id long, text string").schema
    first = lambda t: F.unhex(F.sha2(F.left(t, F.lit(3)), 256))  # noqa: E731  a digest under which texts collide
    spark.createDataFrame([(1, "abcdef"), (2, "xyz")], schema).coalesce(1).write.parquet(docs)
    assert exactdedup.arrivals(spark, docs, store, schema, digest=first).count() == 2
    spark.createDataFrame([(3, "abc"), (4, "xyz")], schema).coalesce(1).write.mode("append").parquet(docs)
    with pytest.raises(ValueError, match="differ"):
        exactdedup.arrivals(spark, docs, store, schema, digest=first)


def test_salted_join(spark):
    left = spark.range(500).select("id", F.when(F.col("id") < 400, 7).otherwise(F.col("id") % 9).alias("k"))
    right = spark.createDataFrame([(7, "a"), (7, "b"), (3, "c")], "j long, v string")
    for how in ("inner", "left", "left_semi"):
        got = _common.salted_join(left, right, F.col("k") == F.col("j"), F.xxhash64("id"), how)
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, F.col("k") == F.col("j"), how).collect()))


def test_quality_beyond_the_languages_that_are_broadcast(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = lambda: sorted(map(str, quality.classify(docs, labels.where("quality = 1 and toxic = 0")).collect()))
    want = rows()
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", -1)
    assert rows() == want
