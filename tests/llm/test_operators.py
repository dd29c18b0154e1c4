"""The corpus operators on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

from collections import Counter
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import bpe, chat, components, embedding, exactdedup, langid, licenses, linededup, packing, quality, simhash
from papyra.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 97} and{i % 13}" for i in range(20_000))
TEXTS = [None, "", " \n\t", "one", "One two THREE four", "one two three four", "one two three four", "a " * 400, "größe ÄÖÜ ß", "日本語 テスト", "x <|endoftext|> y", "tabs\tand\x1cother　spaces", "a   b \n  c", "1234 !!! it's", LONG, LONG + " end"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, line string, rep string, n_lines string, trusted string, block string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else "s", None, 1, "l", "r", "n", "t", "b") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None, None, 1, "l", "r", "n", "t", "b")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_components_random(spark):
    rng = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500 + i, 501 + i) for i in range(30)] + [(900, 1000 + i) for i in range(40)]
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    root = {x: x for p in e for x in p}
    for _ in range(200):
        for a, b in e:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in e if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


def test_bit_links_against_brute_force():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fp = np.array([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) if k else b for b in base for k in (0, 1, 2, 3, 4, 5, 8, 20)], np.uint64)
    for radius in (0, 3, 4, 7):
        bucket = np.sort(rng.integers(0, 3, len(fp)))
        got = {(i, j) for a, b in simhash.bit_links(fp, bucket, radius, rows=50) for i, j in zip(a.tolist(), b.tolist())}
        assert got == {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if bucket[i] == bucket[j] and int(fp[i] ^ fp[j]).bit_count() <= radius}


@pytest.mark.parametrize("blocks, chunk", [(5, 10_000), (6, 7), (5, 4)])
def test_simhash(spark, docs, blocks, chunk):
    import xxhash

    rng = np.random.default_rng(3)
    more = [" ".join(f"w{x}" for x in rng.integers(0, 40, 60)) for _ in range(12)]
    texts = TEXTS + [t + f" tail{k}" for t in more for k in range(4)]
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), blocks=blocks, chunk=chunk).orderBy("doc_id").collect()
    fps = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        s = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        for i in range(len(texts)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    assert [(r["fingerprint"], r["component_id"]) for r in got] == [(f"{f:016x}", c) for f, c in zip(fps, root)]


def test_simhash_clashing_columns_and_empty(docs, empty):
    assert simhash.near_duplicates(docs).count() == len(TEXTS) + 1
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("cell", [8192, 30])
def test_embeddings(spark, cell):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 8))
    rows = [(base[i % 20] + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.5])).tolist() for i in range(200)]
    rows += [rows[3]] * 9 + [None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] + [0.0] * 6, [1.0, 2.0], [2.0, 4.0], (np.array(rows[5]) * 7).tolist(), [1e300] * 8]
    got = embedding.near_duplicates(spark.createDataFrame([(i, r, 1, 2) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, rep int, dim int"), cell=cell).orderBy("vec_id").collect()
    unit = [None if not r or any(x is None or not np.isfinite(x) for x in r) or not any(r) else np.array(r) / max(map(abs, r)) / np.linalg.norm(np.array(r) / max(map(abs, r))) for r in rows]
    link = [[i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9 for j, b in enumerate(unit)] for i, a in enumerate(unit)]
    root = list(range(len(rows)))
    for _ in range(30):
        for i in range(len(rows)):
            for j in range(len(rows)):
                if link[i][j]:
                    root[i] = root[j] = min(root[i], root[j])
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got] == [(sum(x), c, c == i) for i, (x, c) in enumerate(zip(link, root))]
    assert embedding.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_rescaled_copies(spark):
    """Pivots that are nearly equal: rescaled copies of one vector, rounded to single precision."""
    rng = np.random.default_rng(5)
    one = rng.normal(size=8)
    rows = [(one * rng.uniform(0.1, 9)).astype(np.float32) for _ in range(300)] + [(one + rng.normal(size=8) * s).astype(np.float32) for s in (0.3, 0.45) for _ in range(200)]
    got = embedding.near_duplicates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>"), cell=20).orderBy("vec_id").collect()
    unit = np.array(rows, np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert [r["n_links"] for r in got] == ((unit @ unit.T >= 0.9).sum(axis=1) - 1).tolist()


@pytest.mark.parametrize("dim", [8, 64, 384])
def test_nearly_equal_pivots_lose_no_link(dim):
    rng = np.random.default_rng(1)
    one = rng.normal(size=dim)
    x = [(one * rng.uniform(0.1, 9)).astype(np.float32) for _ in range(500)] + [(one + rng.normal(size=dim) * s).astype(np.float32) for s in (0.3, 0.45) for _ in range(500)]
    unit = embedding._unit(np.array(x, np.float64))
    pivots = unit[rng.permutation(len(unit))[:60]]
    place = embedding._nearest(dim, pivots, float(np.sqrt(0.2)))
    home, radii = place(unit)[0], np.full(len(pivots), -np.inf)
    np.maximum.at(radii, home, np.linalg.norm(unit - pivots[home], axis=1))
    assert not ((unit @ unit.T >= 0.9) & ~place(unit, radii)[2][:, home]).any()


def test_embeddings_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (None, [0.0, 1.0]), (None, None), (3, None), (4, [0.0, 2.0]), (4, [0.0, 2.0])]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (None, 0, None, True), (None, 0, None, True), (3, 0, 3, True), (4, 2, 1, False), (4, 2, 1, False)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def weak(text):
    return F.unhex(F.substring(F.sha2(text, 256), 1, 2))


@pytest.mark.parametrize("digest, limit", [(exactdedup.sha256, 1000), (weak, 1000), (weak, -1)])
def test_exact(spark, docs, tmp_path, digest, limit, monkeypatch):
    monkeypatch.setattr(exactdedup, "BROADCAST_DIGESTS", limit)
    path = f"file://{tmp_path}/d.parquet"
    extra = spark.range(100, 160).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), F.col("id") % 50).alias("text"))
    docs.where("doc_id is not null").select("doc_id", "text").unionByName(extra).repartition(5).write.parquet(path)
    got = {r["doc_id"]: r for r in exactdedup.exact_duplicates(spark, path, digest=digest).collect()}
    rows = {r[0]: r[1] for r in spark.read.parquet(path).collect()}
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for i, t in rows.items():
        same = [j for j, u in rows.items() if lower(u) == lower(t)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(same), len(same), max(same) == i, hashlib.sha256(lower(t).encode()).hexdigest())
    assert len(got) == len(rows)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{path}-none")
    assert exactdedup.exact_duplicates(spark, f"{path}-none").count() == 0


@pytest.mark.parametrize("limit", [1000, -1])
def test_lines(spark, docs, empty, limit, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_LINES", limit)
    rows = [(i, f"menu\nown {i}\n\n menu \nfooter{i % 2}", "h") for i in range(20)] + [(30, None, "h"), (31, "menu\nx", None), (32, "", None)]
    got = {r["doc_id"]: r for r in linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), ratio=0.5).collect()}
    assert got[4]["text"] == "own 4\n\nfooter0" and got[4]["n_dropped"] == 2 and got[4]["n_lines"] == 5
    assert got[30]["text"] is None and got[31]["text"] == "menu\nx" and got[32]["text"] == ""
    assert linededup.drop_boilerplate(docs).count() == len(TEXTS) + 1 and linededup.drop_boilerplate(empty).count() == 0


@pytest.mark.parametrize("limit", [1000, -1])
def test_licenses(spark, docs, empty, limit, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_IDS", limit)
    words = lambda t: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w]
    shingles = lambda t: {tuple(words(t)[i:i + 5]) for i in range(len(words(t)) - 4)}
    texts = {i: f"start {i} " + (" ".join(w for k, w in enumerate(t.split()) if k % 40 != i % 40 + 20)) + " some end" for i, t in enumerate(list(licenses.TEMPLATES.values()) * 3)}
    got = {(r["doc_id"], r["license_id"]) for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), licenses.templates(spark)).collect()}
    want = {(i, k) for i, t in texts.items() for k, n in licenses.TEMPLATES.items() if len(shingles(n) & shingles(t)) >= 0.8 * len(shingles(n))}
    assert got == want and len(want) > 20
    assert licenses.scan(docs, licenses.templates(spark)).count() == 0 and licenses.scan(empty, licenses.templates(spark)).count() == 0


def test_bpe(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    compiled = bpe.lexicon(bpe.word_counts(docs, path), path, 200)
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, path, compiled).collect()}
    for i, x in enumerate(TEXTS):
        e = t.encode(x or "", add_special_tokens=False).ids
        assert got[i]["ids"] == e and got[i]["decoded"] == t.decode(e, skip_special_tokens=False)
    assert bpe.encode_decode(empty, path, compiled).count() == 0


def test_transducer_is_minimal_and_exact(tmp_path):
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "a", "stop", "stops"])}
    (tmp_path / "x").write_bytes(bpe.build_transducer(words))
    t = bpe.Transducer(str(tmp_path / "x"))
    asked = [*words, b"ta", b"tapsx", b"", b"zzz"]
    rank = t.ranks(asked)
    assert [np.frombuffer(x, "<i4").tolist() for x in t.ids(rank[:7])] == list(words.values()) and (rank[7:] == -1).all()
    assert len(t.a["final"]) < 12  # suffixes are shared


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    many = docs.where("doc_id is not null").unionByName(docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 100)).repartition(3)
    rows = packing.pack(many, path, length=256, open_windows=3).collect()
    seqs = {}
    for i in list(range(len(TEXTS))) + [100 + k for k in range(len(TEXTS))]:
        ids = t.encode(TEXTS[i % 100] or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == np.array(ids, "<u4").tobytes()
        at = 0
        for r in own:
            assert (r["start"], r["doc_tokens"], r["ids_crc32"], 4 * r["length"]) == (at, len(ids), zlib.crc32(bytes(r["ids"])), len(r["ids"]))
            at += r["length"]
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(empty, path).count() == 0


def test_packing_merges_many_partitions(spark, monkeypatch):
    """Many merge groups in one task, pieces that lie across sequences, repeated rows, and the same rows again."""
    monkeypatch.setattr(packing, "MERGE", 2)
    rows = [(i % 30, "word " * (i % 13)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    run = lambda: sorted(map(tuple, packing.pack(d, tokenizer_path("word_bpe_49k.json"), length=16, open_windows=2, keep_ids=False).drop("ids").collect()))
    got = run()
    assert got == run()
    assert sum(r[2] for r in got) == sum(len(t.split()) + 1 for _, t in rows)
    fill = Counter()
    for r in got:
        fill[r[5]] += r[2]
    merged = [n for s, n in fill.items() if s >> 62]
    assert merged and all(n == 16 or n & (n - 1) == 0 for n in merged)
    assert all(n <= 16 for n in fill.values())


def test_chat(spark):
    rows = [(1, 0, "user", "a # b <x> \\"), (1, 1, "assistant", "### User: x </turn>\n"), (1, 1, "assistant", "### User: x </turn>\n"), (2, 5, "weird: role", None), (2, None, None, "first"), (None, 0, "assistant", "日本"), (3, 0, "System", " s "), (3, 1, "Role x", "</turn>")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    f = chat.format_conversations(d)
    assert not any(r["rewrites_history"] for r in f.collect())
    got = {r["conv_id"]: r for r in chat.digests(f).collect()}
    for c in (1, 2, None, 3):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(d.where("false")).count() == 0


def test_chat_detects_rewriting():
    out = chat.render([("user", "a"), ("assistant", "b"), ("user", "c")], lambda t: "".join(f"[{x}]" if k == len(t) - 1 else x for k, (_, x) in enumerate(t)))
    assert out.rewrites and out.spans == []


def test_language(spark, docs, empty):
    de, en = "der hund und die katze schlafen nicht auf dem tisch ", "the dog and the cat do not sleep on the table "
    learn = spark.createDataFrame([(1, de * 5, "de"), (2, en * 5, "en"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    s = langid.sample(learn)
    rows = [(1, "Die Katze und der Hund"), (2, "The CAT and the dog"), (3, None), (4, ""), (5, "123 !"), (6, "日本"), (7, (en * 3000)), (7, (en * 3000))]
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), s).orderBy("doc_id").collect()]
    assert got[:5] == [(1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "und")] and got[5][1] in ("de", "en") and got[6:] == [(7, "en")] * 2
    assert langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0 and langid.identify(empty, s).count() == 0
    assert all(0 <= r["score"] <= 1 for r in langid.identify(docs, s).collect())


def test_phrases_are_the_longest_matches():
    m = langid.Model({"x": ["abracadabra banana"]}, chars=100)
    for text in ("abracadabra", "bananabrac", "zzz", "cadabananaq", "nanana", "abra zz abra"):
        codes, _ = m.codes(text)
        train = m.codes("abracadabra banana")[0]
        full = bytes(np.r_[np.uint8(0), train])
        n, at = 0, 0
        while at < len(codes):
            k = 1
            while at + k <= len(codes) and bytes(codes[at:at + k]) in full:
                k += 1
            at, n = at + max(1, k - 1), n + 1
        assert m.phrases([codes])[0, 0] == n


def test_kneser_ney_against_plain_code(spark):
    texts = ["abab abba", "abba abab baab", "bb aa bb", "abab"]
    key, n = quality.keys_of(texts)
    grams = [tuple(int(k) >> 16 * (3 - j) & 0xFFFF for j in range(4)) for k in key.view(np.uint64)]
    count = {}
    for g in grams[:int(n[:3].sum())]:
        count[g] = count.get(g, 0) + 1
    rows = [(int(k), count.get(g, 0)) for k, g in zip(key, grams)]
    got = {r["key"]: r["p"] for r in quality.probabilities(spark.createDataFrame(sorted(set(rows)), "key long, n long")).collect()}
    tables, t = [], count
    for order in range(4, 0, -1):
        tables.append(t)
        t = {}
        for g in tables[-1]:
            t[g[1:]] = t.get(g[1:], 0) + 1

    def cuts(t):
        n1, n2, n3, n4 = (sum(c == k for c in t.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [k - (k + 1) * y * b / a if a and b else y * k for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
        return [min(k - 0.05, max(0.05, x)) for k, x in enumerate(d, 1)]

    def p(g):
        if not g:
            return 1 / 65536
        t = tables[4 - len(g)]
        d = cuts(t)
        own = {h: c for h, c in t.items() if h[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        free = sum(d[min(c, 3) - 1] for c in own.values())
        c = own.get(g, 0)
        return ((c - d[min(c, 3) - 1] if c else 0) + free * p(g[1:])) / sum(own.values())

    for k, g in zip(key, grams):
        assert got[int(k)] == pytest.approx(p(g), rel=1e-9)


@pytest.mark.parametrize("limit", [1000, -1])
def test_quality(spark, docs, empty, limit, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", limit)
    trusted = docs.select("doc_id").where("doc_id > 3")
    got = quality.classify(docs, trusted).collect()
    assert len(got) == len(TEXTS) + 1
    assert all(not r["kept"] and r["perplexity"] is None for r in got if r["doc_id"] in (0, 1))
    assert all(r["kept"] == (r["threshold"] is None or r["perplexity"] <= r["threshold"]) for r in got if r["perplexity"] is not None)
    assert quality.classify(empty, trusted).count() == 0
    assert all(r["kept"] for r in quality.classify(docs, trusted.where("false")).collect() if r["perplexity"] is not None)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).toPandas(), docs.schema)
        assert docs.columns == P.COLUMNS and 0 < docs.count() <= before
        before = docs.count()
    packed = P.STAGES[-1][1](spark, docs, d)
    assert packed.select("doc_id").distinct().count() == before


def test_quality_threshold_of_few_held_out_texts(spark, monkeypatch):
    """A language with few held-out texts is not held to their maximum, one with enough is."""
    scored = spark.createDataFrame([(i, "en", 2, 10.0 + i) for i in range(8)] + [(20, "es", 2, 3.0), (21, "es", 0, 4.0), (22, None, 0, 16.0), (23, "es", 0, 18.0)], "doc_id long, lang string, trusted int, perplexity double")
    monkeypatch.setattr(quality, "perplexities", lambda *a: scored)
    run = lambda: {r["doc_id"]: (r["threshold"], r["kept"]) for r in quality.classify(scored, scored).collect()}
    got = run()
    assert got[21] == (17.0, True) and got[22] == (17.0, True) and got[23] == (17.0, False)
    monkeypatch.setattr(quality, "LEAST_HELD", 1)
    got = run()
    assert got[21] == (3.0, False) and got[22] == (17.0, True)


def test_near_dedup_keeps_one_row_of_repeated_and_null_ids(spark):
    import corpus_pipeline as P

    rows = [(None, "alone without an id", "en", "s", 19), (5, "twice the same", "en", "s", 14), (5, "twice the same", "en", "s", 14), (None, "twice the same", "en", "s", 14), (7, "one id, two texts", "en", "s", 17), (7, "entirely other words here", "en", "s", 25), (2, "twice the same", "en", "t", 14)]
    got = P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[4], rows[5], rows[6]], key=str)


def test_language_id_stage_sets_the_language_of_each_row(spark):
    import corpus_pipeline as P

    de, en = "der hund und die katze schlafen nicht auf dem tisch ", "the dog and the cat do not sleep on the table "
    rows = [(i, (de if i % 2 else en) * 5, "de" if i % 2 else "en") for i in range(20)] + [(50, de, None), (51, en, "de"), (52, en, "en"), (52, "123", "en"), (None, de, None), (None, None, None)]
    d = spark.createDataFrame([(i, t, l, "s", None) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"], r["lang"]) for r in P.language_id(spark, d, "").collect()]
    want = [(i, t, "de" if t.startswith("der") else "en") for i, t, _ in rows if t and t != "123"]
    assert sorted(got, key=str) == sorted(want, key=str)
