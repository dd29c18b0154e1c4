"""Potential duplicates: documents whose mean similarity of title, correspondent and created is 90 or more.

Null counts as the text ``none``, as in the reference. Documents alike in all three fields are one class. Two classes
can only reach the mean if correspondent and created together leave the title at most 100 to make up for; the titles
of such senders and dates are compared in chunks, all with all, by common letters, their order and bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import written
from ..functions.similarity import indel_ratio, lcs, like_length

LEAST = 90.0
FIELDS = ["title", "correspondent", "created"]
#: Names of a length that a task compares with as many others.
CHUNK = 8192
#: Classes of one sender and date that a task compares with as many others: the more at once, the less a pair costs. From a quarter of them on they are up to three chunks, for several tasks.
CLASSES = 65536
#: Sums of ratios are rational: two of them differ by more than this, or are equal.
_EPS = 1e-9
_BITS = 64
#: Up to so many texts that letters don't tell from one are compared together with those of others.
_FEW = 256
#: The first bits of 32, by their number; all from 32 on, also for texts whose bits don't hold all: what they lack is added elsewhere.
_LOW = ((np.uint64(1) << np.arange(33, dtype=np.uint64)) - np.uint64(1)).astype(np.uint32)
#: Texts of like letters that are told apart from others together.
_BLOCK = 64
#: Texts times characters that are held as bits at once: 8 bytes for each.
_CELLS = 12_000_000
#: Beyond this ratio, blocks leave out most texts.
_FAR = 85.0
#: Characters of a text, on average, whose order is looked at first: most texts then have them in 32 bits.
_ORDERED = 27


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and each text's length."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat, np.array([len(t) for t in texts], np.int64)


def _frequent(flat: np.ndarray) -> np.ndarray:
    """The most frequent characters, in order."""
    alphabet, often = np.unique(flat, return_counts=True)
    return alphabet[np.argsort(-often, kind="stable")[:_BITS]]


def _counted(common: np.ndarray, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each text has each of some characters."""
    width = len(common)
    order = np.argsort(common)
    at = np.minimum(np.searchsorted(common, points, sorter=order), max(0, width - 1))
    code = order[at] if width else at
    held = common[code] == points if width else np.zeros(len(points), bool)
    text = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(text[held] * width + code[held], minlength=len(lengths) * width).reshape(len(lengths), width)


def _levels(flat: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """The characters of ``flat`` in two parts, of which the first is returned: the most frequent ones, as their order tells most. For each part a word of bits
    for each text of the one and of the other list, whether it reaches certain counts of its characters, and how many of its characters these leave out: the bits
    in common, and the lesser rest, are at least the number of the part's characters in common. The second part has all other characters too."""
    common = _frequent(flat)
    width = len(common)
    x, y = _counted(common, flat, n), _counted(common, other, m)
    cut = max(1, int((np.cumsum(x.mean(axis=0)) <= _ORDERED).sum())) if len(x) else 1
    out = []
    for part in (slice(0, cut), slice(cut, width)):
        levels = [(c, k, r) for c in range(width)[part] for k in range(1, int(x[:, c].max(initial=0)) + 1) if (r := float((x[:, c] >= k).mean())) >= 1 / 200]
        levels = sorted(levels, key=lambda v: -v[2] * (1 - v[2]))[:_BITS]  # those that half of the texts reach tell most
        cols, least = (np.array([v[i] for v in levels], np.int64) for i in (0, 1))
        for z, lengths in ((x, n), (y, m)):
            there = np.zeros((len(z), _BITS), bool)
            there[:, :len(cols)] = z[:, cols] >= least
            size = z[:, :cut].sum(axis=1) if part.start == 0 else lengths - z[:, :cut].sum(axis=1)
            out += [np.packbits(there, axis=1).view(np.uint64).ravel(), (size - there.sum(axis=1)).astype(np.int32)]
    return common[:cut], [tuple(out[:4]), tuple(out[4:])]


def _places(counts: np.ndarray) -> np.ndarray:
    """An order in which texts of like counts lie in blocks: halved by the count that varies most, again and again."""
    out, todo = [], [np.arange(len(counts))]
    while todo:
        at = todo.pop()
        if len(at) <= _BLOCK:
            out.append(at)
            continue
        half = -(-len(at) // (2 * _BLOCK)) * _BLOCK  # whole blocks
        by = counts[at]
        sorted_at = at[np.argsort(by[:, int(by.var(axis=0).argmax())], kind="stable")]
        todo += [sorted_at[half:], sorted_at[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _apart(counts: np.ndarray, block: np.ndarray) -> np.ndarray:
    """In how many letters a text, a column of ``counts``, differs from any of a block at least."""
    out = np.zeros(counts.shape[1], counts.dtype)
    d = np.empty_like(out)
    for x, lo, hi in zip(counts, block.min(axis=1), block.max(axis=1)):
        np.maximum(x, hi, d)
        out += np.subtract(d, hi, d)
        np.minimum(x, lo, d)
        out += np.subtract(lo, d, d)
    return out


def _in_bits(code: np.ndarray, n: np.ndarray, chosen: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Of the texts of ``code``, the first 32 chosen characters: for each where it stands, as bits; and how many chosen characters a text has."""
    text = np.repeat(np.arange(len(n)), n)
    held = chosen[code]
    code, text = code[held], text[held]
    size = np.bincount(text, minlength=len(n))
    pos = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    fits = pos < 32
    bits = np.zeros((len(chosen), len(n)), np.uint32)
    np.bitwise_or.at(bits, (code[fits], text[fits]), np.uint32(1) << pos[fits].astype(np.uint32))
    return {int(c): bits[c] for c in np.flatnonzero(chosen)}, size


def title_links(a: list[str], b: list[str], least: float, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``p, q, ratio`` of all pairs ``a[p], b[q]`` with an indel ratio of ``least``; ``own``: of one list, p < q only.

    Texts lie in blocks of like letters; blocks whose counts differ too much don't meet. Pairs are left out by common letters, then by the order of the frequent ones,
    then by that of the others beside it; what is left is compared."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not a or not b:
        return none
    if len(a) < len(b) and not own:  # many at once with each
        q, p, ratio = title_links(b, a, least)
        return p, q, ratio
    if len(a) > 1 and len(a) * len(set().union(*a)) > _CELLS:  # many characters: fewer texts at once
        half = len(a) // 2
        parts = [(a[:half], a[:half] if own else b, own, 0, 0), (a[half:], a[half:] if own else b, own, half, half if own else 0)]
        parts += [(a[:half], a[half:], False, 0, half)] if own else []
        out = [(p + i, q + j, ratio) for x, y, same, i, j in parts for p, q, ratio in [title_links(x, y, least, same)]]
        return tuple(np.concatenate(x) for x in zip(*out))
    # the order of blocks
    sides = []
    common = _frequent(_points(a)[0])[:_BITS // 2]
    small = np.uint8 if max(map(len, a)) <= 120 and max(map(len, b)) <= 120 else np.int32  # sums of two lengths fit
    for x in (a,) if own else (a, b):
        flat, n = _points(x)
        counts = _counted(common, flat, n)
        counts = np.column_stack([counts, n - counts.sum(axis=1)]).astype(small)
        up = _places(counts)
        sides.append((up, [x[i] for i in up], n[up], np.ascontiguousarray(counts[up].T)))
    (up, ta, la, ca), (ub, tb, lb, cb) = sides[0], sides[-1]
    longest = int(la.max())
    # where each character stands: in texts of a that fit a word, and among the first and the other characters
    flat, other = _points(ta)[0], _points(tb)[0]
    alphabet, code = np.unique(flat, return_inverse=True)
    fits_word = la <= _BITS
    short = np.where(fits_word, la, 0)
    held = np.repeat(fits_word, la)
    pos = np.arange(int(short.sum())) - np.repeat(np.cumsum(short) - short, short)
    bits = np.zeros((len(alphabet) + 1, len(ta)), np.uint64)  # the last row: characters that a has not
    np.bitwise_or.at(bits, (code[held], np.repeat(np.arange(len(ta)), short)), np.uint64(1) << pos.astype(np.uint64))
    # the rows of each text of b
    at = np.minimum(np.searchsorted(alphabet, other), max(0, len(alphabet) - 1))
    at = np.where(alphabet[at] == other, at, len(alphabet)) if len(alphabet) else np.zeros(len(other), np.int64)
    start = np.cumsum(lb) - lb
    codes = np.full((len(tb), _BITS), len(alphabet))
    fits = np.repeat(lb <= _BITS, lb)
    codes[np.repeat(np.arange(len(tb)), lb)[fits], (np.arange(len(other)) - np.repeat(start, lb))[fits]] = at[fits]
    first, ((x1, rest_x1, y1, rest_y1), (x2, rest_x2, y2, rest_y2)) = _levels(flat, la, other, lb)
    rest_x1, rest_x2, rest_y1, rest_y2 = (x.astype(small) for x in (rest_x1, rest_x2, rest_y1, rest_y2))
    in_first = np.isin(alphabet, first)
    (rows_1, size_1), (rows_2, size_2) = (_in_bits(code, la, chosen) for chosen in (in_first, ~in_first))
    over_1, over_2 = (np.maximum(z - 32, 0).astype(small) for z in (size_1, size_2))
    size_1 = size_1.astype(np.int32)
    needed: dict[int, tuple[np.ndarray, ...]] = {}  # by the length of a text of b: characters in common, also without those that bits don't hold, and how many of the first may lack
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(p: np.ndarray, q: np.ndarray, common: np.ndarray) -> None:
        total = la[p] + lb[q]
        score = np.where(total == 0, 100.0, 200.0 * common / np.maximum(total, 1))
        ok = score >= least - _EPS
        if ok.any():
            i, j = up[p[ok]], ub[q[ok]]
            found.append((np.minimum(i, j), np.maximum(i, j), score[ok]) if own else (i, j, score[ok]))

    def few(p: np.ndarray, q: np.ndarray) -> None:
        v = np.full(len(p), ~np.uint64(0))
        for c in range(int(lb[q].max())):
            u = v & bits[codes[q, c], p]
            v = (v + u) | (v - u)
        keep(p, q, np.bitwise_count(~v).astype(np.int64))

    def in_order(here: dict[int, np.ndarray], rows: list[int], v: np.ndarray) -> np.ndarray:
        """Goes on with the longest common subsequences of texts and the characters of some rows: what is in common is a bit that isn't set."""
        u, w = np.empty_like(v), np.empty_like(v)
        for i in rows:
            np.bitwise_and(v, here[i], u)
            np.subtract(v, u, w)
            np.add(v, u, v)
            np.bitwise_or(v, w, v)
        return v

    def first_in_order(p: np.ndarray, rows: list[int], need: np.ndarray, lack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the texts ``p`` may have so many of the first characters in common, and how many: at most ``lack`` of theirs aren't."""
        here = {i: rows_1[i].take(p) for i in set(rows)}
        half = len(rows) // 2
        v = in_order(here, rows[:half], np.full(len(p), ~np.uint32(0)))
        # what the first half of the characters has in common lies at most that far behind
        within = np.bitwise_count(~v & _LOW.take(lack + half, mode="clip"))
        ok = np.flatnonzero(within + np.uint8(len(rows) - half) >= need)
        v = in_order({i: x.take(ok) for i, x in here.items()}, rows[half:], v.take(ok))
        score = np.bitwise_count(np.invert(v, v))
        there = np.flatnonzero(score >= need.take(ok))
        return ok.take(there), score.take(there)

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    n_waiting = 0
    every = np.arange(len(ta))
    held = cand, cx1, cx2, crest1, crest2, cla, csize, cover = every, x1, x2, rest_x1, rest_x2, la, size_1, over_1
    word, share = np.empty_like(x1), np.empty(len(ta), np.uint8)
    for begin in range(0, len(tb), _BLOCK):
        end = min(begin + _BLOCK, len(tb))
        if least > _FAR:
            # the texts that differ in few letters from any of the block
            cand = np.flatnonzero(_apart(ca, cb[:, begin:end]) <= (longest + int(lb[begin:end].max())) * (1 - least / 100) + 1e-6)
            cand, cx1, cx2, crest1, crest2, cla, csize, cover = (z.take(cand) for z in held)
            needed.clear()
        for j in range(begin, end):
            # of one list: each text with those after it
            since = int(np.searchsorted(cand, j, "right")) if own else 0
            if since >= len(cand):
                continue
            if int(lb[j]) not in needed:
                if len(needed) >= _BITS:
                    needed.clear()
                least_common = np.maximum(np.ceil((least - _EPS) / 200 * (cla + lb[j]) - _EPS), 0)
                needed[int(lb[j])] = least_common.astype(small), np.maximum(least_common - cover, 0).astype(small), (csize - least_common).astype(np.int32)
            enough, in_bits, spare = needed[int(lb[j])]
            w, s = word[since:len(cand)], share[since:len(cand)]
            second = np.minimum(crest2[since:], rest_y2[j])
            second += np.bitwise_count(np.bitwise_and(cx2[since:], y2[j], w), s)
            common = np.minimum(crest1[since:], rest_y1[j])
            common += np.bitwise_count(np.bitwise_and(cx1[since:], y1[j], w), s)
            common += second
            left = np.flatnonzero(common >= enough[since:])
            if not len(left):
                continue
            p = cand[since:].take(left)
            rows = at[start[j]:start[j] + lb[j]]
            rows = rows[rows < len(alphabet)]
            if len(p) > _FEW:
                # the frequent letters in order leave out most of what is left
                beside = second.take(left)
                need = in_bits[since:].take(left)
                need -= np.minimum(need, beside)
                one, two = ([i for i in rows.tolist() if i in of] for of in (rows_1, rows_2))
                ok, ordered = first_in_order(p, one, need, spare[since:].take(left) + beside)
                p = p.take(ok)
                if len(p) > _FEW:
                    v = in_order({i: rows_2[i].take(p) for i in set(two)}, two, np.full(len(p), ~np.uint32(0)))
                    p = p[ordered.astype(np.int32) + np.bitwise_count(~v) + over_2.take(p) >= in_bits[since:].take(left.take(ok))]
            if not fits_word[p].all():
                long = p[~fits_word[p]]
                p = p[fits_word[p]]
                keep(long, np.full(len(long), j), np.array([lcs(ta[i], tb[j]) for i in long], np.int64))
            if lb[j] > _BITS or len(p) > _FEW:
                here = {i: bits[i].take(p) for i in set(rows.tolist())}
                keep(p, np.full(len(p), j), np.bitwise_count(~in_order(here, rows.tolist(), np.full(len(p), ~np.uint64(0)))).astype(np.int64))
            elif len(p):
                waiting.append((p, np.full(len(p), j)))
                n_waiting += len(p)
                if n_waiting >= 1 << 15:
                    few(*map(np.concatenate, zip(*waiting)))
                    waiting, n_waiting = [], 0
    if waiting:
        few(*map(np.concatenate, zip(*waiting)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else none


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    rest, own = float(rows["rest"].iloc[0]), bool(rows["own"].iloc[0])
    a = rows[rows["side"] == 0]
    b = a if own else rows[rows["side"] == 1]
    least = 3 * LEAST - rest
    # pairs of two that aren't fresh are known
    new, old = a[a["fresh"]], a[~a["fresh"]]
    tasks = [(new, new, True), (new, old, False)] if own else [(new, b, False), (old, b[b["fresh"]], False)]
    found = []
    for x, y, same in tasks:
        if len(x) and len(y):
            p, q, ratio = title_links(x["title"].tolist(), y["title"].tolist(), least, same)
            one, two, n, m = x["id"].to_numpy()[p], y["id"].to_numpy()[q], x["n"].to_numpy()[p], y["n"].to_numpy()[q]
            turn = one > two
            found.append(pd.DataFrame({"id1": np.where(turn, two, one), "id2": np.where(turn, one, two), "n1": np.where(turn, m, n), "n2": np.where(turn, n, m), "score": (ratio + rest) / 3}))
    return pd.concat(found) if found else pd.DataFrame({"id1": [], "id2": [], "n1": [], "n2": [], "score": []})


def _fields(docs: DataFrame) -> DataFrame:
    text = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("none"))).alias(c)
    return docs.select("document_id", *[text(c) for c in FIELDS])


def classes(docs: DataFrame) -> DataFrame:
    """``title, correspondent, created, id, n``: documents alike in the three fields, named by the least id."""
    return _fields(docs).groupBy(*FIELDS).agg(F.min("document_id").alias("id"), F.count("*").alias("n"))


def members(docs: DataFrame, c: DataFrame) -> DataFrame:
    """``document_id, id, n``: each document's class among those of ``classes``."""
    return _fields(docs).join(c, FIELDS).select("document_id", "id", "n")


def links(c: DataFrame, chunk: int = CLASSES) -> DataFrame:
    """``title, correspondent, created, id, n, fresh``, a row for each class, to ``id1, id2, n1, n2, score``: pairs of classes of a mean of
    90 of which at least one is fresh."""
    places = c.groupBy("correspondent", "created").agg(F.count("*").alias("of"))
    places = places.select("correspondent", "created", F.greatest(F.ceil(F.col("of") / chunk), F.least(F.ceil(F.col("of") * 4 / chunk), F.lit(3))).cast("int").alias("parts"))
    dealt = c.join(places, ["correspondent", "created"]).withColumn("part", F.pmod(F.xxhash64("title"), F.col("parts")).cast("int"))
    has = dealt.groupBy("correspondent", "created", "parts", "part").agg(F.max("fresh").alias("any"))
    side = lambda k: has.select(F.col("correspondent").alias(f"c{k}"), F.col("created").alias(f"d{k}"), F.col("part").alias("ij"[k - 1]), F.col("any").alias(f"any{k}"))
    place = lambda k: places.select(F.col("correspondent").alias(f"c{k}"), F.col("created").alias(f"d{k}"))
    order: Column = F.struct("c1", "d1") <= F.struct("c2", "d2")
    met = place(1).crossJoin(place(2)).where(order & like_length(F.col("c1"), F.col("c2"), 70.0) & like_length(F.col("d1"), F.col("d2"), 70.0))
    met = met.withColumn("rest", indel_ratio(F.col("c1"), F.col("c2")) + indel_ratio(F.col("d1"), F.col("d2"))).where(F.col("rest") >= 3 * LEAST - 100 - _EPS)
    same = (F.col("c1") == F.col("c2")) & (F.col("d1") == F.col("d2"))
    met = met.join(side(1), ["c1", "d1"]).join(side(2), ["c2", "d2"]).where(F.col("any1") | F.col("any2")).drop("any1", "any2")
    met = met.where(~same | (F.col("i") <= F.col("j"))).withColumn("own", same & (F.col("i") == F.col("j")))
    key = ["c1", "d1", "c2", "d2", "i", "j"]

    def sent(k: int, chunk_of: str, tasks: DataFrame) -> DataFrame:
        on = (F.col("correspondent") == F.col(f"c{k}")) & (F.col("created") == F.col(f"d{k}")) & (F.col("part") == F.col(chunk_of))
        return dealt.join(tasks, on).select(*key, "rest", "own", F.lit(k - 1).alias("side"), "title", "id", "n", "fresh")

    both = sent(1, "i", met).unionByName(sent(2, "j", met.where("not own")))
    kind = c.schema["id"].dataType.simpleString()
    return both.groupBy(*key).applyInPandas(_compared, f"id1 {kind}, id2 {kind}, n1 long, n2 long, score double")


def _pairs(c: DataFrame, chunk: int = CLASSES) -> DataFrame:
    pairs = links(c.withColumn("fresh", F.lit(True)), chunk)
    return pairs.unionByName(c.where("n > 1").select(F.col("id").alias("id1"), F.col("id").alias("id2"), F.col("n").alias("n1"), F.col("n").alias("n2"), F.lit(100.0).alias("score")))


def class_pairs(docs: DataFrame, chunk: int = CLASSES) -> DataFrame:
    """``id1, id2, n1, n2, score``: pairs of classes of a mean of 90; a class of several documents is a pair with itself."""
    return _pairs(written(classes(docs), "classes"), chunk)


def duplicates(docs: DataFrame) -> DataFrame:
    """The class pairs, and a row for each document with its class as ``id1``: ``document_id`` is null on the pairs."""
    c = written(classes(docs), "classes")
    pairs = _pairs(c).withColumn("document_id", F.lit(None).cast("long"))
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    return pairs.unionByName(members(docs, c).select(F.col("id").alias("id1"), none("long", "id2"), F.col("n").alias("n1"), none("long", "n2"), none("double", "score"), "document_id"))


def later_duplicates(docs: DataFrame) -> DataFrame:
    """``document_id, pairs``: pairs of documents in which the document is the first, where there are any.

    The documents of a class pair are not paired: those of the other class with a larger id are counted in order.
    """
    c = written(classes(docs), "classes")
    of = written(members(docs, c), "members")
    both = F.array(F.struct(F.col("id1").alias("id"), F.col("id2").alias("other")), F.struct(F.col("id2").alias("id"), F.col("id1").alias("other")))
    near = _pairs(c).select(F.explode(F.when(F.col("id1") == F.col("id2"), F.slice(both, 1, 1)).otherwise(both)).alias("p")).select("p.id", "p.other")
    asked = of.join(near, "id").select(F.col("other").alias("id"), "document_id", F.lit(0).alias("one"))
    there = of.select("id", "document_id", F.lit(1).alias("one"))
    counted = asked.unionByName(there).selectExpr("*", "sum(one) over (partition by id order by document_id desc range between unbounded preceding and current row) - "
                                                  "sum(one) over (partition by id, document_id) as later")
    return counted.where("one = 0").groupBy("document_id").agg(F.sum("later").alias("pairs")).where("pairs > 0")


def similar_names(names: DataFrame, least: float, chunk: int = CHUNK) -> DataFrame:
    """``name`` to all pairs ``a, b, score`` (a < b) of distinct names with an indel ratio of ``least`` or more.

    Names of a length lie in parts; only parts whose lengths allow the ratio meet, each two of them in a task.
    """
    d = names.where("name is not null").select("name").distinct().withColumn("n", F.length("name"))
    places = d.groupBy("n").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = d.join(places.select("n", "parts").distinct(), "n").withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")).select("name", "n", "part")
    one, two = places.select(F.col("n").alias("n1"), F.col("part").alias("i")), places.select(F.col("n").alias("n2"), F.col("part").alias("j"))
    met = one.join(two, ((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("i") <= F.col("j")))) & (F.col("n1") >= F.col("n2") * (least / (200 - least)) - _EPS))
    met = met.withColumn("own", (F.col("n1") == F.col("n2")) & (F.col("i") == F.col("j")))
    key = ["n1", "i", "n2", "j"]

    def sent(n: str, part: str, side: int, tasks: DataFrame) -> DataFrame:
        return dealt.join(tasks, (F.col("n") == F.col(n)) & (dealt["part"] == F.col(part))).select(*key, "own", F.lit(side).alias("side"), "name")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a = rows.loc[rows["side"] == 0, "name"].tolist()
        own = bool(rows["own"].iloc[0])
        b = a if own else rows.loc[rows["side"] == 1, "name"].tolist()
        p, q, score = title_links(a, b, least, own) if a and b else ([], [], [])
        x, y = [a[k] for k in p], [b[k] for k in q]
        least_of, most_of = (pd.Series([f(u, v) for u, v in zip(x, y)], dtype=object) for f in (min, max))
        return pd.DataFrame({"a": least_of, "b": most_of, "score": pd.Series(score, dtype="float64")})

    both = sent("n1", "i", 0, met).unionByName(sent("n2", "j", 1, met.where("not own")))
    return both.groupBy(*key).applyInPandas(run, "a string, b string, score double").where(F.col("score") >= least)
