"""Spelling variants: words of a vocabulary that differ by one inserted, deleted or replaced code point.

A trie self-join with active-node sets (Wang, Feng and Li 2010). Two words at distance one agree before the edit and
after it, so of a pair whose shorter word has l code points either the first l // 2 or the last l - l // 2 agree. Tries
over words and over reversed words are therefore partitioned by these prefixes, for each l: every word goes to at
most four tries, each of which lies in one task. A level at a time, the pairs of nodes at distance one (a node's active
nodes) are carried down to children of the same character, joined by siblings (a replaced code point) and by
children (an inserted one); pairs of nodes that both end words are the result. A prefix that more than ``MOST``
words share is not joined in one task: its words go to the tries of longer prefixes, and the pairs that differ
in between, which agree in all but one given place, are joined by what is left of them without it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._common import partitions, rarely_collect, strings, unwritten, written

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A word's form is at least so many times as frequent.
RATIO = 5
#: Words of a trie that one task joins; beyond it, prefixes grow by ``STEP`` code points.
MOST = 100_000
STEP = 6
#: Distinct words that a task counts before it sends them on, bytes of a text that are cut into words at a time, and words of the tries joined in step.
HELD, PIECE, ROWS = 200_000, 1 << 20, 50_000
#: A run at whose CRC-32 this number divides loses a code point.
DAMAGE = 199

_OTHER = re.compile(r"[^A-Za-z\u00C0-\u00FF]")
#: Latin-1 bytes to lower case (A to Z only); those outside the runs are blanks.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _pieces(text: str, size: int) -> Iterator[list[bytes]]:
    """The lower-cased runs of a text, as Latin-1 bytes, a part of the text at a time."""
    at = 0
    while at < len(text):
        to = at + size
        if to < len(text):  # a run isn't cut
            m = _OTHER.search(text, to)
            to = m.start() if m else len(text)
        yield text[at:to].encode("latin-1", "replace").translate(_LETTERS).split()
        at = to


def damaged(doc_id: int | None, run: bytes) -> bytes:
    """A lower-cased run, without one code point if 199 divides its CRC-32 beside the document's id."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode() + run.decode("latin-1").encode())
    return run[:h % len(run)] + run[h % len(run) + 1:] if h % DAMAGE == 0 else run


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the words of all texts with their occurrences, counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarely_collect()
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for words in _pieces(text or "", PIECE):
                    for w, n in Counter(words).items():
                        if len(w) >= least_length:  # a run that is shorter only gets shorter
                            h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                            if h % DAMAGE == 0:
                                k = h % len(w)
                                w = w[:k] + w[k + 1:]
                                if len(w) < least_length:
                                    continue
                            held[w] += n
                    if len(held) > HELD:
                        yield flush()
        if held:
            yield flush()

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Trie:
    """The tries of many groups, from their words in order; nodes are numbered level by level, each level in order."""

    def __init__(self, group: np.ndarray, rest: list[bytes]):
        n = len(rest)
        length = np.fromiter(map(len, rest), np.int64, n)
        flat, start = np.frombuffer(b"".join(rest), np.uint8), np.cumsum(length) - length
        node = np.cumsum(np.r_[True, group[1:] != group[:-1]])[:n] - 1  # where each word has come to
        count = int(node[-1]) + 1 if n else 0
        keys: list[np.ndarray] = []
        self.level, ends = [0, count], [self._ends(node, length == 0, np.arange(n), count)]
        live, t = np.flatnonzero(length > 0), 0
        while len(live):
            key = node[live] << 8 | flat[start[live] + t]
            new = np.r_[True, key[1:] != key[:-1]]
            node[live] = count + np.cumsum(new) - 1
            keys.append(key[new])
            first, count, t = count, count + int(new.sum()), t + 1
            self.level.append(count)
            ends.append(self._ends(node[live] - first, length[live] == t, live, count - first))
            live = live[length[live] > t]
        #: Of every node but the roots: its parent and its character, ascending.
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.roots = self.level[1]
        self.ends = np.concatenate(ends) if n else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.key, np.arange(count + 1) << 8)

    @staticmethod
    def _ends(node: np.ndarray, here: np.ndarray, word: np.ndarray, count: int) -> np.ndarray:
        out = np.full(count, -1, np.int64)
        out[node[here]] = word[here]
        return out

    def children(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes, and the place in ``of`` of each one's parent."""
        k = self.first[of + 1] - self.first[of]
        parent = np.repeat(np.arange(len(of)), k)
        return self.roots + self.first[of][parent] + np.arange(len(parent)) - np.repeat(np.cumsum(k) - k, k), parent

    def below(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children, by the same character, of pairs of nodes."""
        child, at = self.children(a)
        want = b[at] << 8 | self.key[child - self.roots] & 255
        k = np.minimum(np.searchsorted(self.key, want), max(0, len(self.key) - 1))
        hit = self.key[k] == want if len(self.key) else np.zeros(0, bool)
        return child[hit], self.roots + k[hit]

    def pairs(self, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Pairs of words, as places in the list, at distance one: of the same length, or the second one longer by one.

        ``before``: for each root the character that precedes it, if an insertion there is found elsewhere, else -1."""
        none = np.zeros(0, np.int64)
        same, longer = (none, none), (none, none)  # active nodes of this level's nodes, of the same level and the next
        for t in range(len(self.level) - 1):
            own = np.arange(self.level[t], self.level[t + 1])
            if t:
                same, longer = self.below(*same), self.below(*longer)
                # siblings: each with those after it
                parent = self.key[own - self.roots] >> 8
                last = np.searchsorted(parent, parent, "right") - np.arange(len(own)) - 1
                at = np.repeat(np.arange(len(own)), last)
                after = at + 1 + np.arange(len(at)) - np.repeat(np.cumsum(last) - last, last)
                same = np.r_[same[0], own[at]], np.r_[same[1], own[after]]
            child, at = self.children(own)
            # a character like the one before it, inserted, has been found as inserted before that one
            fresh = self.key[child - self.roots] & 255 != (before if t == 0 else self.key[own - self.roots] & 255)[at]
            longer = np.r_[longer[0], own[at][fresh]], np.r_[longer[1], child[fresh]]
            for (a, b), kind in ((same, False), (longer, True)):
                x, y = self.ends[a], self.ends[b]
                hit = (x >= 0) & (y >= 0)
                if hit.any():
                    yield x[hit], y[hit], kind


def _linked(dirs: np.ndarray, size: np.ndarray, key: list[bytes], rest: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    """The near words of sorted tries' words: a row for each word and trie with their number and the best of them."""
    new = np.zeros(len(key), bool)
    new[1:] = (dirs[1:] != dirs[:-1]) | (size[1:] != size[:-1]) | np.fromiter((a != b for a, b in zip(key, key[1:])), bool, len(key) - 1)
    group = np.cumsum(new)
    many = np.bincount(group)[group] > 1
    pick = np.flatnonzero(many)
    key, rest, dirs, size, n = [key[i] for i in pick], [rest[i] for i in pick], dirs[pick], size[pick], n[pick]
    words = [k + r if d == 0 else (k + r)[::-1] for k, r, d in zip(key, rest, dirs.tolist())]
    # in a trie of reversed words only pairs that no other trie has: the first halves differ
    half = [b"" if d == 0 else w[:m // 2] for w, d, m in zip(words, dirs.tolist(), size.tolist())]
    found: dict[int, tuple[int, int, bytes]] = {}
    length = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.flatnonzero(np.r_[True, np.diff(group[pick]) != 0])[:len(pick)]
    # beyond the base prefix, a character like the last one of the prefix, inserted, has been found as inserted before that one
    before = np.array([key[i][-1] if len(key[i]) > (size[i] + dirs[i]) // 2 else -1 for i in starts.tolist()], np.int64)
    for a, b, longer in Trie(group[pick], rest).pairs(before) if len(pick) else ():
        if not longer:  # pairs of the longer words are another trie's
            ok = length[a] == size[a]
            a, b = a[ok], b[ok]
        for x, y in zip(a.tolist(), b.tolist()):
            if dirs[x] == 1 and half[x] == half[y]:
                continue
            for p, q in ((x, y), (y, x)):
                own = (-int(n[q]), words[q])
                had = found.get(p)
                found[p] = (1, *own) if had is None else (had[0] + 1, *min(own, had[1:]))
    text = lambda x: pa.array([w.decode("latin-1") for w in x], pa.string())
    return pa.RecordBatch.from_arrays([text(words[p] for p in found), pa.array([v[0] for v in found.values()], pa.int64()),
                                       pa.array([-v[1] for v in found.values()], pa.int64()), text(v[2] for v in found.values())], ["word", "near", "best_n", "best"])


def _joined(placed: DataFrame) -> DataFrame:
    """``dir, size, key, rest, n`` to ``word, near, best_n, best``; a trie's words lie in one task."""
    order = ["dir", "size", "key", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarely_collect()
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            cols = [np.asarray(rows.column(k)) for k in (0, 1, 4)]
            raw = [[x.encode("latin-1") for x in strings(rows.column(k).combine_chunks())] for k in (2, 3)]
            return _linked(cols[0], cols[1], *raw, cols[2])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < ROWS:
                continue
            rows = pa.Table.from_batches(held)
            last = rows.slice(rows.num_rows - 1)
            differs = np.zeros(rows.num_rows, bool)
            for k in range(3):
                differs |= np.asarray(pc.not_equal(rows.column(k), last.column(k)[0]))
            cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0  # the last trie may go on
            if cut:
                yield flush(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    parts = partitions(placed.sparkSession)
    return placed.repartition(parts, "dir", "size", "key").sortWithinPartitions(*order).select(*order, "n").mapInArrow(run, "word string, near long, best_n long, best string")


def _places(words: DataFrame, least_length: int) -> DataFrame:
    """Each word in the tries of pairs that it is the shorter or longer one of, forward and reversed."""
    n = F.length("word")
    sizes = F.filter(F.array(n, n - 1), lambda s: s >= least_length)
    one = words.select("word", "n", F.explode(sizes).alias("size")).withColumn("dir", F.explode(F.array(F.lit(0), F.lit(1))))
    text = F.when(F.col("dir") == 0, F.col("word")).otherwise(F.reverse("word"))
    base = F.when(F.col("dir") == 0, F.floor(F.col("size") / 2)).otherwise(F.ceil(F.col("size") / 2)).cast("int")
    return one.select("dir", "size", text.alias("text"), "n", base.alias("base"), base.alias("depth"))


def _at_one_place(large: DataFrame, step: int) -> DataFrame:
    """Pairs of the words of large tries that differ in the next ``step`` places after the prefix: both without the
    code point of one place, or one of them so, are equal. A key has at most as many words as there are letters, and one."""
    i = F.col("i")
    at = large.withColumn("i", F.explode(F.sequence(F.col("depth"), F.col("depth") + step - 1))).where(i <= F.length("text"))
    less = F.concat(F.expr("substring(text, 1, i)"), F.expr("substring(text, i + 2)"))
    short = F.length("text") == F.col("size")
    # of equal neighbours only the first is left out, so that a pair is found once
    first = (i == F.col("base")) | (F.expr("substring(text, i, 1)") != F.expr("substring(text, i + 1, 1)"))
    there = i < F.length("text")
    key = ["dir", "size", "i"]
    without = at.where(there).select(*key, less.alias("left"), "text", "n", short.alias("short"), first.alias("first"))
    one, other = ([F.col(c).alias(f"{c}{k}") for c in ("text", "n")] for k in (1, 2))
    replaced = without.where("short").select(*key, "left", *one).join(without.where("short").select(*key, "left", *other), [*key, "left"]).where("text1 < text2")
    inserted = at.where(short).select(*key, F.col("text").alias("left"), *one).join(without.where("not short and first").select(*key, "left", *other), [*key, "left"])
    pairs = replaced.unionByName(inserted)
    # in reversed words only pairs whose first halves differ
    half = lambda c: F.expr(f"substring({c}, length({c}) - int(size div 2) + 1)")
    pairs = pairs.where((F.col("dir") == 0) | (half("text1") != half("text2")))
    word = lambda c: F.when(F.col("dir") == 0, F.col(c)).otherwise(F.reverse(c))
    ways = F.explode(F.array(*[F.struct(word(a).alias("word"), F.lit(1).cast("long").alias("near"), F.col(f"n{b[-1]}").alias("best_n"), word(b).alias("best")) for a, b in (("text1", "text2"), ("text2", "text1"))]))
    return pairs.select(ways.alias("p")).select("p.*")


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, most: int = MOST, step: int = STEP) -> DataFrame:
    """``word, n`` (distinct words of Latin-1 letters, of ``least_length`` or more) to ``word, n_near, best, best_n`` of those
    that have near words: their number, and the one of the largest n, of equal ones the smallest in code-point order."""
    placed, found = _places(words, least_length), []
    while True:
        d = placed.withColumn("key", F.expr("substring(text, 1, depth)"))
        large = written(d.groupBy("dir", "size", "key").agg(F.count("*").alias("words")).where(F.col("words") > most).select("dir", "size", "key"), "tries")
        rest = F.expr("substring(text, depth + 1)").alias("rest")
        if large.isEmpty():
            unwritten(large)
            found.append(_joined(d.select("dir", "size", "key", rest, "n")))
            break
        found.append(_joined(d.join(large, ["dir", "size", "key"], "left_anti").select("dir", "size", "key", rest, "n")))
        over = d.join(large, ["dir", "size", "key"], "left_semi").drop("key")
        found.append(_at_one_place(over, step))
        placed = written(over.where(F.length("text") >= F.col("depth") + step).withColumn("depth", F.col("depth") + step), "deeper")
    all_found = found[0]
    for x in found[1:]:
        all_found = all_found.unionByName(x)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return all_found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each word: ``word, form, root, n, n_near, form_n``.

    ``form``: the near word of the largest n (ties: the smallest in code-point order) if that is at least ``ratio``
    times the word's, else null. ``root``: where forms lead in the end, the word itself if it has none. Null and empty
    texts have no words; a null id stands as empty text before the colon of the hashed runs. Repeated rows count as
    often as they occur. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    words = written(vocabulary(docs, least_length, least_count, id_col, text_col), "words")
    near = near_words(words, least_length, most)
    formed = F.col("best_n") >= F.col("n") * ratio
    out = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "near")
    # every form is `ratio` times as frequent as the word before: that bounds the chains, and each round doubles what is followed
    top, longest = words.agg(F.max("n")).first()[0] or 0, 0
    while top >= least_count * ratio and ratio > 1:
        top, longest = top // ratio, longest + 1
    root = out.where("form is not null").select("word", F.col("form").alias("to"))
    done = 1
    while done < longest:
        on = root.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        root, done = root.join(on, "to", "left").select("word", F.coalesce("beyond", "to").alias("to")), 2 * done
    return out.join(root, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
