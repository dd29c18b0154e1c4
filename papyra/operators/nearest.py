"""The nearest name of a dimension by weighted ratio, without scoring all pairs and without a dimension in one place.

Names and dimension lie in blocks, and every two blocks meet in a task. There, bounds of the ratio are computed for all
pairs at once, as products of matrices: from the letters that two names have in common, from the lengths of the words
that they share, and from their own lengths. A name's candidates are then scored in the order of their bounds, until none
that is left can beat the best. What the tasks find is combined by name.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import attach, written
from ..functions.similarity import wratio

#: Names of a block, columns that letters and words are hashed to, and slack for sums of fractions.
BLOCK, LETTERS, WORDS = 2048, 48, 512
_EPS = 1e-4


def key_of(name: str) -> str:
    """What is compared: lower case, without outer white space."""
    return name.lower().strip()


class Names:
    """Keys of some names as rows of matrices."""

    def __init__(self, keys: list[str]):
        self.keys, self.n = keys, np.array([len(k) for k in keys], np.float32)
        words = [set(k.split()) for k in keys]
        #: Length of the sorted distinct words, joined; of all words, joined.
        self.set_size = np.array([sum(map(len, w)) + max(0, len(w) - 1) for w in words], np.float32)
        self.all_size = np.array([len(" ".join(k.split())) for k in keys], np.float32)
        self.letters = np.zeros((len(keys), LETTERS), np.int64)
        self.words = np.zeros((len(keys), WORDS), np.float32)
        for i, k in enumerate(keys):
            np.add.at(self.letters[i], np.frombuffer(k.encode("utf-32-le", "surrogatepass"), "<u4") % LETTERS, 1)
            for w in words[i]:
                # the root of a word's length and a space: a product with itself gives that length; hashes that meet add up to more
                self.words[i, hash_of(w)] += np.sqrt(np.float32(len(w) + 1))

    def levels(self, most: np.ndarray) -> np.ndarray:
        """For each column and each count up to ``most``, whether there are so many: a product of two rows is what they have in common."""
        return np.concatenate([(self.letters[:, [c]] >= np.arange(1, m + 1)) for c, m in enumerate(most.tolist()) if m], axis=1).astype(np.float32) if most.any() else np.zeros((len(self.keys), 1), np.float32)


def hash_of(word: str) -> int:
    h = 0
    for c in word:
        h = (h * 1000003 ^ ord(c)) & 0xFFFFFFFF
    return (h ^ h >> 15) % WORDS


def bounds(a: Names, b: Names) -> np.ndarray:
    """A number that the weighted ratio of each pair doesn't exceed."""
    most = np.minimum(a.letters.max(axis=0, initial=0), b.letters.max(axis=0, initial=0))
    common = a.levels(most) @ b.levels(most).T
    shared = a.words @ b.words.T  # of the words in both, their lengths and a space each, or more
    n, m = a.n[:, None], b.n[None, :]
    low, high = np.minimum(n, m), np.maximum(n, m)
    plain = 200 * np.minimum(common, low) / np.maximum(n + m, 1)
    # sorted words are the same letters, with single spaces
    sizes = a.all_size[:, None] + b.all_size[None, :]
    ordered = np.minimum(100, 200 * common / np.maximum(sizes, 1))
    both = np.maximum(0, shared - 1)
    s, t = a.set_size[:, None], b.set_size[None, :]
    some = shared > 0.5
    part = np.maximum(200 * both / np.maximum(both + s, 1), 200 * both / np.maximum(both + t, 1))
    whole = some & ((both >= s - 0.5) | (both >= t - 0.5))
    of_sets = np.where(whole, 100, np.maximum(np.minimum(100, 200 * common / np.maximum(s + t, 1)), np.where(some, np.minimum(part, 100), 0)))
    like = np.maximum(plain, 0.95 * np.maximum(ordered, of_sets))
    scale = np.where(high <= 8 * low, 0.9, 0.6)
    # against a part of the longer one, which may be as short as what they have in common
    least = np.minimum(np.minimum(a.set_size[:, None], b.set_size[None, :]), low)  # each word once: the shortest form
    held = np.minimum(common, low)
    inside = np.minimum(100, 200 * held / np.maximum(least + held, 1))
    unlike = np.maximum(plain, scale * np.maximum(inside, 0.95 * np.where(some, 100, inside)))
    return np.where((low == 0) | (high == 0), 0, np.where(high < 1.5 * low, like, unlike)) + _EPS


def best_of(asked: list[str], known: list[str], place: np.ndarray, floor: np.ndarray | None = None) -> list[tuple[int, float, int]]:
    """For each key: the place in ``known`` of its nearest key, the first by ``place`` of several, the ratio, and the pairs that were scored.
    ``floor``: ratios that are reached elsewhere; where none here is as good, the place is -1."""
    u = bounds(Names(asked), Names(known))
    out = []
    for i, k in enumerate(asked):
        best, at, scored = -1.0 if floor is None else float(floor[i]), -1, 0
        for j in np.argsort(-u[i], kind="stable").tolist():
            if u[i, j] < best:
                break
            score = wratio(k, known[j])
            scored += 1
            if score > best or score == best and (at < 0 or place[j] < place[at]):
                best, at = score, j
        out.append((at, best, scored))
    return out


def first_of(asked: list[str], known: list[str]) -> list[float]:
    """For each key the ratio to the key of the highest bound: what its nearest key reaches at least."""
    top = bounds(Names(asked), Names(known)).argmax(axis=1)
    return [wratio(k, known[j]) for k, j in zip(asked, top.tolist())]


def nearest(names: DataFrame, tags: DataFrame, block: int = BLOCK) -> DataFrame:
    """``name``, and ``pos, name`` of a dimension, to ``name, tag, score, scored``: for each distinct name the tag of the highest weighted
    ratio, the first by ``pos`` on ties, and the number of pairs that were scored for it. Null names are left out; without
    tags there are no rows.

    In a first pass each block scores the pair of the highest bound, and the best of these is where the search begins.
    """
    attach(names.sparkSession)
    asked, known = names.where("name is not null").select("name").distinct(), tags.where("name is not null").select("pos", "name")
    n, m = (max(1, -(-d.count() // block)) for d in (asked, known))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    other = known.select(every(n).alias("i"), part("name", m).alias("j"), F.col("pos").cast("long").alias("pos"), "name", F.lit(None).cast("double").alias("floor"))

    def met(d: DataFrame, run, kind: str) -> DataFrame:
        one = d.select(part("name", n).alias("i"), every(m).alias("j"), F.lit(None).cast("long").alias("pos"), "name", "floor")
        return one.unionByName(other).groupBy("i", "j").applyInPandas(run, kind)

    def sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[str], list[str], pd.DataFrame]:
        a, b = rows[rows["pos"].isna()], rows[rows["pos"].notna()]
        return a, [key_of(x) for x in a["name"]], [key_of(x) for x in b["name"]], b

    def lowest(rows: pd.DataFrame) -> pd.DataFrame:
        a, asked_keys, known_keys, _ = sides(rows)
        got = first_of(asked_keys, known_keys) if asked_keys and known_keys else []
        return pd.DataFrame({"name": a["name"].to_numpy(object)[:len(got)], "floor": np.array(got, np.float64)})

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        a, asked_keys, known_keys, b = sides(rows)
        pos, texts = b["pos"].to_numpy(np.int64), b["name"].to_numpy(object)
        got = best_of(asked_keys, known_keys, pos, a["floor"].to_numpy(np.float64)) if asked_keys and known_keys else []
        at = np.array([k for k, _, _ in got], np.int64)
        tag = np.array([texts[k] if k >= 0 else None for k in at.tolist()], object)
        return pd.DataFrame({"name": a["name"].to_numpy(object)[:len(got)], "tag": tag, "pos": np.array([pos[k] if k >= 0 else -1 for k in at.tolist()], np.int64),
                             "score": np.array([s if k >= 0 else -1.0 for k, s, _ in got], np.float64), "scored": np.array([c for _, _, c in got], np.int64)})

    low = met(asked.withColumn("floor", F.lit(None).cast("double")), lowest, "name string, floor double").groupBy("name").agg(F.max("floor").alias("floor"))
    low = written(low, "floors")
    best = F.max_by(F.struct("tag", "score"), F.struct("score", -F.col("pos"))).alias("m")
    found = met(low, search, "name string, tag string, pos long, score double, scored long").groupBy("name").agg(best, F.sum("scored").alias("scored"))
    return found.select("name", "m.tag", "m.score", (F.col("scored") + m).alias("scored"))


def matched(docs: DataFrame, tags: DataFrame, least: float = 95.0, tags_col: str = "tags", block: int = BLOCK) -> DataFrame:
    """``docs`` with ``matches``: each proposed tag's match (tag, match or null, score), one after the other: a tag that matches
    nothing joins the candidates of the later ones of its row, after those of the dimension (``pos, name``).

    Distinct tags are looked up once; only tags of one row are compared in it. A null tag matches nothing and joins nothing;
    a null list gives an empty one. Repeated rows each have their matches.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "proposed")
    each = rows.select(row, F.posexplode(tags_col).alias("at", "name"))
    found = each.join(nearest(each, tags, block).drop("scored"), "name", "left")
    told = found.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("at", "name", "tag", "score"))).alias("__found"))

    def run(proposed: pd.Series) -> pd.Series:
        return proposed.map(lambda p: _in_order([] if p is None else p, least))

    kind = "array<struct<tag:string,match:string,score:double>>"
    return rows.join(told, row, "left").withColumn("matches", F.pandas_udf(run, kind)("__found")).drop(row, "__found")


@functools.lru_cache(1 << 16)
def _ratio_of(name: str, other: str) -> float:
    """Rows propose the same tags again and again: a pair is scored once for many of them."""
    return wratio(key_of(name), key_of(other))


def _in_order(proposed, least: float) -> list[dict]:
    new: list[str] = []
    out = []
    for p in proposed:
        name, tag, best = p["name"], p["tag"], p["score"]
        best = None if best is None or best != best else best
        if name is not None:
            for x in new:
                score = _ratio_of(name, x)
                if best is None or score > best:
                    tag, best = x, score
        hit = best is not None and best >= least
        out.append({"tag": name, "match": tag if hit else None, "score": best})
        if not hit and name is not None:
            new.append(name)
    return out
