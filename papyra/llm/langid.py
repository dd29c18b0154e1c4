"""Language identification by cross-parsing entropy.

For every language, the suffix automaton of a bounded sample of labelled text. A text is cut, from left to
right, into the longest phrases that occur in that sample; phrases x log2(sample length) / text length
estimates the cross entropy (Ziv and Merhav 1993), and the language needing the fewest normalised phrases
wins. The automaton is unrolled into a table (state, character) -> (state, phrases ended). Many texts are
parsed in step, each whole, in all languages at once; when few long texts are left, they are walked alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._common import Places, resident, slices, strings

#: Characters of labelled text per language that the automata are made of, and rows that are chosen from. These
#: bound the sample, whatever the size of the corpus.
SAMPLE_CHARS = 60_000
SAMPLE_ROWS = 200
#: Entries that all languages' tables may have; with more (very large alphabets), only the automata's own arcs are kept, hashed.
DENSE = 40_000_000
#: Texts that are parsed in step; fewer are walked one by one.
LEAST_LANES = 24
UNDETERMINED = "und"
_FOUND = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_char", DoubleType())]


class Automaton:
    """Suffix automaton over a sequence of small codes (Blumer et al. 1985)."""

    def __init__(self, codes: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        last = 0
        for c in codes:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        cur = self._state({}, self.len[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            return cur
        q = self.next[p][c]
        if self.len[q] == self.len[p] + 1:
            self.link[cur] = q
            return cur
        clone = self._state(dict(self.next[q]), self.len[p] + 1, self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = self.link[cur] = clone
        return cur

    def _state(self, arcs: dict, length: int, link: int) -> int:
        self.next.append(arcs)
        self.len.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def table(self, width: int) -> np.ndarray:
        """Row offset of the next state << 2 | phrases that end there; the last code stands for all that the sample lacks."""
        root = np.zeros(width, np.int64)
        own = np.zeros(width, bool)
        for c, s in self.next[0].items():
            root[c], own[c] = s, True
        # a missing arc ends the phrase; a character that the sample lacks is a phrase of its own
        t = np.empty((len(self.next), width), np.int32)
        t[:] = (root * width) << 2 | np.where(own, 1, 2)
        t[0] = (root * width) << 2 | np.where(own, 0, 1)
        for s, arcs in enumerate(self.next):
            row = t[s]
            for c, to in arcs.items():
                row[c] = to * width << 2
        return t.ravel()


class Model:
    """Automata of all languages, made in each worker process from the broadcast sample."""

    def __init__(self, samples: dict[str, list[str]], chars: int = SAMPLE_CHARS):
        # every letter of a sample has its own code there; one that a language's sample lacks can only be a phrase of its own
        self.langs, self.bits = sorted(samples), []
        alphabet = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
        self.width = len(alphabet) + 2
        self.code = np.zeros(0x110000, np.int32)  # 0: not a letter
        self.code[[i for i in range(0x110000) if chr(i).isalpha()]] = self.width - 1
        self.code[[ord(c) for c in alphabet]] = np.arange(1, self.width - 1)
        trained, self.column = [], np.zeros((len(self.langs), self.width), np.int32)
        for k, lang in enumerate(self.langs):
            codes = np.concatenate([np.r_[np.int32(0), self.codes(t)[0]] for t in samples[lang]] or [np.zeros(1, np.int32)])[:chars]
            own = np.unique(codes)  # a table is as wide as its language's letters, and one more
            self.column[k] = len(own)
            self.column[k, own] = np.arange(len(own))
            trained.append((self.column[k, codes].tolist(), len(own) + 1))
            self.bits.append(float(np.log2(max(2, len(codes)))))
        self.dense = sum(2 * len(codes) * w for codes, w in trained) <= DENSE  # an automaton has fewer than twice as many states as characters
        if self.dense:  # one table for all: a state is the place of its row; room that isn't needed is never touched
            room = sum(2 * len(codes) * w for codes, w in trained)
            self.to, self.ends, start = np.empty(room, np.int32), np.empty(room, np.int8), [0]
            while trained:
                t = Automaton(trained[0][0]).table(trained.pop(0)[1])
                own = slice(start[-1], start[-1] + len(t))
                self.ends[own] = t & 3
                t >>= 2
                t += start[-1]
                self.to[own] = t
                start.append(own.stop)
                del t
            self.root = np.array(start[:-1], np.int64)[:, None]
            return
        machines = [(Automaton(codes), w) for codes, w in trained]
        self.root = np.cumsum([0, *(len(m.next) for m, _ in machines)])[:-1].astype(np.int64)[:, None]
        arcs = [(r + s) << 21 | c for (m, _), r in zip(machines, self.root[:, 0].tolist()) for s, a in enumerate(m.next) for c in a]
        to = [r + t for (m, _), r in zip(machines, self.root[:, 0].tolist()) for a in m.next for t in a.values()]
        self.arcs, self.to = Places(np.array(arcs, np.int64)), np.array(to, np.int64)
        self.first = np.full((len(machines), max([0, *(w for _, w in machines)])), -1, np.int64)  # the root's arcs
        for k, (m, _) in enumerate(machines):
            for c, t in m.next[0].items():
                self.first[k, c] = int(self.root[k, 0]) + t
        self.next = [m.next for m, _ in machines]

    def _advance(self, at: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states (languages x texts), and the phrases that end there."""
        column = self.column[:, code]
        if self.dense:
            ask = at + column
            return self.to[ask], self.ends[ask]
        k = self.arcs.find((at << 21 | column).ravel()).reshape(at.shape)
        fresh = np.take_along_axis(self.first, column, 1)  # a missing arc ends the phrase, and the character begins one
        to = np.where(k >= 0, self.to[k], np.where(fresh >= 0, fresh, self.root))
        return to, np.where(k >= 0, 0, (at != self.root).astype(np.int64) + (fresh < 0))

    def _walk(self, k: int, state: int, code: np.ndarray) -> tuple[int, int]:
        """One text's rest, alone, in one language."""
        count = 0
        if self.dense:
            to, ends = memoryview(self.to), memoryview(self.ends)
            for part in range(0, len(code), 1 << 20):
                for c in self.column[k, code[part:part + (1 << 20)]].tolist():
                    count += ends[state + c]
                    state = to[state + c]
            return state, count
        arcs, base = self.next[k], int(self.root[k, 0])
        state -= base
        for part in range(0, len(code), 1 << 20):
            for c in self.column[k, code[part:part + (1 << 20)]].tolist():
                go = arcs[state].get(c)
                if go is None:
                    count += state != 0
                    go = arcs[0].get(c)
                    if go is None:
                        count, go = count + 1, 0
                state = go
        return base + state, count

    def codes(self, text: str) -> tuple[np.ndarray, bool]:
        """Codes of the lower-cased letters, every run of other characters as one 0; whether there is a letter."""
        c = self.code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = c > 0
        has = bool(keep.any())
        keep[1:] |= c[:-1] > 0
        return c[keep], has

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """Phrases (texts x languages) that each whole text needs with each language's sample."""
        n = np.array([len(c) for c in codes], np.int64)
        order = np.argsort(-n, kind="stable")
        flat = np.concatenate([codes[i] for i in order] or [np.zeros(0, np.int32)])
        size = n[order]
        place = np.cumsum(size) - size
        at = np.broadcast_to(self.root, (len(self.langs), len(codes))).copy()
        ended = np.zeros((len(self.langs), len(codes)), np.int64)
        lanes = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right").tolist() if len(size) else []  # texts that have so many characters
        step = 0
        while step < len(lanes) and lanes[step] >= LEAST_LANES:
            live = lanes[step]
            at[:, :live], ends = self._advance(at[:, :live], flat[place[:live] + step])
            ended[:, :live] += ends
            step += 1
        for lane in range(lanes[step] if step < len(lanes) else 0):
            for k in range(len(self.langs)):
                at[k, lane], count = self._walk(k, int(at[k, lane]), flat[place[lane] + step:place[lane] + size[lane]])
                ended[k, lane] += count
        out = np.empty((len(codes), len(self.langs)), np.int64)
        out[order] = (ended + (at != self.root)).T
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        """(language, score, bits a character) of each text."""
        out: list = [(UNDETERMINED, 0.0, None)] * len(texts)
        held = [(i, c) for i, (c, has) in ((i, self.codes(t)) for i, t in enumerate(texts) if t and self.langs) if has]
        if held:
            n = np.array([len(c) for _, c in held])
            rate = self.phrases([c for _, c in held]) * np.array(self.bits) / n[:, None]
            for (i, _), r in zip(held, rate):
                best = int(r.argmin())
                rest = np.delete(r, best)
                score = 1.0 if not len(rest) else float(1 - r[best] / rest.min()) if rest.min() > 0 else 0.0
                out[i] = self.langs[best], min(1.0, max(0.0, score)), float(r[best])
        return out


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, id_col: str = "doc_id",
           text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Whole rows of every language, in the order of a hash of the id, as long as they have ``chars`` characters in all.

    Of at most about ``2 * rows`` ids of a language that come first, one row of each; rows that do not fit any more are passed over. If
    the first one alone is longer, it is the sample, cut to ``chars``. The bound on the hash follows the number of distinct ids (estimated
    to 2 %), not of rows, and lies above the first id, so that every language with a labelled row has one in the sample.
    """
    d = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("h"))
    ids = d.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.min("h").alias("first")).collect()
    if not ids:
        return {}
    bound = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(max(r["first"] + 1, min(1 << 30, int((1 << 30) * 1.5 * rows / max(1, r["n"])) + 1)))) for r in ids])
    some = d.where(F.col("h") < bound).select("lang", "h", F.substring("text", 1, chars).alias("text"), F.length("text").alias("n"))
    # one row of each id, however often it occurs
    some = some.groupBy("lang", "h").agg(F.min(F.struct("text", "n")).alias("r")).select("lang", "h", "r.text", "r.n")
    # rows are chosen by their lengths, so that what reaches the driver is bounded by characters
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    some = some.withColumn("turn", turn).where((F.col("turn") <= 2 * rows) & ((F.col("n") <= chars) | (F.col("turn") == 1)))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("turn"))
    got: dict[str, dict[str, int]] = {}
    held: dict[str, int] = {}
    for r in some.withColumn("before", before).where(F.col("before") - F.col("n") < chars).orderBy("lang", "turn").collect():
        texts = got.setdefault(r["lang"], {})
        if r["text"] not in texts and (not texts or held[r["lang"]] + r["n"] <= chars):
            texts[r["text"]] = 0
            held[r["lang"]] = held.get(r["lang"], 0) + r["n"]
    return {k: list(v) for k, v in got.items()}


def identify(docs: DataFrame, samples: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score, bits_per_char``; with ``carry``, these columns of the row
    instead of its id, so that nothing needs to be joined back.

    Null texts and texts without a letter give ``und``, score 0 and null bits, as do all texts when nothing
    was learned. Ties go to the language that sorts first. Repeated rows each give a row; an empty table
    none; a null id stays null. Only the text is read: columns such as lang or source play no part, nor do
    columns of the names that are returned, unless they are carried.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(samples)
    key = "langid", spark.sparkContext.applicationId, hash(tuple((k, tuple(v)) for k, v in sorted(samples.items())))
    text = F.col(text_col).cast("string").alias("__text")
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text) if carry is None else docs.select(*carry, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = resident(key, lambda: Model(shared.value))
        for b in batches:
            for at, to in slices(b.column(b.num_columns - 1), 1024, 2_000_000):
                part = b.slice(at, to - at)
                lang, score, bits = zip(*model.predict(strings(part.column(b.num_columns - 1))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
                                                 [*b.schema.names[:-1], "lang_pred", "score", "bits_per_char"])

    kinds = StructType([*asked.schema.fields[:-1], *_FOUND])
    return asked.mapInArrow(run, kinds)
