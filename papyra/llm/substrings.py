"""Substring dedup: passages of ``WINDOW`` words or more that also stand in a document of a smaller id are removed.

Anchors are fixed blocks: of every document the blocks of ``BLOCK`` words that don't overlap are indexed, and every
rolling window of ``BLOCK`` words probes the index. As a window of 2 * BLOCK - 1 = 13 words holds a whole block of any
document it stands in, each repeat is hit. A hit is extended to the windows of 13 words around it: the smallest id that
holds such a window decides, and windows that go, joined, are the maximal exact repeats. No two documents of a passage
that many share are paired.

Documents are laid down in slices. A slice sends its distinct hashes, a few bytes each, as one row per range of hashes,
and gets back a bit for each: however often a passage occurs, it is sent once by each slice. The texts themselves stay
in the buckets of their slice's number and aren't moved again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._common import bucketed, partitions, slices

BLOCK = 7
WINDOW = 2 * BLOCK - 1
#: Bytes and rows of a slice; a longer text is a slice of its own.
SLICE_BYTES, SLICE_ROWS = 2_000_000, 20_000
#: Bytes that are hashed at a time, and the length from which a word is hashed on its own.
PIECE, LONG = 1 << 20, 1024
#: A null id is larger than all others.
_LAST = np.iinfo(np.int64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads their bits (the finaliser of SplitMix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWER = np.multiply.accumulate(np.r_[np.uint64(1), np.full(LONG, 0xD6E8FEB86659FD93, np.uint64)])
_FIRST, _SECOND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


class Slice:
    """The words of some texts: their hashes, and each text's place among them."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        self.null = np.asarray(pc.is_null(ids))
        self.ids = np.asarray(pc.fill_null(ids, int(_LAST)), np.int64)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[at[0]:at[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.begin = at - at[0]
        own = ~_SPACE[self.data]
        edge = np.zeros(len(own) + 1, bool)  # a text's first byte: a word doesn't go on from the text before
        edge[self.begin] = True
        starts = np.flatnonzero(own & (np.r_[True, ~own[:-1]][:len(own)] | edge[:-1]))
        ends = np.flatnonzero(own & (np.r_[~own[1:], True][:len(own)] | edge[1:])) + 1
        #: The first word of each text, and the end of the last.
        self.first = np.searchsorted(starts, self.begin)
        self.words = self._hashed(starts, ends)
        self.text = np.repeat(np.arange(len(self.ids)), np.diff(self.first))  # of each word

    def _hashed(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = np.zeros(len(size), np.uint64)
        short = np.where(size < LONG, size, 0)
        done, at = np.cumsum(short), 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(done, done[at] + PIECE)))
            k = short[at:to]
            off = np.cumsum(k) - k
            inside = np.arange(int(k.sum())) - np.repeat(off, k)
            value = _BYTE[self.data[np.repeat(starts[at:to], k) + inside]] * _POWER[inside]
            some = k > 0
            if some.any():
                out[at:to][some] = np.add.reduceat(value, off[some])
            at = to
        for i in np.flatnonzero(size >= LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
        return _mixed(out + size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def windows(self, width: int) -> np.ndarray:
        """The first words of the windows of ``width`` words that lie in one text, of texts with a whole window of ``WINDOW``."""
        n = np.diff(self.first)
        left = self.first[1:][self.text] - np.arange(len(self.text))
        return np.flatnonzero((left >= width) & (n[self.text] >= WINDOW))

    def hashed(self, at: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for j in range(width):
            h = h * factor + self.words[at + j]
        return _mixed(h)


class Probes:
    """A slice's rolling windows of a block's size, and its distinct hashes in order."""

    def __init__(self, s: Slice, buckets: int):
        self.s, self.at = s, s.windows(BLOCK)
        h = s.hashed(self.at, BLOCK, _FIRST)
        bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        key = bucket << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        self.new = np.r_[True, key[1:] != key[:-1]][:len(key)]
        self.key = key[self.new]
        self.edge = np.searchsorted(self.key, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))

    def rows(self, name: int) -> list[tuple]:
        """``bucket, slice, hashes, flags``: whether a block of the index has the hash, whether several texts of this slice do."""
        if not len(self.key):
            return []
        s, first = self.s, np.flatnonzero(self.new)
        text = s.text[self.at][self.order]
        last = np.r_[first[1:], len(text)] - 1
        several = text[first] != text[last]  # in order of place, and so of texts
        block = (self.at - s.first[:-1][s.text[self.at]]) % BLOCK == 0
        indexed = np.maximum.reduceat(block[self.order], first)
        low = (self.key & np.uint64(0xFFFFFFFF)).astype("<u4")
        return [(b, name, low[i:j].tobytes(), np.packbits(indexed[i:j]).tobytes() + np.packbits(several[i:j]).tobytes())
                for b, (i, j) in enumerate(zip(self.edge.tolist(), self.edge[1:].tolist())) if i < j]

    def hits(self, bits: list[dict]) -> np.ndarray:
        """The first words of windows of ``WINDOW`` words that hold a hit."""
        s = self.s
        got = _spread(self.edge, bits)
        live = np.zeros(len(s.words) + 1, np.int64)
        live[self.at[self.order]] = got[np.cumsum(self.new) - 1] if len(self.key) else 0
        before = np.r_[0, np.cumsum(live)]
        at = s.windows(WINDOW)
        return at[before[at + BLOCK] - before[at] > 0]


def _spread(edge: np.ndarray, bits: list[dict]) -> np.ndarray:
    """The bits of each bucket's hashes, in order; a bucket that sent none has none."""
    out = np.zeros(int(edge[-1]), bool)
    for r in bits:
        i, j = int(edge[r["bucket"]]), int(edge[r["bucket"] + 1])
        out[i:j] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=j - i).astype(bool)
    return out


class Extended:
    """A slice's windows that hold a hit, and their distinct hashes in order, each with the smallest id that has it here."""

    def __init__(self, s: Slice, at: np.ndarray, buckets: int):
        self.s, self.at = s, at
        one, two = s.hashed(at, WINDOW, _FIRST), s.hashed(at, WINDOW, _SECOND)
        self.order = np.lexsort((two, one))
        one, two = one[self.order], two[self.order]
        self.new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])][:len(one)]
        self.one, self.two = one[self.new], two[self.new]
        ids = s.ids[s.text[at][self.order]]
        self.least = np.minimum.reduceat(ids, np.flatnonzero(self.new)) if len(ids) else ids
        bucket = (self.one >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        self.edge = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))

    def rows(self, name: int) -> list[tuple]:
        """``bucket, slice, hashes, least``; hashes have 96 bits, and the bucket's."""
        held = np.empty(len(self.one), [("one", "<u8"), ("two", "<u4")])
        held["one"], held["two"] = self.one, self.two & np.uint64(0xFFFFFFFF)
        return [(b, name, held[i:j].tobytes(), self.least[i:j].astype("<i8").tobytes()) for b, (i, j) in enumerate(zip(self.edge.tolist(), self.edge[1:].tolist())) if i < j]

    def covered(self, bits: list[dict]) -> np.ndarray:
        """Which words lie in a window that stands in a document of a smaller id: of another slice, or of this one."""
        s = self.s
        cover = np.zeros(len(s.words) + 1, np.int64)
        if len(self.at):
            group = np.cumsum(self.new) - 1
            gone = np.zeros(len(self.at), bool)
            gone[self.order] = _spread(self.edge, bits)[group] | (self.least[group] < s.ids[s.text[self.at][self.order]])
            np.add.at(cover, self.at[gone], 1)
            np.add.at(cover, self.at[gone] + WINDOW, -1)
        return np.cumsum(cover)[:-1] > 0


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "slice": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(n, pa.binary())) for k, n in enumerate(names)], list(names))


def _sliced(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for b in batches:
            for i, j in slices(b.column(1), SLICE_ROWS, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *[pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), pa.concat_arrays([b.column(k).slice(i, j - i)])) for k in (0, 1)]], ["slice", "ids", "texts"])
                name += 1

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "slice long, ids array<long>, texts array<string>")


def _slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Slice, list[list[dict]]]]:
    for b in batches:
        for i in range(b.num_rows):
            s = Slice(b.column(1)[i].values, b.column(2)[i].values)
            yield b.column(0)[i].as_py(), s, [b.column(k)[i].as_py() or [] for k in range(3, b.num_columns)]


def _answers(sent: DataFrame, answer, buckets: int) -> DataFrame:
    """``slice`` and, as ``bits``, a list of ``bucket, bits``: what the tasks of the buckets say to each slice, a bounded list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])]
        if rows:
            out = [(r[0], r[1], np.packbits(x).tobytes()) for r, x in zip(rows, answer(rows)) if x.any()]
            yield _batch(out, "bucket", "slice", "bits")

    told = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "bucket int, slice long, bits binary")
    return told.groupBy("slice").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))


def _shared(rows: list[tuple]) -> Iterator[np.ndarray]:
    """Hashes that the index has and that several texts have."""
    n = [len(r[2]) // 4 for r in rows]
    flags = [np.frombuffer(r[3], np.uint8) for r in rows]
    key = np.concatenate([np.frombuffer(r[2], "<u4") for r in rows])
    indexed, several = (np.concatenate([np.unpackbits(f[len(f) // 2 * k:len(f) // 2 * (k + 1)], count=m) for f, m in zip(flags, n)]) for k in (0, 1))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    first = np.flatnonzero(new)
    some = np.diff(np.r_[first, len(key)]) > 1
    live = (np.maximum.reduceat(indexed[order], first) > 0) & (some | (np.maximum.reduceat(several[order], first) > 0))
    out = np.empty(len(key), bool)
    out[order] = live[np.cumsum(new) - 1]
    return iter(np.split(out, np.cumsum(n)[:-1]))


def _smaller(rows: list[tuple]) -> Iterator[np.ndarray]:
    """Hashes that another slice has with a smaller id."""
    n = [len(r[2]) // 12 for r in rows]
    key = np.concatenate([np.frombuffer(r[2], [("one", "<u8"), ("two", "<u4")]) for r in rows])
    least = np.concatenate([np.frombuffer(r[3], "<i8") for r in rows])
    order = np.lexsort((key["two"], key["one"]))
    one, two = key["one"][order], key["two"][order]
    new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
    all_least = np.minimum.reduceat(least[order], np.flatnonzero(new))
    out = np.empty(len(one), bool)
    out[order] = all_least[np.cumsum(new) - 1] < least[order]
    return iter(np.split(out, np.cumsum(n)[:-1]))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``doc_id, n_words, n_removed, text`` (the kept words, joined by a space) and ``repeats``, the
    ``start`` and ``length`` in words of what was removed, as maximal runs.

    A word goes if a window of ``WINDOW`` words of its document covers it whose words also stand, in this order, in a document
    of a smaller id; windows are judged on what is given. Words are separated by ASCII white space. Null and empty texts
    have no words. Repeated ids are documents of the same id, of which none is smaller; a null id is larger than
    all. Rows are decided as rows. An empty table gives none; other columns are ignored, whatever their names.
    """
    buckets = partitions(docs.sparkSession)
    held = bucketed(_sliced(docs, id_col, text_col), "slices", "slice")

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, s, _ in _slices_of(batches):
            yield _batch(Probes(s, buckets).rows(name), "bucket", "slice", "hashes", "flags")

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, s, (hits,) in _slices_of(batches):
            yield _batch(Extended(s, Probes(s, buckets).hits(hits), buckets).rows(name), "bucket", "slice", "hashes", "least")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s, (hits, smaller) in _slices_of(batches):
            cover = Extended(s, Probes(s, buckets).hits(hits), buckets).covered(smaller) if hits else np.zeros(len(s.words), bool)
            texts, spans, raw = [], [], s.data.tobytes()
            for k, (i, j) in enumerate(zip(s.first.tolist(), s.first[1:].tolist())):
                words, own = raw[s.begin[k]:s.begin[k + 1]].split(), cover[i:j]
                if own.any():
                    turn = np.flatnonzero(np.diff(np.r_[0, own.astype(np.int8), 0]))
                    spans.append([{"start": a, "length": b - a} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist())])
                    texts.append(b" ".join(compress(words, (~own).tolist())))
                else:
                    spans.append([])
                    texts.append(b" ".join(words))
            n = np.diff(s.first)
            gone = np.diff(np.r_[0, np.cumsum(cover)][s.first])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            ids = pa.array(s.ids, pa.int64(), mask=s.null)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, kind)], ["doc_id", "n_words", "n_removed", "text", "repeats"])

    sent = held.mapInArrow(probes, "bucket int, slice long, hashes binary, flags binary")
    hits = _answers(sent, _shared, buckets)
    hits = bucketed(hits, "hits", "slice")
    around = held.join(hits.withColumnRenamed("bits", "hits"), "slice").mapInArrow(extended, "bucket int, slice long, hashes binary, least binary")
    smaller = _answers(around, _smaller, buckets)
    out = held.join(hits.withColumnRenamed("bits", "hits"), "slice", "left").join(smaller.withColumnRenamed("bits", "smaller"), "slice", "left")
    return out.mapInArrow(removed, "doc_id long, n_words long, n_removed long, text string, repeats array<struct<start:long,length:long>>")
