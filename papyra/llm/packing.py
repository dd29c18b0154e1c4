"""Sequence packing in bounded space.

Every partition keeps a fixed number of open windows. A piece goes to the fullest window that still takes
it (best fit); when none does, the fullest window is emitted and a new one is opened. At the end, the pieces
of the open windows are merged: laid end to end and cut into full sequences, first in their partition, which
leaves less than a sequence of it, then those of many partitions in one merging task. Its remainder is split
at powers of two, so it needs no padding either.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._common import partitions, rarely_collect, release, resident, slices, strings

LENGTH = 2048
OPEN = 128
#: Partitions whose leftovers, less than a sequence each, one merging task takes.
MERGE = 16
END = 1
#: Pieces of a generation that a worker's cache keeps: it changes speed and memory only. A smaller one is not kept between tasks.
CACHE = 200_000
_END = np.array([END], "<u4").tobytes()
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


class Encoder:
    """A tokenizer file's ids, through the library, once for every distinct word.

    This kind of file lower-cases, drops white space, splits words from digits and signs, and ends each of
    these pieces with a token that is marked as a word's end. So a text's ids are those of its pieces, one
    after another, and many pieces can go through the library in one string and be told apart by the marks.
    Chunks with characters for which that isn't plain (beyond Latin letters and ASCII) go through it whole.
    """

    # Fixed: the file's pre-tokenisation pattern.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
    #: Texts that may be lower-cased as a whole, and chunks that may be cut here.
    SIMPLE = r"[\t-\r -~À-ÖØ-öø-ÿ]*+"

    def __init__(self, path: str, most: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are busy with other tasks
        import regex
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        vocab = t.get_vocab()
        self.t, self.most = t, most
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        if any("<|" not in x.content or x.content != x.content.lower() for x in t.get_added_tokens_decoder().values()):
            raise ValueError("a special token without <|, or in capitals")
        self.cut, self.simple = regex.compile(self.PIECES).findall, regex.compile(self.SIMPLE).fullmatch
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        rarely_collect()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit numbers, the end id last."""
        if len(self.known) > self.most:  # what is asked for again comes back from the generation before
            self.before, self.known = self.known, {"": b""}
        known = self.known
        # lower-casing simple texts first leaves fewer distinct chunks
        split = pc.ascii_split_whitespace(pa.array([x.lower() if x and self.simple(x) else x or "" for x in texts], pa.large_string()))
        coded = split.values.dictionary_encode()
        words = strings(coded.dictionary)
        new = {c for c in words if c not in known}
        again = new & self.before.keys()
        known.update(zip(again, map(self.before.__getitem__, again)))
        new -= again
        whole = {c for c in new if not c.isascii() and not self.simple(c) or "<|" in c}
        for c in whole:
            known[c] = np.array(self.t.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
        new -= whole
        letters = {c for c in new if c.isalpha() and c == c.lower()}
        mixed = list(new - letters)
        pieces = [(c[:-1], c[-1]) if c[-1] in ".,!" and c[:-1].isalpha() and c == c.lower() else self.cut(c.lower()) for c in mixed]
        letters.update(p for p in chain.from_iterable(pieces) if p not in known)
        self._learn(list(letters))
        of = known.__getitem__
        known.update(zip(mixed, [b"".join(map(of, p)) for p in pieces]))
        own = pa.array(list(map(of, words)), pa.large_binary()).take(coded.indices)  # each chunk's ids, copied to its places
        del words
        if not len(own):
            return [_END] * len(texts)
        ends = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, own.offset * 8)
        raw = memoryview(own.buffers()[2] or b"")
        cut = ends[np.asarray(split.offsets)].tolist()
        return [b"".join((raw[a:b], _END)) for a, b in zip(cut, cut[1:])]

    def _learn(self, new: list[str], size: int = 1000) -> None:
        for at in range(0, len(new), size):
            some = new[at:at + size]
            ids = np.array(self.t.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.last[ids]) + 1
            if len(cut) == len(some) and cut[-1] == len(ids):
                raw, at4 = ids.tobytes(), [0, *(4 * cut).tolist()]
                self.known.update(zip(some, [raw[a:b] for a, b in zip(at4, at4[1:])]))
            else:
                for p in some:
                    self.known[p] = np.array(self.t.encode(p, add_special_tokens=False).ids, "<u4").tobytes()


def encode_all(texts: list[str | None], path: str, cache: int = CACHE) -> list[bytes]:
    return resident(("packing", path, cache), lambda: Encoder(path, cache)).encode(texts)


class Windows:
    """Open windows, sorted by their fill."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.open: list[tuple[int, int]] = []  # (fill, window number)
        self.held: dict[int, list] = {}
        self.number = 0

    def place(self, piece: tuple) -> list | None:
        """Takes a piece (its length last); returns the pieces of a window that is emitted, if one is."""
        n, out = piece[-1], None
        k = bisect_left(self.open, (self.length - n + 1, -1)) - 1  # the fullest that takes it
        if k >= 0:
            fill, w = self.open.pop(k)
        else:
            if len(self.open) >= self.most:
                out = self.held.pop(self.open.pop()[1])
            fill, w, self.number = 0, self.number, self.number + 1
            self.held[w] = []
        self.held[w].append(piece)
        if fill + n == self.length:
            return self.held.pop(w)
        insort(self.open, (fill + n, w))
        return out


class Leftovers:
    """Pieces ``(doc, start, ids, total, n)`` laid end to end, and cut into sequences."""

    def __init__(self) -> None:
        self.held: deque = deque()
        self.tokens = 0

    def add(self, piece: tuple) -> None:
        self.held.append(piece)
        self.tokens += piece[-1]

    def fill(self, room: int) -> list[tuple]:
        """The pieces of the next sequence, of ``room`` tokens."""
        out, left = [], room
        while left:
            doc, start, ids, total, n = self.held.popleft()
            m = min(n, left)
            out.append((doc, start, ids[:4 * m], total, m))
            if m < n:
                self.held.appendleft((doc, start + m, ids[4 * m:], total, n - m))
            left -= m
        self.tokens -= room
        return out


class _Rows:
    """Finished pieces, and those that are still to be merged, as record batches."""

    def __init__(self, keep_ids: bool):
        self.keep_ids, self.rows = keep_ids, []

    def sequence(self, pieces: list[tuple], number: int) -> None:
        at = 0
        for doc, start, ids, total, n in pieces:
            self.rows.append((doc, start, n, zlib.crc32(ids), total, number, at, ids if self.keep_ids else None, -1))
            at += n

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [()] * 9
        self.rows.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.binary()), pa.array(cols[8], pa.int64())], [*_NAMES, "merge"])


def _pack(length: int, most: int, path: str, keep_ids: bool, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        space, out, serial = Windows(length, most), _Rows(keep_ids), part << 32
        for b in batches:
            docs = b.column(0).to_pylist()
            for at, to in slices(b.column(1), 1024, 4_000_000):
                for doc, ids in zip(docs[at:to], encode_all(strings(b.column(1).slice(at, to - at)), path, cache)):
                    total = len(ids) // 4
                    for start in range(0, total, length):
                        n = min(length, total - start)
                        piece = (doc, start, ids[4 * start:4 * (start + n)], total, n)
                        done = [piece] if n == length else space.place(piece)
                        if done:
                            out.sequence(done, serial)
                            serial += 1
                if len(out.rows) > 2000:
                    yield out.batch()
        # the windows still open are merged here, and less than one sequence goes to the merging task, with its ids
        rest = Leftovers()
        for window in space.held.values():
            for piece in window:
                rest.add(piece)
            while rest.tokens >= length:
                out.sequence(rest.fill(length), serial)
                serial += 1
        out.rows.extend((doc, start, n, 0, total, part, 0, ids, part) for doc, start, ids, total, n in rest.held)
        yield out.batch()
        if cache < CACHE:
            release()

    return run


def _merge(length: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_NAMES]
        number, rest, out = None, Leftovers(), _Rows(keep_ids)

        def flush() -> pa.RecordBatch:
            return out.batch().select(names)

        for b in batches:
            final = pc.less(b.column("merge"), 0)
            yield b.filter(final).select(names)
            for merge, *piece in zip(*(b.filter(pc.invert(final)).column(n).to_pylist() for n in ("merge", "doc_id", "start", "ids", "doc_tokens", "length"))):
                if number is None:
                    number = (1 << 62) + (merge << 32)  # one that no other task uses: a partition's pieces go to one merging task
                rest.add(tuple(piece))
                while rest.tokens >= length:
                    out.sequence(rest.fill(length), number)
                    number += 1
                if len(out.rows) > 2000:
                    yield flush()
        while rest.tokens:
            out.sequence(rest.fill(_room(rest.tokens, length)), number)
            number += 1
        if out.rows:
            yield flush()

    return run


def _room(tokens: int, length: int) -> int:
    """The next sequence's length: full while there are tokens for it, then the powers of two of the rest."""
    return length if tokens >= length else 1 << max(0, tokens.bit_length() - 1)


def pack(docs: DataFrame, path: str, length: int = LENGTH, open_windows: int = OPEN, keep_ids: bool = True,
         id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids`` (ids: little-endian
    unsigned 32-bit numbers; null unless ``keep_ids``).

    Every id of every document, and the end id after it, lies in exactly one piece. Null and empty texts
    give the end id alone. Repeated rows are packed as often as they occur. An empty table gives no rows.
    Sequences shorter than ``length`` have a power of two of tokens, or (emitted when nothing fitted) are to be
    padded. Null ids are packed like others, but can't be told apart. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    first = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _pack(length, open_windows, path, keep_ids, cache), f"{_SCHEMA}, merge long")
    # finished pieces stay spread; the leftovers of MERGE partitions meet
    dealt = first.withColumn("to", F.when(F.col("merge") < 0, F.col("sequence_id")).otherwise(F.floor(F.col("merge") / MERGE) - F.lit(1 << 40)))
    # in a fixed order, so that a task that is run again cuts the same sequences, and holds one at a time
    return dealt.repartition(partitions(spark), "to").drop("to").sortWithinPartitions("merge", "doc_id", "start", "ids").mapInArrow(_merge(length, keep_ids), _SCHEMA)
