"""Byte-level BPE over a lexicon of frequent words.

The most frequent pre-tokens are compiled, with their ids, into a minimal acyclic transducer: a shared-suffix
automaton (Daciuk et al. 2000) whose arcs carry numbers that add up to a word's rank, which leads to its ids.
Workers map its file into memory. Words that it lacks are merged exactly. Decoding concatenates token bytes.
"""

from __future__ import annotations

import heapq
import io
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._common import Places, rarely_collect, release, resident, slices, strings, temporary, written

#: Words in the lexicon: it bounds what is broadcast, and changes speed only, not results.
LEXICON_WORDS = 100_000
#: Words that occur less often are not called frequent.
MIN_COUNT = 5
#: Characters of a word in the lexicon.
WORD_CHARS = 32
_NEVER = (1 << 60, -1)
_SPACES = [chr(c) + " " for c in (*range(9, 14), *range(28, 33))]
_SIGNS = (".", ",", "!", "?", ":", ";")
_ALL_SPACES = [chr(c) + " " for c in range(0x110000) if chr(c).isspace()]
# Fixed: the pre-tokenisation pattern of byte-level BPE files of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such files: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Merges and token bytes of a tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        letters = byte_letters()
        vocab = d["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.single = [0] * 256
        for i, t in enumerate(self.bytes):
            if len(t) == 1:
                self.single[t[0]] = i
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(d["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.pattern = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        letter, number, space = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
        self.quick = re.compile(rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        self.latin = re.compile(r"[\x00-\xff]*").fullmatch
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None

    def split(self, text: str) -> list[str]:
        """Pre-tokens; a special token's string is one of them."""
        find = self.find(text)
        if self.cut is None or not any(t in text for t in self.special):
            return find(text)
        return [w for k, part in enumerate(self.cut.split(text)) for w in ([part] if k % 2 else find(part))]

    def find(self, text: str):
        """The same pattern with plain classes for texts of Latin-1, which is twice as fast."""
        return self.quick if text.isascii() or self.latin(text) else self.pattern.findall

    def cut_at_spaces(self, text: str | None) -> tuple[list[str], str | None]:
        """Pre-tokens of a text's start, and what follows its first space, which may be cut at its spaces.

        Where no space follows white space, every space begins a pre-token, so what lies between spaces can be
        encoded on its own; other texts, and those with special tokens, are cut into pre-tokens as a whole.
        """
        if not text:
            return [], None
        if any(w in text for w in (_SPACES if text.isascii() else _ALL_SPACES)) or any(t in text for t in self.special):
            return self.split(text), None
        head, space, rest = text.partition(" ")
        return self.find(head)(head), rest if space else None

    def words(self, chunk: str) -> list[str]:
        """Pre-tokens of a space and what follows it up to the next one."""
        if chunk.isascii():
            if chunk.isalpha():
                return [" " + chunk]
            if chunk[-1:] in _SIGNS and chunk[:-1].isalpha():
                return [" " + chunk[:-1], chunk[-1]]
        return self.find(chunk)(" " + chunk)

    def merged(self, word: bytes) -> list[int]:
        """Ids of one word: the adjacent pair of lowest rank is merged, leftmost first, until none is left.

        A heap over a linked list, or a plain search in short words.
        """
        ids = [self.single[b] for b in word]
        get = self.merge.get
        if len(ids) > 48:
            return self._merged_long(ids)
        rank = [get(a << 32 | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while rank:
            best = min(rank)
            if best is _NEVER:
                break
            k = rank.index(best)
            ids[k:k + 2] = [best[1]]
            del rank[k]
            if k:
                rank[k - 1] = get(ids[k - 1] << 32 | ids[k], _NEVER)
            if k < len(rank):
                rank[k] = get(ids[k] << 32 | ids[k + 1], _NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for long words."""
        n, get = len(ids), self.merge.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(a: int) -> None:
            if a >= 0 and after[a] >= 0 and (m := get(ids[a] << 32 | ids[after[a]])):
                heapq.heappush(heap, (m[0], a, ids[a], ids[after[a]], m[1]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, left, right, new = heapq.heappop(heap)
            if ids[a] != left or after[a] < 0 or ids[after[a]] != right:
                continue
            b = after[a]
            ids[a], ids[b] = new, -1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            after[b] = -1
            offer(before[a])
            offer(a)
        return [i for i in ids if i >= 0]

    def ids(self, word: str) -> list[int]:
        return [self.special[word]] if word in self.special else self.merged(word.encode("utf-8", "surrogatepass"))


class Merger:
    """The same merges for many words at once: in each step every word merges its leftmost pair of lowest rank.

    Words lie as rows of a matrix with links to the next and the previous live place; the merges are looked up in a
    hash table.
    """

    SHORT = (8, 16, 32)
    _DEAD = np.int32(1 << 30)

    def __init__(self, v: Vocabulary):
        self.v = v
        self.pairs = Places(np.fromiter(v.merge, np.int64, len(v.merge)))
        # the last entries are those of pairs that don't merge
        self.rank, self.new = (np.array([*(m[k] for m in v.merge.values()), none], np.int32) for k, none in ((0, self._DEAD), (1, -1)))
        self.single = np.array(v.single, np.int32)

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs; the rank of a pair that doesn't merge is ``_DEAD``."""
        at = self.pairs.find(a.astype(np.int64) << 32 | b)
        return self.rank[at], self.new[at]

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word as 32-bit little-endian numbers."""
        out: list[bytes] = [b""] * len(words)
        n = np.fromiter(map(len, words), np.int64, len(words))
        least = 1
        for most in self.SHORT:
            which = np.flatnonzero((n >= least) & (n <= most))
            for at in range(0, len(which), 20_000):
                some = which[at:at + 20_000]
                flat, count = self._rows([words[k] for k in some.tolist()], n[some], most)
                raw, cut = flat.tobytes(), [0, *(4 * np.cumsum(count)).tolist()]
                for k, a, b in zip(some.tolist(), cut, cut[1:]):
                    out[k] = raw[a:b]
            least = most + 1
        for k in np.flatnonzero(n >= least).tolist():
            out[k] = np.array(self.v.merged(words[k]), "<i4").tobytes()
        return out

    def _rows(self, words: list[bytes], n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(words)
        ids = np.full((m, width + 1), -1, np.int32)
        row = np.repeat(np.arange(m), n)
        ids[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        rank, new = np.full((m, width), self._DEAD, np.int32), np.zeros((m, width), np.int32)
        pair = ids[:, 1:] >= 0
        rank[pair], new[pair] = self._find(ids[:, :-1][pair], ids[:, 1:][pair])
        after = np.tile(np.arange(1, width + 2, dtype=np.int8), (m, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int8), (m, 1))
        live = np.arange(m)
        while len(live):
            k = rank[live].argmin(axis=1)
            go = rank[live, k] < self._DEAD
            live, k = live[go], k[go]
            b = after[live, k].astype(np.int64)
            c = after[live, b].astype(np.int64)
            ids[live, k] = new[live, k]
            ids[live, b] = -1
            after[live, k] = c
            rank[live, k] = self._DEAD
            more = b < width
            rank[live[more], b[more]] = self._DEAD
            right = np.flatnonzero((c <= width) & (ids[live, np.minimum(c, width)] >= 0))
            r, kr, cr = live[right], k[right], c[right]
            before[r, np.minimum(cr, width - 1)] = kr
            rank[r, kr], new[r, kr] = self._find(ids[r, kr], ids[r, cr])
            p = before[live, k].astype(np.int64)
            left = np.flatnonzero(p >= 0)
            r, kl, pl = live[left], k[left], p[left]
            rank[r, pl], new[r, pl] = self._find(ids[r, pl], ids[r, kl])
        keep = ids >= 0
        return ids[keep].astype("<i4"), keep.sum(axis=1)


def build_transducer(entries: dict[bytes, list[int]]) -> bytes:
    """An .npz-like file of plain arrays: arcs sorted by (state, byte), the sums on arcs, final states, ids by rank."""
    words = sorted(w for w in entries if w)
    states: list[tuple[bool, tuple]] = []
    register: dict[tuple, int] = {}
    path: list[list] = [[False, []]]  # states of the current word: [final, [(byte, state)]]

    def freeze(down_to: int, word: bytes) -> None:
        while len(path) > down_to:
            final, arcs = path.pop()
            key = final, tuple(arcs)
            s = register.get(key)
            if s is None:  # an equal state (same continuations) is shared
                s = register[key] = len(states)
                states.append(key)
            path[-1][1].append((word[len(path) - 1], s))

    last = b""
    for w in words:
        common = len(os.path.commonprefix([last, w]))
        freeze(common + 1, last)
        for _ in range(common, len(w)):
            path.append([False, []])
        path[-1][0] = True
        last = w
    freeze(1, last)
    states.append((path[0][0], tuple(path[0][1])))
    count: list[int] = []
    keys, to, add = [], [], []
    for s, (final, arcs) in enumerate(states):  # targets come before their sources
        n = int(final)
        for byte, t in arcs:
            keys.append(s << 8 | byte)
            to.append(t)
            add.append(n)
            n += count[t]
        count.append(n)
    flat = [i for w in words for i in entries[w]]
    arrays = {"keys": np.array(keys, np.int64), "to": np.array(to, np.int32), "add": np.array(add, np.int32),
              "final": np.array([f for f, _ in states], np.uint8), "start": np.cumsum([0, *(len(entries[w]) for w in words)]).astype(np.int32), "ids": np.array(flat, np.int32)}
    head, body, at = {}, io.BytesIO(), 0
    for k, a in arrays.items():
        head[k] = [str(a.dtype), at, len(a)]
        raw = a.tobytes() + b"\0" * (-a.nbytes % 8)
        body.write(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + body.getvalue()


class Transducer:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        m = np.asarray(np.memmap(path, np.uint8, "r"))
        n = int(m[:8].view("<i8")[0])
        self.a = {k: m[8 + n + at:8 + n + at + np.dtype(t).itemsize * size].view(t) for k, (t, at, size) in json.loads(bytes(m[8:8 + n])).items()}
        self.raw = memoryview(self.a["ids"]).cast("B") if len(self.a["ids"]) else memoryview(b"")

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank in the lexicon, -1 if it isn't there; all words walk in step."""
        out = np.full(len(words), -1, np.int64)
        a = self.a
        if not words or not len(a["keys"]):
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        text = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(len(words), len(a["final"]) - 1, np.int64)
        total = np.zeros(len(words), np.int64)
        live = np.flatnonzero(size > 0)
        step = 0
        while len(live):
            ask = state[live] << 8 | text[start[live] + step]
            k = np.searchsorted(a["keys"], ask)
            k[k == len(a["keys"])] = 0
            hit = a["keys"][k] == ask
            live, k = live[hit], k[hit]
            state[live] = a["to"][k]
            total[live] += a["add"][k]
            step += 1
            ends = size[live] == step
            done = live[ends]
            done = done[a["final"][state[done]] == 1]
            out[done] = total[done]
            live = live[~ends]
        return out

    def ids(self, ranks: np.ndarray) -> list[bytes]:
        """Ids of the words of these ranks, as 32-bit little-endian numbers."""
        start = self.a["start"]
        return [bytes(self.raw[a:b]) for a, b in zip((start[ranks] * 4).tolist(), (start[ranks + 1] * 4).tolist())]


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, path: str, lexicon: bytes | None = None, most: int = 500_000):
        self.v, self.most = Vocabulary(path), most
        self.merger = Merger(self.v)
        rarely_collect()
        self.known: dict[str, bytes] = {}  # what lies between two spaces, without the space before it
        self.lexicon = None
        if lexicon:
            f = tempfile.NamedTemporaryFile(prefix="papyra-lexicon-", delete=False)
            with f:
                f.write(lexicon)
            self.lexicon = Transducer(f.name)
            os.unlink(f.name)  # the map stays as long as the process
        self.tokens = pa.array(self.v.bytes, pa.large_binary())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit little-endian numbers.

        Texts are cut at their spaces by Arrow, where that is exact; every distinct chunk is encoded once.
        """
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        heads, rest = zip(*map(self.v.cut_at_spaces, texts)) if texts else ((), ())
        split = pc.split_pattern(pa.array(rest, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        chunks = strings(coded.dictionary)
        new = [c for c in chunks if c not in known]
        words = [self.v.words(c) for c in new]
        all_words = list(set(chain.from_iterable(words)) | set(chain.from_iterable(heads)))
        of = dict(zip(all_words, self._learn(all_words))).__getitem__
        known.update(zip(new, [b"".join(map(of, w)) for w in words]))
        own = pa.array(list(map(known.__getitem__, chunks)), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, own.offset * 8) if len(own) else np.zeros(1, np.int64)
        raw = memoryview(own.buffers()[2] or b"") if len(own) else memoryview(b"")
        cut = ends[np.asarray(split.offsets)].tolist()
        return [b"".join([*map(of, h), raw[a:b]]) for h, a, b in zip(heads, cut, cut[1:])]

    def _learn(self, words: list[str]) -> list[bytes]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[bytes] = [b""] * len(words)
        todo = range(len(words))
        if self.lexicon:
            rank = self.lexicon.ranks(raw)
            hit = np.flatnonzero(rank >= 0)
            for k, i in zip(hit.tolist(), self.lexicon.ids(rank[hit])):
                out[k] = i
            todo = np.flatnonzero(rank < 0).tolist()
        plain = []
        for k in todo:
            if words[k] in self.v.special:
                out[k] = np.array([self.v.special[words[k]]], "<i4").tobytes()
            else:
                plain.append(k)
        for k, i in zip(plain, self.merger.ids([raw[k] for k in plain])):
            out[k] = i
        return out

    def decode(self, ids: list[bytes]) -> pa.Array:
        """Text of each id sequence; bytes that are no UTF-8 become U+FFFD."""
        flat = np.frombuffer(b"".join(ids), "<i4")
        if not len(flat):
            return pa.array([""] * len(ids), pa.large_string())
        taken = self.tokens.take(pa.array(flat))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
        cut = ends[np.r_[0, np.cumsum([len(i) // 4 for i in ids])]]
        raw = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cut.tobytes()), taken.buffers()[2] or pa.py_buffer(b"")])
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())


def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``(word, n)`` over all documents: counted in each task first, by a table that is emptied when it is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        v, count, spaced = Vocabulary(path), Counter(), Counter()

        def flush() -> pa.RecordBatch:
            for c, n in spaced.items():
                for w in v.words(c):
                    count[w] += n
            spaced.clear()
            short = [(w, n) for w, n in count.items() if len(w) <= WORD_CHARS]
            out = pa.RecordBatch.from_arrays([pa.array([w for w, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], ["word", "n"])
            count.clear()
            return out

        for b in batches:
            for at, to in slices(b.column(0)):
                heads, rest = zip(*map(v.cut_at_spaces, strings(b.column(0).slice(at, to - at))))
                for h in heads:
                    count.update(h)
                got = pc.value_counts(pc.split_pattern(pa.array(rest, pa.large_string()), " ").values)
                for c, n in zip(strings(got.field(0)), got.field(1).to_numpy().tolist()):
                    spaced[c] += n
                if len(count) + len(spaced) > 500_000:
                    yield flush()
        yield flush()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame, path: str, most: int = LEXICON_WORDS) -> bytes:
    """Compiled from the most frequent words, as many count steps as give ``most`` words or fewer: only they reach the driver."""
    v = Vocabulary(path)
    with temporary(counts.sparkSession):
        frequent = written(counts.where(F.col("n") >= MIN_COUNT), "words")
        # the number of words by count, in steps of an eighth of a power of two, gives the least count that fits
        steps = frequent.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
        total, least = 0, None
        for r in steps:
            total += r["words"]
            if total > most:
                break
            least = r["step"]
        top = [] if least is None else frequent.where(F.floor(F.log2("n") * 8) >= least).select("word").collect()
    return build_transducer({r["word"].encode(): v.ids(r["word"]) for r in top})


def encode_decode(docs: DataFrame, path: str, compiled: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids`` (array of int), ``decoded``, the text that the ids give back.

    Null counts as empty: no ids, empty text. A special token's string in a text is that token, as in the
    tokenizer library. Repeated rows each give a row, a null id stays null; an empty table gives none; other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(compiled)
    key = "bpe", spark.sparkContext.applicationId, path, hash(compiled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = resident(key, lambda: Codec(path, shared.value))
        for b in batches:
            for at, to in slices(b.column(1)):
                part = b.slice(at, to - at)
                ids = codec.encode(strings(part.column(1)))
                text = codec.decode(ids)
                ends = np.r_[0, np.cumsum([len(i) // 4 for i in ids])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, text.cast(pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string")
