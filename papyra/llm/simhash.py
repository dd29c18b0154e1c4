"""SimHash near-duplicates: 64-bit fingerprints, compared bit-sliced within exact pigeonhole buckets.

A fingerprint is the bitwise majority over the XXH64 hashes (seed 42) of a text's word shingles. Two
fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` bit blocks, so
pairs are only looked for among fingerprints that share such a set of blocks: no pair is missed. Equal
fingerprints are folded first. Within a bucket, 64 fingerprints lie in one machine word per bit plane;
a query's 64 distances grow by carry-save counters, and a word whose lanes all exceed the radius is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import partitions, spread_join, strings, temporary, written
from .components import least_reached

WORDS = 4
RADIUS = 4
#: Rows of a bucket that one task compares; larger buckets are dealt out as pairs of chunks.
CHUNK = 16384
#: Numbers of dropped rows up to this many are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of one text; null and texts without a word give 0."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - words + 1
    counts = np.zeros(64, np.int64)
    step = 1 << 16
    for at in range(0, n, step):  # bounded memory on very long texts
        some = [digest(joined[a:b], 42) for a, b in zip(starts[at:min(n, at + step)].tolist(), ends[at + words - 1:min(n, at + step) + words - 1].tolist())]
        h = np.array(some, np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, fp as a signed long with the fingerprint's bits. The id may be of any type; numbers are longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in strings(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    own = docs.schema[id_col].dataType if id_col in docs.columns else None
    asked = docs.select((F.col(id_col) if isinstance(own, StructType) else F.col(id_col).cast("long")).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return asked.mapInArrow(run, StructType([asked.schema["doc_id"], StructField("fp", LongType())]))


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of the bit blocks, widths as even as can be."""
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def blocks_for(n: int, radius: int) -> int:
    """Blocks such that a bucket of evenly spread fingerprints holds about a thousand rows or fewer."""
    for extra in range(1, 5):
        if n >> (64 * extra // (radius + extra)) <= 1024:
            return radius + extra
    return radius + 4


def bit_links(fp: np.ndarray, bucket: np.ndarray, radius: int = RADIUS, rows: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of one bucket at ``radius`` bits or fewer, a bounded number of words at a time.

    ``bucket`` holds sorted bucket numbers. Bit planes are stored vertically: planes[w, b] holds bit b of
    the 64 fingerprints of word w.
    """
    n = len(fp)
    if n < 2:
        return
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[edge, n])
    words_of = (size + 63) // 64
    first_word = np.r_[0, np.cumsum(words_of)]
    g = np.repeat(np.arange(len(edge)), size)
    rank = np.arange(n) - edge[g]
    word, lane = first_word[g] + rank // 64, rank % 64
    total = int(first_word[-1])
    start = np.zeros(total, np.int64)
    start[word[lane == 0]] = np.flatnonzero(lane == 0)
    fill = np.bincount(word, minlength=total)
    slot = np.zeros((total, 64), np.uint64)
    slot[word, lane] = fp
    bits = np.unpackbits(slot.view(np.uint8).reshape(total, 64, 8), axis=2, bitorder="little")  # word, lane, bit
    planes = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]
    del bits, slot
    last_word = first_word[g + 1]
    reach = last_word - word  # every item meets its own word and the later ones of its bucket
    reach[(reach == 1) & (lane + 1 >= fill[word])] = 0
    at = 0
    done = np.r_[0, np.cumsum(reach)]
    while at < n:
        to = max(at + 1, int(np.searchsorted(done, done[at] + rows, "right")) - 1)
        k = reach[at:to]
        item = np.repeat(np.arange(at, to), k)
        at = to
        if not len(item):
            continue
        w = word[item] + (np.arange(len(item)) - np.repeat(np.r_[0, np.cumsum(k)][:-1], k))
        # lanes that can't count: not filled, or not after the item itself
        valid = np.where(fill[w] == 64, _FULL, (np.uint64(1) << (fill[w] % 64).astype(np.uint64)) - np.uint64(1))
        own = w == word[item]
        ln = lane[item].astype(np.uint64)
        past = np.where(ln == 63, np.uint64(0), _FULL << np.minimum(ln + np.uint64(1), np.uint64(63)))
        dead = ~np.where(own, valid & past, valid)
        q = fp[item]
        depth = max(1, int(radius).bit_length())
        count = [np.zeros(len(w), np.uint64) for _ in range(depth)]
        for b in range(64):
            ask = np.uint64(0) - ((q >> np.uint64(b)) & np.uint64(1))
            carry = planes[w, b] ^ ask  # lanes that differ in this bit
            for d in range(depth):  # ripple the carries through the vertical counters
                count[d], carry = count[d] ^ carry, count[d] & carry
            dead |= carry | _over(count, radius)
            if b % 4 == 3:
                live = dead != _FULL
                if live.mean() < 0.75:  # abandon words whose lanes all exceed the radius
                    item, w, q, dead = item[live], w[live], q[live], dead[live]
                    count = [c[live] for c in count]
                    if not len(item):
                        break
        live = np.flatnonzero(dead != _FULL)
        if len(live):
            lanes = np.unpackbits((~dead[live]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, l = np.nonzero(lanes)
            yield item[live][r], start[w[live][r]] + l


def _over(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter is larger than ``radius``."""
    over = np.zeros_like(count[0])
    same = np.full_like(count[0], _FULL)
    for d in reversed(range(len(count))):
        if radius >> d & 1:
            same = same & count[d]
        else:
            over |= same & count[d]
            same = same & ~count[d]
    return over


def local_stars(fp: np.ndarray, ids: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its component within the bucket): the links' components, not the pairs."""
    root = np.arange(len(fp))
    linked = np.zeros(len(fp), bool)
    for i, j in bit_links(fp, bucket, radius):
        linked[i] = linked[j] = True
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    linked &= root != np.arange(len(fp))
    return ids[linked], ids[root[linked]]


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``nodes(fp, rep)``, one row per distinct fingerprint, to edges ``(a, b)`` that connect every two
    nodes within ``radius`` bits, directly or through others within it."""
    spark = nodes.sparkSession
    n_nodes = nodes.count()
    blocks = blocks or blocks_for(n_nodes, radius)
    bounds = block_bounds(blocks)
    keys = []
    for n, some in enumerate(combinations(range(blocks), blocks - radius)):
        value = None
        for i in some:
            shift, width = bounds[i]
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
            value = part if value is None else F.shiftleft(value, width).bitwiseOR(part)
        keys.append(F.struct(F.lit(n).alias("band"), value.alias("value")))
    placed = nodes.select("fp", "rep", F.explode(F.array(*keys)).alias("bucket"))
    large = placed.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > chunk).withColumn("parts", F.ceil(F.col("size") / chunk).cast("int"))
    large = written(large, "large")
    if large.isEmpty():
        dealt = placed.select("fp", "rep", "bucket.band", "bucket.value", F.lit(0).alias("ca"), F.lit(0).alias("cb"))
    else:  # a large bucket is compared chunk by chunk, every pair of chunks in some task
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        split = spread_join(placed, large, "bucket", "size", len(keys) * n_nodes, F.struct(F.lit(-1).alias("band"), F.col("fp").alias("value")))
        dealt = split.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own).select(
            "fp", "rep", "bucket.band", "bucket.value", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
            "fp", "rep", "band", "value", F.least("own", "other").alias("ca"), F.greatest("own", "other").alias("cb"))
    order = ["band", "value", "ca", "cb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(cols: list[np.ndarray]) -> pa.RecordBatch:
            fp, ids, *key = cols
            new = np.zeros(len(fp), bool)
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            a, b = local_stars(fp.view(np.uint64), ids, np.cumsum(new), radius)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([np.array(c) for c in batch.columns])
            if sum(len(h[0]) for h in held) < 50_000:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            differs = np.zeros(len(cols[0]), bool)
            for k in cols[2:]:
                differs |= k != k[-1]
            cut = len(differs) - int(np.argmax(differs[::-1])) if differs.any() else 0  # the last group may go on
            if cut:
                yield flush([c[:cut] for c in cols])
            held = [[c[cut:] for c in cols]]
        if held:
            yield flush([np.concatenate(c) for c in zip(*held)])

    return dealt.repartition(partitions(spark), *order).sortWithinPartitions(*order).select("fp", "rep", *order).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    Null, empty and word-less texts have fingerprint zero and are linked like any other. Texts with fewer
    words than a shingle are one shingle. Repeated ids each keep their row; the component is that of the row's own
    fingerprint. Null ids keep their row and link others; they are the smallest id of no group, and a group of null
    ids alone has a null component. An empty table gives no rows. Columns other than the id and the text are
    ignored, whatever their names.
    """
    fps = written(fingerprints(docs, words, id_col, text_col), "fps")
    # a number for each fingerprint, as ids may repeat or be null; the table fixes it
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).withColumn("rep", F.monotonically_increasing_id()), "fpnodes")
    least = least_reached(nodes.select(F.col("rep").alias("node"), "first"), links(nodes.select("fp", "rep"), radius, blocks, chunk))
    of = nodes.join(least, nodes.rep == least.node).select("fp", "size", F.col("least").alias("component_id"))
    out = spread_join(fps, of, "fp", "size", fps.count(), F.coalesce("doc_id", F.monotonically_increasing_id()))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group that links connect, the row of the smallest id stays; of
    repeated ids any one, a null id only if there is no other. Rows are told apart as rows, not by their ids."""
    row = "__row"
    while row in docs.columns:
        row += "_"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    with temporary(docs.sparkSession) as keep:
        asked = rows.select(order.alias("order"), F.col(text_col).alias("text"))
        fps = written(fingerprints(asked, words, "order", "text").select(F.col("doc_id").alias("order"), F.col("doc_id.row").alias("__row"), "fp"), "fps")
        nodes = written(fps.groupBy("fp").agg(F.min("order").alias("first"), F.count("*").alias("size")).withColumn("rep", F.monotonically_increasing_id()), "fpnodes")
        least = least_reached(nodes.select(F.col("rep").alias("node"), "first"), links(nodes.select("fp", "rep"), radius, blocks, chunk))
        of = nodes.join(least, nodes.rep == least.node).select("fp", "size", F.col("least.row").alias("stays"))
        dropped = keep(written(spread_join(fps.select("__row", "fp"), of, "fp", "size", fps.count(), F.col("__row")).where("__row <> stays").select(F.col("__row").alias(row)), "dropped"))
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, row, "left_anti").drop(row)
