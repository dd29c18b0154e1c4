"""The prefix trie of conversations, built as a Patricia trie.

A prefix of a conversation is known by its depth and a digest: the XOR of the digests of its turns, each with its place,
so that prefixes of long conversations are made in parts. Equal prefixes are brought together, and only those where a
conversation ends, where conversations part, or the root become points; edges between them are compressed.
Of equal conversations one stands for all. Numbers of leaves and saved tokens are summed on the compressed tree:
every representative adds its edges to the points above them on its own path, so that nothing is passed from level to level.
A point on a path means another conversation that shares the path so far: of n rows a path has at most about
sqrt(2 n) points. In the end, unary nodes are expanded from the edges, by suffix sums along them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import partitions, spread_join, strings, written

#: A conversation's first turns may come from the first conversation of its block of this many ids, at most ``SHARED - 1`` of them.
BLOCK, SHARED = 100, 6
#: Ids whose decimals are joined to one string before they go to the task that digests a node's members.
CHUNK = 4096
KEY = ["depth", "g1", "g2"]


def _shared(conv: Column) -> Column:
    return (F.crc32(F.encode(conv.cast("string"), "utf-8")) % SHARED).cast("int")


def _before(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``conv, part`` and, for each part of a conversation, ``sums`` over its parts before: a row for each part, not for each turn."""
    w = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    kinds = {"sum": F.sum, "xor": F.bit_xor}
    return rows.groupBy("conv", "part").agg(*[c.alias(k) for k, c in sums.items()]).select(
        "conv", "part", *[F.coalesce(kinds["xor" if k[0] == "g" else "sum"](k).over(w), F.lit(0)).cast("long").alias(f"{k}_before") for k in sums])


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Each conversation with the first h turns of its block's first one in place of its own: ``conv, part, depth, digest, chars``,
    and ``conv, length``, also of those without a turn. h is the CRC-32 of its decimal id modulo 6.

    Turns are dealt out in ranges of (conversation, turn, role, text) and counted in each, so that those of one long
    conversation needn't meet in a task.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    kind = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    order = ["conv", "turn", "role", "by_text", "salt"]
    # equal turns of a conversation, in any order among themselves, are the same turns
    rows = rows.select("conv", "turn", "role", F.col("text").alias("by_text"), kind.alias("digest"), F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("salt"))
    dealt = rows.repartitionByRange(partitions(turns.sparkSession), *order).withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order[1:]))
    placed = written(dealt.select("conv", "part", place.alias("place"), "digest", "chars"), "turns")
    first = F.col("conv") % BLOCK == 0
    size = placed.groupBy("conv").agg(F.count("*").alias("size"))
    heads = size.where(first).select(F.col("conv").alias("base"), F.least("size", F.lit(SHARED)).alias("there"))
    taken = F.least(F.coalesce("there", F.lit(0)), _shared(F.col("conv")))
    of = size.withColumn("base", F.col("conv") - F.col("conv") % BLOCK).join(heads, "base", "left").select("conv", "base", "size", taken.cast("long").alias("taken"))
    shift = _before(placed, {"rows": F.count("*")}).join(of, "conv").select("conv", "part", "rows_before", "taken")
    own = placed.join(shift, ["conv", "part"]).withColumn("at", F.col("place") + F.col("rows_before")).where(F.col("at") > _shared(F.col("conv")))
    own = own.select("conv", "part", (F.col("at") - _shared(F.col("conv")) + F.col("taken")).alias("depth"), "digest", "chars")
    begins = placed.where(first).join(shift.where(first), ["conv", "part"]).withColumn("at", F.col("place") + F.col("rows_before")).where(F.col("at") < SHARED)
    begins = begins.select(F.col("conv").alias("base"), "at", "digest", "chars")
    lent = of.join(begins, "base").where(F.col("at") <= F.col("taken")).select("conv", F.lit(-1).alias("part"), F.col("at").cast("long").alias("depth"), "digest", "chars")
    length = F.col("taken") + F.greatest(F.col("size") - _shared(F.col("conv")), F.lit(0))
    return own.unionByName(lent), of.select("conv", length.alias("length"))


def prefixes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """``conv, depth, g1, g2, p1, p2, chars, upto``: every prefix of every conversation, the one before it (0, 0 before the first
    turn), the code points of its last turn and of all; depth 0 too, with none."""
    tagged = rows.withColumn("t1", F.xxhash64("depth", "digest")).withColumn("t2", F.xxhash64("digest", "depth", F.lit("second")))
    before = _before(tagged, {"g1": F.bit_xor("t1"), "g2": F.bit_xor("t2"), "chars": F.sum("chars")})
    w = Window.partitionBy("conv", "part").orderBy("depth")
    run = tagged.withColumn("g1", F.bit_xor("t1").over(w)).withColumn("g2", F.bit_xor("t2").over(w)).withColumn("upto", F.sum("chars").over(w)).join(before, ["conv", "part"])
    g = [F.col(k).bitwiseXOR(F.col(f"{k}_before")) for k in ("g1", "g2")]
    zero = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    out = run.select("conv", "depth", g[0].alias("g1"), g[1].alias("g2"), g[0].bitwiseXOR(F.col("t1")).alias("p1"), g[1].bitwiseXOR(F.col("t2")).alias("p2"), "chars", (F.col("upto") + F.col("chars_before")).alias("upto"))
    return out.unionByName(lengths.select("conv", *zero("depth", "g1", "g2", "p1", "p2", "chars", "upto")))


def members_digest(ends: DataFrame) -> DataFrame:
    """``conv, depth, g1, g2`` to ``depth, g1, g2, ends_sha256``: of the decimal ids, ascending, joined by commas.

    Ids are dealt out in ranges and joined to strings there; one task reads a node's strings one after the other.
    """
    parts = partitions(ends.sparkSession)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        at = None

        def row() -> tuple:
            return (*at, int(held[0]), ",".join(held))

        for b in batches:
            rows = []
            for *key, conv in zip(*[c.to_pylist() for c in b.columns]):
                if at != key or len(held) >= CHUNK:
                    if held:
                        rows.append(row())
                    at, held = key, []
                held.append(str(conv))
            if rows:
                yield _batch(rows)
        if held:
            yield _batch([row()])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], pa.array([r[4] for r in rows], pa.string())], [*KEY, "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for b in batches:
            rows = []
            for key, ids in zip(zip(*[b.column(k).to_pylist() for k in range(3)]), strings(b.column(4))):
                if key == at:
                    h.update(b"," + ids.encode())
                else:
                    if at is not None:
                        rows.append((*at, h.hexdigest()))
                    at, h = key, hashlib.sha256(ids.encode())
            if rows:
                yield _hashes(rows)
        if at is not None:
            yield _hashes([(*at, h.hexdigest())])

    def _hashes(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], pa.array([r[3] for r in rows], pa.string())], [*KEY, "ends_sha256"])

    kinds = "depth long, g1 long, g2 long, first long, ids string"
    chunks = ends.select(*KEY, "conv").repartitionByRange(parts, *KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(joined, kinds)
    return chunks.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digested, "depth long, g1 long, g2 long, ends_sha256 string")


def compressed(all_prefixes: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The points with their aggregates, the prefixes of the representatives, and every conversation's end as a prefix."""
    ends = all_prefixes.join(lengths, "conv").where(F.col("depth") == F.col("length")).select("conv", *KEY)
    ending = ends.groupBy(*KEY).agg(F.min("conv").alias("rep"))
    nodes = all_prefixes.groupBy(*KEY, "p1", "p2").agg(F.count("*").alias("n"), F.min("conv").alias("lo"))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("g1"), F.col("p2").alias("g2")).agg(F.count("*").alias("children"))
    points = nodes.join(below, KEY, "left").join(ending.withColumn("end", F.lit(True)), KEY, "left").select(
        F.struct(*KEY).alias("key"), "n", "lo", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("end", F.lit(False)).alias("end"))
    points = points.where((F.col("children") != 1) | F.col("end") | (F.col("key.depth") == 0))
    own = written(all_prefixes.join(ending.select(F.col("rep").alias("conv")), "conv", "left_semi").select("conv", F.struct(*KEY).alias("key"), "chars", "upto"), "paths")
    filler = F.struct(F.lit(-1).cast("long").alias("depth"), F.col("conv").alias("g1"), F.col("key.depth").alias("g2"))
    path = spread_join(own, points, "key", "n", all_prefixes.count(), filler).where("n is not null")
    down = Window.partitionBy("conv").orderBy("key.depth")
    up = Window.partitionBy("conv").orderBy(F.desc("key.depth")).rowsBetween(Window.unboundedPreceding, -1)
    path = path.withColumn("above", F.lag(F.struct(F.col("key.depth").alias("depth"), "upto", "lo")).over(down))
    edge = F.when(F.col("lo") == F.col("conv"), (F.col("n") - 1) * (F.col("upto") - F.coalesce("above.upto", F.lit(0)))).otherwise(0)
    path = path.withColumn("edge", edge).withColumn("under", F.coalesce(F.sum("edge").over(up), F.lit(0)))
    path = path.withColumn("leaf", F.max((F.col("children") == 0).cast("long")).over(Window.partitionBy("conv")))
    mine = F.max(F.when(F.col("lo") == F.col("conv"), F.struct("above", "upto", "chars", "n", "lo", "children", "end"))).alias("m")
    return path.groupBy("key").agg(F.sum("leaf").alias("n_leaves"), F.sum("under").alias("under"), mine).select("key", "n_leaves", "under", "m.*"), own, ends


def trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns lie in the order of their number, null first, equal ones by role and text; null roles and texts are empty.
    Rows without a conversation's id belong to none and are left out. A repeated row is a turn of its own. The first
    conversation of a block is the one of the id that c - c % 100 gives, with the sign of c. A conversation without a turn
    is a member of the root alone. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows, lengths = rebuilt(turns, conv_col, turn_col, role_col, text_col)
    lengths = written(lengths, "lengths")
    all_prefixes = written(prefixes(rows, lengths), "prefixes")
    points, own, ends = compressed(all_prefixes, lengths)
    # the nodes of each edge, up to its lower point; all of them lie on the path of the least member
    top = F.coalesce(F.col("above.depth") + 1, F.lit(0).cast("long"))
    nodes = points.withColumn("depth", F.explode(F.sequence(top, F.col("key.depth")))).withColumn("at_point", F.col("depth") == F.col("key.depth"))
    on = own.select(F.col("conv").alias("lo"), F.col("key.depth").alias("depth"), F.col("upto").alias("here"), F.col("chars").alias("last"))
    nodes = nodes.join(on, ["lo", "depth"])
    parent = F.when(F.col("depth") > top, F.col("lo")).otherwise(F.col("above.lo"))
    saved = F.col("under") + (F.col("n") - 1) * (F.col("upto") - F.col("here") + F.col("last"))
    at = F.when(F.col("at_point") & F.col("end"), F.col("key"))
    out = nodes.select(F.col("lo").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(F.col("at_point"), F.col("children")).otherwise(1).cast("long").alias("n_children"),
                       "n_leaves", saved.alias("saved_tokens"), "at_point", "end", at.alias("key"))
    digests = members_digest(ends).select(F.struct(*KEY).alias("key"), "ends_sha256")
    ended = out.where(F.col("key").isNotNull()).join(digests, "key").drop("key", "at_point", "end")
    passed = out.where(F.col("key").isNull()).drop("key", "at_point", "end").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return ended.unionByName(passed)
