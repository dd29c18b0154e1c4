"""Embedding near-duplicates by an exact metric range join.

Cosine >= t is distance <= r = sqrt(2 - 2t) between unit vectors. Pivots (a bounded sample) part the vectors
into cells; by the triangle inequality, a vector has a partner in another pivot's cell only if it is within r
of the plane between the two pivots and within r of the cell's radius, and only then is it sent there. Each
cell then joins on its own, in blocks: its own vectors against all that were sent to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import partitions, spread_join, written
from .components import least_reached

THRESHOLD = 0.9
#: Own vectors of a cell that one task holds; a larger cell is dealt out in so many parts.
CELL = 8192
#: Most pivots: they are collected and broadcast.
MOST_PIVOTS = 1024
#: Least distance between pivots.
APART = 1e-3


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column
    return np.asarray(flat).reshape(-1, dim)


def valid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v, dim``: vectors of doubles that can link: not null, not empty, all finite, not all zero."""
    return _rows(vectors, id_col, vec_col).where("ok").select("vec_id", "v", F.size("v").alias("dim"))


def _rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v, ok``: whether the vector can link."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).withColumn("ok", F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _spread(pivots: np.ndarray, apart: float = APART) -> np.ndarray:
    """The pivots that are at least ``apart`` from each earlier one that stays: bounds by a shorter gap are mostly rounding."""
    keep: list[int] = []
    for i, p in enumerate(pivots):
        if not keep or np.sqrt(((pivots[keep] - p) ** 2).sum(axis=1)).min() >= apart:
            keep.append(i)
    return pivots[keep]


def _nearest(dim: int, pivots: np.ndarray, radius: float):
    """Each vector's cell, its distance to that pivot, and the other cells where it may have partners.

    A product of unit vectors is off by less than ``2 * dim`` roundings, so its square distance by twice that; the
    bounds allow for it. Distances between pivots are taken from their differences, which don't cancel.
    """
    gap = np.array([np.sqrt(np.maximum(((pivots - p) ** 2).sum(axis=1), 1e-30)) for p in pivots])
    off = 4 * (dim + 8) * float(np.finfo(np.float64).eps)  # of a square distance
    slack = float(np.sqrt(off))  # of a distance: the worst is near zero

    def place(x: np.ndarray, radii: np.ndarray | None = None):
        square = np.maximum(2 - 2 * x @ pivots.T, 0)
        home = square.argmin(axis=1)
        nearest = square[np.arange(len(x)), home]
        d, own = np.sqrt(square), np.sqrt(nearest)
        if radii is None:  # rounding may give a vector another of these as its cell the next time
            return home, d, square <= nearest[:, None] + 4 * off
        plane = (square - nearest[:, None] - 4 * off) / (2 * gap[home])  # at most the distance to the plane between the two pivots
        send = (plane <= radius + slack) & (d <= radii[None, :] + radius + 3 * slack)
        send[np.arange(len(x)), home] = True
        return home, own, send

    return place


def _join_dim(nodes: DataFrame, dim: int, n: int, threshold: float, cell: int) -> tuple[DataFrame, DataFrame]:
    """``nodes(rep, v, weight)`` of one dimension to (``rep, n_links``) and the edges (``a, b``)."""
    spark = nodes.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    k = max(1, min(MOST_PIVOTS, -(-n // cell)))
    rows = nodes.orderBy(F.xxhash64("rep"), "rep").limit(k).select("v").collect()
    pivots = _spread(_unit(np.array([r[0] for r in rows], np.float64)))
    place = _nearest(dim, pivots, radius)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, d, near = place(_unit(_matrix(b.column(0), dim)))
            cells = np.flatnonzero(near.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([d[near[:, c], c].max() for c in cells], pa.float64()), pa.array([int((home == c).sum()) for c in cells], pa.int64())], ["cell", "radius", "n"])

    radii, parts = np.full(len(pivots), -np.inf), np.ones(len(pivots), np.int64)
    for r in nodes.select("v").mapInArrow(measure, "cell int, radius double, n long").groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect():  # a row per pivot
        radii[r["cell"]], parts[r["cell"]] = r["radius"], max(1, -(-r["n"] // cell))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                b = big.slice(at, 2048)
                x = _unit(_matrix(b.column("v"), dim))
                ids, weight = np.asarray(b.column("rep")), np.asarray(b.column("weight"))
                home, _, send = place(x, radii)
                own_part = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                own_part = (own_part % parts[home].astype(np.uint64)).astype(np.int64)
                who, to = np.nonzero(send)
                times = parts[to]
                who, to = np.repeat(who, times), np.repeat(to, times)
                part = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                i = np.r_[np.arange(len(x)), who]
                for a in range(0, len(i), 8192):
                    s = i[a:a + 8192]
                    cells, ps = np.r_[home, to][a:a + 8192], np.r_[own_part, part][a:a + 8192]
                    role = (np.arange(a, a + len(s)) >= len(x)).astype(np.int32)
                    v = pa.FixedSizeListArray.from_arrays(pa.array(x[s].ravel()), dim).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(ps, pa.int32()), pa.array(role, pa.int32()), pa.array(ids[s]), pa.array(weight[s]), v], ["cell", "part", "role", "rep", "weight", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        names = ["rep", "n_links", "a", "b"]

        def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(a), pa.array(b)], names)

        def close() -> Iterator[pa.RecordBatch]:
            ids, _, links, root = own
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links - 1), none, none], names)
            moved = root != np.arange(len(ids))
            if moved.any():
                yield edges(ids[moved], ids[root[moved]])

        for b in batches:
            key = np.asarray(b.column("cell")).astype(np.int64) << 32 | np.asarray(b.column("part"))
            role = np.asarray(b.column("role"))
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (role[1:] != role[:-1])])
            for at, to in zip(cut, np.r_[cut[1:], len(key)]):
                s = b.slice(at, to - at)
                ids, w, x = np.asarray(s.column("rep")), np.asarray(s.column("weight")), _matrix(s.column("v"), dim)
                if key[at] != now:
                    if own is not None:
                        yield from close()
                    now, own = int(key[at]), None
                if role[at] == 0:
                    if own is not None:
                        ids, x = np.r_[own[0], ids], np.r_[own[1], x]
                    own = (ids, x, np.zeros(len(ids), np.int64), np.arange(len(ids)))
                    continue
                if own is None:  # sent to a part that has no vectors of its own
                    continue
                mine, y, links, root = own
                fast = y.astype(np.float32)
                for c in range(0, len(ids), 1024):
                    z = x[c:c + 1024]
                    # single precision, less its rounding error, finds the pairs; double precision decides
                    p, q = np.nonzero(fast @ z.astype(np.float32).T >= np.float32(threshold - 1e-6 * (dim + 8)))
                    ok = np.concatenate([np.einsum("ij,ij->i", y[p[k:k + 65536]], z[q[k:k + 65536]]) >= threshold for k in range(0, len(p), 65536)] or [np.zeros(0, bool)])
                    p, q = p[ok], q[ok]
                    if not len(p):
                        continue
                    links += np.bincount(p, w[c + q], len(links)).astype(np.int64)
                    first = np.full(len(z), len(mine))
                    np.minimum.at(first, q, p)
                    while True:  # own vectors with a common partner belong together
                        u, v = root[p], root[first[q]]
                        if (u == v).all():
                            break
                        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
                        while (root != root[root]).any():
                            root = root[root]
                    linked = first < len(mine)
                    other, rep = ids[c:c + 1024][linked], mine[first[linked]]
                    if (other != rep).any():
                        yield edges(other[other != rep], rep[other != rep])
                own = (mine, y, links, root)
        if own is not None:
            yield from close()

    order = ["cell", "part", "role"]
    dealt = nodes.mapInArrow(deal, "cell int, part int, role int, rep long, weight long, v array<double>")
    found = written(dealt.repartition(partitions(spark), "cell", "part").sortWithinPartitions(*order).mapInArrow(join, "rep long, n_links long, a long, b long"), "emb")
    return found.where("rep is not null").select("rep", "n_links"), found.where("rep is null").select("a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Null, empty and zero vectors and those with null or non-finite components have no link and are their own
    component; vectors of different length don't link. Identical vectors are folded first and count as
    links of each other. Repeated ids each keep their row, with its own vector's links. A row
    without an id links with nothing, and its component is null. An empty table gives no rows; labels and other columns are ignored.
    """
    spark = vectors.sparkSession
    good = written(valid(vectors, id_col, vec_col), "vec")
    # a number for each distinct vector, as ids may repeat; the table fixes it
    copies = written(good.groupBy("dim", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")).withColumn("rep", F.monotonically_increasing_id()), "vecs")
    links, edges = spark.createDataFrame([], "rep long, n_links long"), spark.createDataFrame([], "a long, b long")
    for r in copies.groupBy("dim").count().orderBy("dim").collect():  # a row for each length of vectors
        n, e = _join_dim(copies.where(F.col("dim") == r["dim"]).select("rep", "v", "weight"), r["dim"], r["count"], threshold, cell)
        links, edges = links.unionByName(n), edges.unionByName(e)
    least = least_reached(copies.select(F.col("rep").alias("node"), "first"), edges)
    of = copies.select("v", "rep", "weight").join(links, "rep").join(least, F.col("rep") == F.col("node")).select("v", "n_links", F.col("least").alias("component_id"), "weight")
    found = spread_join(good.select("vec_id", "v"), of, "v", "weight", good.count(), F.array(F.col("vec_id").cast("double"))).select("vec_id", "n_links", "component_id")
    alone = _rows(vectors, id_col, vec_col).where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.expr("vec_id <=> component_id"))
