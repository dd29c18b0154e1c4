"""Own aggregations with states that merge: each task folds its rows into a state for every key, states go to a key in two
steps, and nothing but states is moved. A key that holds most rows has a state for each task, not a row for each of its rows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .. import attach
from ..functions.similarity import lcs

#: Keys that a task holds before it sends their states on, and the groups of tasks whose states are merged first.
HELD, GROUPS = 50_000, 64


class Fold(Protocol):
    """A fold over the columns of ``reads``; merging must not depend on the order. States are plain Python values."""

    reads: list[str]
    #: What ``result`` gives, as DDL.
    gives: str

    def start(self) -> Any: ...

    def add(self, state: Any, row: tuple) -> Any: ...

    def merge(self, state: Any, other: Any) -> Any: ...

    def result(self, state: Any) -> tuple: ...


def folded(rows: DataFrame, key: str, fold: Fold) -> DataFrame:
    """``key`` and what the fold gives, a row for each key; a null key is a key. No rows give none."""
    attach(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    state_schema = f"`{key}` {kind}, part int, state binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Any, Any] = {}
        part = TaskContext.get().partitionId() % GROUPS

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), arrow), pa.array([part] * len(held), pa.int32()), pa.array([pickle.dumps(v) for v in held.values()], pa.binary())], [key, "part", "state"])
            held.clear()
            return out

        for b in batches:
            arrow = b.column(0).type
            for k, *row in zip(*[c.to_pylist() for c in b.columns]):
                held[k] = fold.add(held[k] if k in held else fold.start(), tuple(row))
            if len(held) >= HELD:
                yield sent()
        if held:
            yield sent()

    def merged(states: pd.Series) -> Any:
        out = None
        for raw in states:
            state = pickle.loads(raw)
            out = state if out is None else fold.merge(out, state)
        return out

    def some(d: pd.DataFrame) -> pd.DataFrame:
        return d.iloc[:1].assign(state=[pickle.dumps(merged(d["state"]))])

    def whole(d: pd.DataFrame) -> pd.DataFrame:
        out = d.iloc[:1][[key]].copy()
        for name, value in zip(names, fold.result(merged(d["state"]))):
            out[name] = [value]
        return out

    names = [c.strip().split(" ")[0] for c in fold.gives.split(",")]
    parts = rows.select(key, *fold.reads).mapInArrow(partial, state_schema)
    first = parts.groupBy(key, "part").applyInPandas(some, state_schema)
    return first.groupBy(key).applyInPandas(whole, f"`{key}` {kind}, {fold.gives}")


class Likeness:
    """``name, representative`` of the members of a cluster: how alike they are to it, in lower case. The sum of ratios is kept as
    fractions by their denominators, so that it doesn't depend on the order."""

    reads = ["name", "representative"]
    gives = "size long, compared long, least double, most double, mean double"

    def start(self) -> dict:
        return {"size": 0, "compared": 0, "least": None, "most": None, "sums": {}}

    def add(self, state: dict, row: tuple) -> dict:
        name, chosen = row
        state["size"] += 1
        if name is None or chosen is None or name == chosen:  # the representative itself is not compared
            return state
        a, b = name.lower(), chosen.lower()
        n = len(a) + len(b)
        common = lcs(a, b)
        ratio = 200.0 * common / n if n else 100.0
        state["compared"] += 1
        state["least"] = ratio if state["least"] is None else min(ratio, state["least"])
        state["most"] = ratio if state["most"] is None else max(ratio, state["most"])
        state["sums"][n] = state["sums"].get(n, 0) + (common if n else 1)
        return state

    def merge(self, state: dict, other: dict) -> dict:
        for k in ("size", "compared"):
            state[k] += other[k]
        for k, pick in (("least", min), ("most", max)):
            both = [v for v in (state[k], other[k]) if v is not None]
            state[k] = pick(both) if both else None
        for n, s in other["sums"].items():
            state["sums"][n] = state["sums"].get(n, 0) + s
        return state

    def result(self, state: dict) -> tuple:
        total = sum((200.0 * s / n if n else 100.0 * s) for n, s in sorted(state["sums"].items()))
        return state["size"], state["compared"], state["least"], state["most"], total / state["compared"] if state["compared"] else None


class Tree:
    """``child, documents`` of a parent's edges: a level of a hierarchy, with its distinct children in order. The state is bounded by a
    parent's distinct children, as its row in the result is."""

    reads = ["child", "documents"]
    gives = "children array<string>, documents long"

    def start(self) -> dict:
        return {}

    def add(self, state: dict, row: tuple) -> dict:
        if row[0] is not None:
            state[row[0]] = state.get(row[0], 0) + (row[1] or 0)
        return state

    def merge(self, state: dict, other: dict) -> dict:
        for child, n in other.items():
            state[child] = state.get(child, 0) + n
        return state

    def result(self, state: dict) -> tuple:
        return sorted(state), sum(state.values())


def likeness(members: DataFrame) -> DataFrame:
    """``cluster, name, representative`` to ``cluster, size, compared, least, most, mean``: indel ratios to the representative."""
    return folded(members, "cluster", Likeness())


def tree(edges: DataFrame) -> DataFrame:
    """``parent, child, documents`` to ``parent, children, documents``."""
    return folded(edges, "parent", Tree())


def tag_analysis(members: DataFrame, total_tags: DataFrame, safe: float = 95.0) -> DataFrame:
    """Of ``cluster, name, representative`` one row of measures: clusters, their sizes, likeness, and the merges that are safe, those of
    clusters whose members are all like their representative to ``safe``. ``total_tags``: a row for each tag, which are counted."""
    c = likeness(members).where("size > 1")
    n = total_tags.agg(F.greatest(F.lit(1), F.count("*")).alias("total"))
    d = c.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("size"), F.lit(0)).alias("clustered"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("removable"), F.min("size").alias("smallest"), F.max("size").alias("largest"),
              F.avg("size").alias("mean_size"), F.avg("mean").alias("mean_similarity"), F.count_if(F.col("least") >= safe).alias("safe_merges")).crossJoin(F.broadcast(n))
    consistency = F.when(F.col("clusters") == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.coalesce(F.col("mean_similarity"), F.lit(0.0)) / 100)
    organisation = F.when(F.col("clusters") == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - (F.col("mean_size") - 2) / 10))
    return d.select("total", "clusters", "clustered", "removable", "smallest", "largest", "safe_merges", F.bround("mean_similarity", 6).alias("mean_similarity"), F.bround(F.col("clustered") / F.col("total"), 3).alias("duplication"),
                    F.bround(F.col("removable") / F.col("total"), 6).alias("reduction"), F.bround(consistency, 3).alias("consistency"), F.bround(organisation, 3).alias("organisation"), F.bround((consistency + organisation) / 2, 3).alias("overall"))
