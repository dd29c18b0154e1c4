"""Name lookups with insertion, tag similarity, groups, hierarchy and representatives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import unwritten, written
from .duplicates import CHUNK, similar_names
from .nearest import BLOCK, nearest


def lookup(names: DataFrame, dim: DataFrame) -> DataFrame:
    """``name`` to ``id`` by lower(trim(name)) = lower(stored name), the smallest id if several match, null if none."""
    d = dim.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("id"))
    return names.withColumn("key", F.lower(F.trim("name"))).join(d, "key", "left").drop("key")


def missing_names(names: DataFrame, dim: DataFrame) -> DataFrame:
    """What an insertion would add: one row per new key, ids after the largest, in the order of the keys.

    The keys are dealt out in ranges and numbered in each, after the counts of the ranges before.
    """
    new = names.select(F.lower(F.trim("name")).alias("key"), F.trim("name").alias("name")).join(dim.select(F.lower("name").alias("key")).distinct(), "key", "left_anti").groupBy("key").agg(F.min("name").alias("name"))
    dealt = written(new.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "names")
    top = dim.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    ranges = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))  # a row for each range
    turn = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    return dealt.join(ranges, "part").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("before") + turn).alias("id"), "name")


def tag_pairs(tags: DataFrame, least: float = 85.0) -> DataFrame:
    """Pairs a < b of a tag dimension, in lower case, with an indel ratio of ``least`` or more, and their score."""
    return similar_names(tags.select(F.lower("name").alias("name")), least)


def greedy_groups(tags: DataFrame, least: float = 85.0, chunk: int = CHUNK, apart: DataFrame | None = None, themes: DataFrame | None = None) -> DataFrame:
    """``pos, name`` to ``group_pos, pos, name``: every tag not yet taken takes all later ones like it, in the order of pos.

    ``apart`` (``a, b``, either way round) and ``themes`` (``name``) say which tags a seed can't claim: those of a pair with it,
    and, of a theme and a tag that is none, either one. Names are compared in lower case without outer blanks. A tag that one
    seed can't claim may be claimed by another, or becomes a seed: two tags that are apart can come into one group by a third.

    In rounds: a tag with no earlier one like it that may still be a seed is a seed; what is like a seed and after it is
    taken, by the first such seed. Each round settles at least the first tag that is open.
    """
    t = tags.select("pos", "name", F.lower("name").alias("x"))
    like = similar_names(t.select(F.col("x").alias("name")), least, chunk).select("a", "b")
    same = t.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select(F.col("x").alias("a"), F.col("x").alias("b"))
    ends = lambda c, k: t.select(F.col("x").alias(c), F.col("pos").alias(k))
    edges = like.unionByName(same).join(ends("a", "p"), "a").join(ends("b", "q"), "b").where("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    if apart is not None or themes is not None:
        edges = _free(edges, t, apart, themes)
    edges = written(edges, "edges")
    state = written(t.select("pos", F.lit(0).alias("is")), "state")  # 0 open, 1 seed, 2 taken
    while not state.where("is = 0").isEmpty():
        before = edges.join(state.select(F.col("pos").alias("p"), F.col("is").alias("p_is")), "p").groupBy(F.col("q").alias("pos")).agg(F.max(F.col("p_is") == 1).alias("seeded"), F.max(F.col("p_is") == 0).alias("open"))
        now = F.when(F.col("is") != 0, F.col("is")).when(F.coalesce("seeded", F.lit(False)), 2).when(F.coalesce("open", F.lit(False)), 0).otherwise(1)
        last, state = state, written(state.join(before, "pos", "left").select("pos", now.alias("is")), "state")
        unwritten(last)
    taken = edges.join(state.where("is = 1").select(F.col("pos").alias("p")), "p").groupBy(F.col("q").alias("pos")).agg(F.min("p").alias("group_pos"))
    return t.join(state, "pos").join(taken, "pos", "left").select(F.when(F.col("is") == 1, F.col("pos")).otherwise(F.col("group_pos")).alias("group_pos"), "pos", "name")


def _free(edges: DataFrame, t: DataFrame, apart: DataFrame | None, themes: DataFrame | None) -> DataFrame:
    """The claims that constraints don't block. Both ends are looked up by position, so that no name gathers its edges."""
    plain = lambda c: F.lower(F.trim(c))
    at = t.select("pos", F.trim("x").alias("key"))
    if themes is not None:
        marked = at.join(themes.where("name is not null").select(plain("name").alias("key")).distinct(), "key", "left_semi").select("pos")
        end = lambda c, k: marked.select(F.col("pos").alias(c), F.lit(True).alias(k))
        edges = edges.join(end("p", "p_theme"), "p", "left").join(end("q", "q_theme"), "q", "left").where(F.col("p_theme").eqNullSafe(F.col("q_theme"))).select("p", "q")
    if apart is not None:
        k = apart.where("a is not null and b is not null").select(plain("a").alias("a"), plain("b").alias("b"))
        both = k.join(at.select(F.col("key").alias("a"), F.col("pos").alias("i")), "a").join(at.select(F.col("key").alias("b"), F.col("pos").alias("j")), "b")
        edges = edges.join(both.select(F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q")).distinct(), ["p", "q"], "left_anti")
    return edges


def hierarchy_apart(tags: DataFrame, apart: DataFrame | None = None, themes: DataFrame | None = None, least: float = 85.0) -> DataFrame:
    """Edges parent, child of groups under constraints; the parent is the group's representative: the most used tag, of several the
    first that doesn't end like a plural, else the shortest."""
    g = greedy_groups(tags, least, apart=apart, themes=themes).join(tags.select("pos", "document_count"), "pos")
    chosen = chosen_of(g.withColumn("cluster", F.col("group_pos")))
    parent = chosen.where("rn = 1").select("cluster", F.col("name").alias("parent"))
    return chosen.where("rn > 1").join(parent, "cluster").select("parent", F.col("name").alias("child"))


def hierarchy(tags: DataFrame, least: float = 85.0) -> DataFrame:
    """Edges parent, child: the most used tag of each group (then the shortest, then the first) over the others."""
    g = greedy_groups(tags, least).join(tags.select("pos", "document_count"), "pos")
    w = Window.partitionBy("group_pos").orderBy(F.desc("document_count"), F.length("name"), "pos")
    r = g.withColumn("rn", F.row_number().over(w)).withColumn("parent", F.first("name").over(w))
    return r.where("rn > 1").select("parent", F.col("name").alias("child"))


def best_match(names: DataFrame, tags: DataFrame, least: float = 95.0, block: int = BLOCK) -> DataFrame:
    """The tag of the highest weighted ratio, the first on ties, null below ``least``, and the ratio, of each distinct name. Names and
    dimension meet in blocks, in which bounds leave out most pairs (see ``nearest``)."""
    return nearest(names, tags, block).select("name", F.when(F.col("score") >= least, F.col("tag")).alias("tag"), "score")


def chosen_of(members: DataFrame) -> DataFrame:
    """``cluster, name, document_count, pos`` with ``rn``, 1 for the representative: the most used; of several, the first that
    doesn't end like a plural, else the shortest."""
    plain = ~F.col("name").rlike("(en|er|s|e)$")
    order = [F.desc("document_count"), F.desc(plain), F.when(plain, F.col("pos")), F.length("name"), F.col("pos")]
    return members.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(*order)))


def plural_pairs(tags: DataFrame) -> DataFrame:
    """Pairs a < b of names of which one is the plural of the other: every name's plurals are joined with the names."""
    x = F.lower("name")
    ends = [F.concat(x, F.lit(e)) for e in ("e", "en", "n", "er", "s")]
    vowels = [F.when(x.endswith(s), F.concat(F.left(x, F.length(x) - len(s)), F.lit(t))) for s, t in (("a", "ä"), ("o", "ö"), ("u", "ü"), ("ag", "äge"))]
    plural = tags.select(F.col("name").alias("one"), F.explode(F.array_distinct(F.array_compact(F.array(*ends, *vowels)))).alias("key"))
    return plural.join(tags.select(F.col("name").alias("other"), x.alias("key")), "key").select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).distinct()


def not_to_unify(pairs: DataFrame, known: list[tuple[str, str]], themes: list[str]) -> DataFrame:
    """Pairs without those that are known to differ (either way round) and those of a theme and no theme."""
    k = pairs.sparkSession.createDataFrame([(min(p), max(p)) for p in known], "a string, b string")
    return pairs.where(F.col("a").isin(themes) == F.col("b").isin(themes)).join(F.broadcast(k), ["a", "b"], "left_anti")


ORDER: dict[str, Callable[[], list[Column]]] = {
    "most_used": lambda: [F.desc("document_count"), F.col("name")], "shortest": lambda: [F.length("name"), F.col("name")], "longest": lambda: [F.desc(F.length("name")), F.col("name")],
    "first_created": lambda: [F.asc_nulls_last("created_at"), F.col("name")], "first": lambda: [F.col("pos")]}


def representative(members: DataFrame, strategy: str = "most_used") -> DataFrame:
    """``cluster, name, ...`` with ``rn``: 1 is the representative, the others are to be merged into it."""
    return members.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(*ORDER[strategy]())))


def rewritten(tags: Column, old: str, new: str) -> Column:
    return F.when(F.array_contains(tags, old), F.array_union(F.array_remove(tags, old), F.array(F.lit(new)))).otherwise(tags)
