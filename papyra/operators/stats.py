"""Corpus, batch, error, cost and rate statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import totals_within


def corpus(docs: DataFrame) -> DataFrame:
    """Counts by correspondent, by type and in all, in one pass."""
    d = docs.select(F.coalesce("correspondent", F.lit("Unassigned")).alias("correspondent"), F.coalesce("document_type", F.lit("Unassigned")).alias("document_type"), F.coalesce(F.length("text") > 0, F.lit(False)).alias("ocr"))
    return d.groupingSets([["correspondent"], ["document_type"], []], "correspondent", "document_type").agg(F.count("*").alias("documents"), F.count_if("ocr").alias("with_ocr"))


def batches(results: DataFrame) -> DataFrame:
    """``batch_id, status, processing_time`` to a row per batch."""
    one = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy("batch_id").agg(F.count("*").alias("processed"), one("completed").alias("successful"), one("failed").alias("failed"), one("skipped").alias("skipped"), F.coalesce(F.try_divide(one("completed"), F.count("*")), F.lit(0.0)).alias("success_rate"))


def batch_times(results: DataFrame) -> DataFrame:
    """``batch_id, started, ended, processing_time`` to each batch's wall time in seconds, null while a row has no end, and the mean time of a document."""
    open_rows = F.count_if(F.col("ended").isNull()) > 0
    wall = (F.unix_micros(F.max("ended")) - F.unix_micros(F.min("started"))) / F.lit(1e6)
    return results.groupBy("batch_id").agg(F.when(~open_rows, F.bround(wall, 3)).alias("wall_seconds"), F.bround(F.avg("processing_time"), 6).alias("mean_time"))


def errors(results: DataFrame) -> DataFrame:
    return results.where("status = 'failed'").groupBy("phase").agg(F.count("*").alias("errors"), F.count_distinct("batch_id").alias("batches"))


def processing(results: DataFrame) -> DataFrame:
    """Over all batches: sums, and the unweighted mean of their success rates."""
    return batches(results).agg(F.count("*").alias("batches"), F.sum("processed").alias("processed"), F.sum("failed").alias("failed"), F.bround(F.avg("success_rate"), 6).alias("mean_rate"))


def error_summary(errors: DataFrame) -> DataFrame:
    """``phase, severity, recoverable`` to a row per phase and per severity that occurs, and the total (both null)."""
    return errors.groupingSets([["phase"], ["severity"], []], "phase", "severity").agg(F.count("*").alias("errors"), F.count_if("recoverable").alias("recoverable"))


def first_critical(errors: DataFrame, most: int = 10) -> DataFrame:
    """The first critical errors, ten by default, by ``error_id``."""
    return errors.where("severity = 'critical'").orderBy("error_id").limit(most)


def common_errors(errors: DataFrame, most: int = 10) -> DataFrame:
    """The commonest ``phase: message``, the message cut to 50 characters."""
    key = F.concat("phase", F.lit(":"), F.left("message", F.lit(50)))
    return errors.groupBy(key.alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(most)


def times(results: DataFrame) -> DataFrame:
    """Mean, least and greatest processing time of a document, and documents a minute, null if that is no time at all."""
    t = F.col("processing_time")
    return results.agg(F.bround(F.avg(t), 6).alias("mean_time"), F.min(t).alias("least_time"), F.max(t).alias("most_time"), F.bround(F.try_divide(F.lit(60.0), F.avg(t)), 6).alias("per_minute"))


def tag_quality(members: DataFrame, tags: DataFrame) -> DataFrame:
    """``cluster, name, similarity`` (of a member to its representative, null for that) to one row of measures; ``tags`` are counted."""
    c = members.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("similarity").alias("mean"))
    n, held = F.greatest(F.lit(1), F.col("total")), F.sum("size")
    d = c.agg(F.count("*").alias("clusters"), held.alias("clustered"), F.sum(F.col("size") - 1).alias("removable"), F.min("size").alias("smallest"), F.max("size").alias("largest"), F.avg("size").alias("mean_size"), F.avg("mean").alias("mean_similarity")).crossJoin(F.broadcast(tags.agg(F.count("*").alias("total"))))
    consistency = F.lit(1.0) - F.coalesce(F.col("mean_similarity"), F.lit(0.0)) / 100
    organisation = F.greatest(F.lit(0.0), F.lit(1.0) - (F.col("mean_size") - 2) / 10)
    return d.select("clusters", "clustered", "removable", "smallest", "largest", F.bround(F.col("clustered") / n, 3).alias("duplication"), F.bround(F.col("removable") / n, 6).alias("reduction"),
                    F.bround(consistency, 3).alias("consistency"), F.bround(organisation, 3).alias("organisation"), F.bround((consistency + organisation) / 2, 3).alias("overall"))


def accounts(mails: DataFrame) -> DataFrame:
    """``account, attachments, failed`` to a row per account and the total (null account)."""
    return mails.rollup("account").agg(F.count("*").alias("processed"), F.sum("attachments").alias("attachments"), F.max(F.col("failed").cast("int")).cast("boolean").alias("has_error"))


def matching(edges: DataFrame) -> DataFrame:
    """A hierarchy ``parent, child``: all tags, roots, unified ones and their rate."""
    names = edges.select(F.col("parent").alias("name"), F.lit(1).alias("root")).union(edges.select("child", F.lit(0)))
    d = names.groupBy("name").agg(F.max("root").alias("root")).agg(F.count("*").alias("tags"), F.sum("root").alias("roots"))
    return d.crossJoin(edges.agg(F.count("*").alias("unified"))).withColumn("rate", F.bround(F.col("unified") / F.greatest("tags", F.lit(1)), 6))


def run_statistics(rows: DataFrame) -> DataFrame:
    """``failed, tag, matched`` to one row: processed, errors, distinct new tags, matches, success in percent."""
    ok = ~F.col("failed")
    return rows.agg(F.count_if(ok).alias("processed"), F.count_if("failed").alias("errors"), F.count_distinct(F.when(ok & ~F.col("matched"), F.col("tag"))).alias("new_tags"),
                    F.count_if(ok & F.col("matched")).alias("matches"), F.bround(F.coalesce(F.try_divide(F.count_if(ok) * 100, F.count("*")), F.lit(0.0)), 1).alias("success_percent"))


def flag_table(flags: DataFrame, names: list[str]) -> DataFrame:
    """A row per flag: how many documents have it, and their percentage."""
    one = flags.agg(F.count("*").alias("all"), *[F.count_if(F.col(n)).alias(n) for n in names])
    return one.select("all", F.explode(F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("documents")) for n in names])).alias("f")).select(
        "f.flag", "f.documents", F.bround(F.coalesce(F.try_divide(F.col("f.documents") * 100, F.col("all")), F.lit(0.0)), 1).alias("percent"))


def ledger(usage: DataFrame, limit: float) -> DataFrame:
    """``model, cost, tokens`` to a row per model and the total (null model); the total has ``alert`` if it is over the limit."""
    d = usage.rollup("model").agg(F.sum(F.col("cost").cast("decimal(18,6)")).alias("sum"), F.sum("tokens").alias("tokens"), F.count("*").alias("requests"))
    return d.select("model", F.bround("sum", 4).cast("double").alias("cost"), "tokens", "requests", (F.col("model").isNull() & (F.col("sum") > limit)).alias("alert"))


def running(usage: DataFrame, key: str, order: str) -> DataFrame:
    """Running count and sum of ``cost`` of each key: an account's own history, in order. ``order`` tells a key's rows apart."""
    d = totals_within(usage.select(key, order, "cost"), [key], [order], {"so_far": F.lit(1).cast("long"), "cost_so_far": F.coalesce(F.col("cost").cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))})
    return d.select(key, order, "so_far", F.bround("cost_so_far", 4).cast("double").alias("cost_so_far"))


def costs(usage: DataFrame) -> DataFrame:
    """``model, cost, requests``: a row per model and the total (null model)."""
    return usage.rollup("model").agg(F.count("*").alias("requests"), F.bround(F.sum(F.col("cost").cast("decimal(18,6)")), 4).cast("double").alias("cost"))


def request_rate(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Requests of the same user in the time up to each one."""
    w = Window.partitionBy("user_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-seconds, 0)
    return events.select("event_id", F.count("*").over(w).alias("recent"))
