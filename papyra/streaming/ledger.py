"""Running totals of costs as a stream: kept by model and in all, across restarts, with one alert when the limit is crossed."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import attach
from .intake import exactly

#: Small state on disk: no room is taken in advance, and batches write what they changed.
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Costs are counted in millionths: sums don't depend on the order.
MICRO = 1_000_000
#: The name of the total of all models.
TOTAL = "total"


class _Ledger(StatefulProcessor):
    """Requests, tokens and millionths of each model so far, and whether its alert was given."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", "requests long, tokens long, micro long, alerted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        requests, tokens, micro, alerted = self.state.get() if self.state.exists() else (0, 0, 0, False)
        for d in rows:
            requests, tokens, micro = requests + int(d["requests"].sum()), tokens + int(d["tokens"].sum()), micro + int(d["micro"].sum())
        crossed = key[0] == TOTAL and not alerted and micro > self.limit
        self.state.update((requests, tokens, micro, bool(alerted or crossed)))
        yield pd.DataFrame({"model": [key[0]], "requests": [requests], "tokens": [tokens], "micro": [micro], "alert": [bool(crossed)]})

    def close(self) -> None:
        pass


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows, summed by model, and their total: few rows for each model reach its state, however many it has."""
    sums: dict[str, list[int]] = {}
    for b in batches:
        t = pa.table({"model": b.column(0), "requests": pa.array([1] * b.num_rows, pa.int64()), "tokens": b.column(1), "micro": b.column(2)})
        for r in t.group_by("model").aggregate([(c, "sum") for c in ("requests", "tokens", "micro")]).to_pylist():
            for name in (r["model"], TOTAL):
                held = sums.setdefault(name, [0, 0, 0])
                for k, c in enumerate(("requests", "tokens", "micro")):
                    held[k] += r[f"{c}_sum"] or 0
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *[pa.array([v[k] for v in sums.values()], pa.int64()) for k in range(3)]], ["model", "requests", "tokens", "micro"])


def totals(usage: DataFrame, limit: float) -> DataFrame:
    """``model, tokens, cost`` as a stream to ``model, requests, tokens, micro, alert``: in each batch a row for every model that
    occurs in it, and one of the total, with the sums since the beginning. ``alert`` is true once, in the batch in which the total
    passes ``limit``. A null model is ``unknown``; a model called ``total`` is an error. Null tokens and costs count as none.
    """
    name = F.coalesce("model", F.lit("unknown"))
    named = F.when(name == TOTAL, F.raise_error(F.lit("a model can't be called total"))).otherwise(name)
    micro = F.bround(F.coalesce(F.col("cost").cast("decimal(24,6)"), F.lit(0)) * MICRO, 0).cast("long")
    rows = usage.select(named.alias("model"), F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens"), micro.alias("micro"))
    added = rows.mapInArrow(_added, "model string, requests long, tokens long, micro long")
    return added.groupBy("model").transformWithStateInPandas(_Ledger(int(Decimal(str(limit)) * MICRO)), "model string, requests long, tokens long, micro long, alert boolean", "Update", "None")


def usage(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """The Parquet files of requests at ``path`` as they come, some files a batch."""
    return attach(spark).readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(exactly(path))


def kept(stream: DataFrame, limit: float, out: str, checkpoint: str) -> DataFrame:
    """Adds what has come since the last run and ends. Returns ``model, requests, tokens, cost, alerts`` as they stand now, over all runs."""
    spark = attach(stream.sparkSession)
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        d = totals(stream, limit)
        # a batch that runs again writes its own folder again
        d.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
            lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/at={n}")).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    told = spark.read.schema("model string, requests long, tokens long, micro long, alert boolean, batch long").parquet(f"{out}/at=*")
    last = F.max(F.struct("batch", "requests", "tokens", "micro")).alias("l")
    return told.groupBy("model").agg(last, F.count_if("alert").alias("alerts")).select(
        "model", "l.requests", "l.tokens", F.bround((F.col("l.micro").cast("decimal(24,6)") / MICRO), 4).cast("double").alias("cost"), "alerts")
