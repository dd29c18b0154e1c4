"""Quality filter: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, order 4: a key is four 16-bit codes in one long, so a context is the key
shifted right and a suffix is the key's low bits. Texts are gathered into blocks, written once in compressed
form together with their distinct keys and the trusted texts' counts of them. Counts, discounts and
probabilities are tables, joined on keys (the shards); each block gets back one probability for each of its
distinct keys, and the perplexity of every text is summed there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._common import bucketed, partitions, release, salted_join, strings, temporary, written

ORDER = 4
BITS = 16
#: Characters of text in a block, the unit whose distinct keys are looked up together.
BLOCK_CHARS = 4_000_000
#: Trusted rows up to this many are broadcast as bare ids; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Languages' thresholds up to this many are broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
#: A text is dropped if its perplexity is above this quantile of its language's held-out trusted texts.
QUANTILE = 0.995
#: One trusted text in so many is kept out of the counts and sets the quantiles.
HOLD_OUT = 4
#: Held-out texts from which a language's own threshold is used alone: of fewer, the quantile is little more than their maximum.
LEAST_HELD = 200
_VOCABULARY = 1 << BITS


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys at every character of all texts, and each text's length. Texts start after ORDER - 1 zero codes."""
    pad = "\0" * (ORDER - 1)
    n = np.array([len(t) for t in texts], np.int64)
    c = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint16)  # modulo 1 << BITS
    key = np.zeros(len(c) - ORDER + 1, np.uint64)
    for k in range(ORDER):  # in place: a block's keys are its largest array
        key <<= np.uint64(BITS)
        key |= c[k:len(c) - ORDER + 1 + k]
    # windows that end in the padding before the next text
    keep = np.ones(len(key), bool)
    gap = (np.cumsum(n[:-1]) + np.arange(len(n) - 1) * (ORDER - 1))[:, None] + np.arange(ORDER - 1)
    keep[gap.ravel()] = False
    return key[keep].view(np.int64), n


def _blocks(text_col: str, block_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows to blocks: payload, distinct keys, trusted counts."""
    return lambda batches: _to_blocks(batches, text_col, block_chars)


def _to_blocks(batches: Iterator[pa.RecordBatch], text_col: str, block_chars: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    release()
    squeeze = zstandard.ZstdCompressor(level=5)
    context = TaskContext.get()
    block = (context.partitionId() if context else 0) << 32
    held: list[pa.RecordBatch] = []
    chars = 0

    def flush() -> pa.RecordBatch:
        nonlocal block, held, chars
        t = pa.Table.from_batches(held).combine_chunks()
        texts = [x or "" for x in strings(t.column(text_col))]
        key, n = keys_of(texts)
        del texts
        train = np.asarray(t.column("__trusted")) == 1
        got, count = np.unique(key[np.repeat(train, n)], return_counts=True)
        key.sort()
        distinct = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        del key
        counts = np.zeros(len(distinct), "<u4")
        counts[np.searchsorted(distinct, got)] = count
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        out = pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([squeeze.compress(sink.getvalue().to_pybytes())], pa.binary()),
                                          pa.array([squeeze.compress(np.diff(distinct, prepend=0).astype("<i8").tobytes())], pa.binary()),
                                          pa.array([squeeze.compress(counts.tobytes())], pa.binary())], ["block", "payload", "keys", "counts"])
        block, held, chars = block + 1, [], 0
        return out

    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            held.append(part)
            chars += part.column(text_col).nbytes
            if chars >= block_chars:
                yield flush()
    if held:
        yield flush()
    release()


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    for b in batches:
        for block, keys, counts in zip(*(c.to_pylist() for c in b.columns)):
            k = np.cumsum(np.frombuffer(open_.decompress(keys), "<i8"))
            c = np.frombuffer(open_.decompress(counts), "<u4").astype(np.int64)
            for at in range(0, len(k), 50_000):
                n = len(k[at:at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block), pa.int64()), pa.array(k[at:at + n], pa.int64()), pa.array(c[at:at + n], pa.int64())], ["block", "key", "n"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (block, key, p) to one row per block: log2 p in the order of the keys."""
    now, held = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.concatenate(held).tobytes()], pa.binary())], ["block", "logs"])

    for b in batches:
        block, p = np.asarray(b.column(0)), np.log2(np.asarray(b.column(2)))
        edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, z in zip(edge, np.r_[edge[1:], len(block)]):
            if now is not None and block[a] != now:
                yield out()
                held = []
            now = int(block[a])
            held.append(p[a:z].astype("<f4"))
    if now is not None:
        yield out()


def _sums(text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks with their logs to rows: what was kept of them, and the perplexity."""
    return lambda batches: _to_rows(batches, text_col)


def _to_rows(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    import zstandard

    release()
    open_ = zstandard.ZstdDecompressor()
    for b in batches:
        for payload, logs in zip(b.column("payload"), b.column("logs")):
            t = pa.ipc.open_stream(open_.decompress(payload.as_py())).read_all().combine_chunks()
            key, n = keys_of([x or "" for x in strings(t.column(text_col))])
            total = np.zeros(len(n))
            if len(key):
                log = np.frombuffer(logs.as_py(), "<f4")[np.searchsorted(np.unique(key), key)]
                del key
                full = n > 0
                total[full] = np.add.reduceat(log, (np.cumsum(n) - n)[full], dtype=np.float64)
            with np.errstate(invalid="ignore", divide="ignore"):
                ppl = np.exp2(-total / n)
            t = t.append_column("perplexity", pa.array(ppl, pa.float64(), mask=n == 0))
            for out in t.drop_columns(["__text"] if text_col == "__text" else []).to_batches(max_chunksize=1000):
                yield out
            del t, n, total, ppl
    release()


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of an order from its counts of counts (Chen and Goodman 1999), kept within 0..count."""
    r = counts.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (int(x or 0) for x in r)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [k - (k + 1) * y * b / a if a and b else y * k for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
    return tuple(min(k - 0.05, max(0.05, x)) for k, x in enumerate(d, 1))


def probabilities(counts: DataFrame) -> DataFrame:
    """``counts(key, n)``, n the trusted count or 0, to ``(key, p)`` for every key.

    p interpolates down to single characters and from there to the uniform distribution; lower orders
    use the number of distinct left neighbours as counts.
    """
    table = counts.where("n > 0").select("key", F.col("n").alias("c"))
    ask = counts.select("key")
    levels = []
    for order in range(ORDER, 0, -1):
        d1, d2, d3 = discounts(table)
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = F.shiftrightunsigned("key", BITS) if order > 1 else F.lit(0).cast("long")
        # whole numbers are added up, and multiplied by the discounts once: no sum depends on the order of its parts
        some = [F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.count_if(F.col("c") > 2)]
        sums = table.groupBy(context.alias("ctx")).agg(F.sum("c").alias("total"), (some[0] * F.lit(d1) + some[1] * F.lit(d2) + some[2] * F.lit(d3)).alias("freed"))
        suffix = F.col("key").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))
        levels.append((ask, table.select("key", (F.col("c") - cut).alias("rest")), sums, context, suffix))
        if order > 1:
            table = written(table.groupBy(suffix.alias("key")).agg(F.count("*").alias("c")), "kn")
            ask = written(ask.select(suffix.alias("key")).distinct(), "kn")
    p = None
    for ask, rest, sums, context, suffix in reversed(levels):
        a = ask.select("key", context.alias("ctx"), suffix.alias("low")).join(rest, "key", "left").join(sums, "ctx", "left")
        lower: Column = F.lit(1.0 / _VOCABULARY)
        if p is not None:
            a = a.join(p.select(F.col("key").alias("low"), F.col("p").alias("q")), "low")
            lower = F.col("q")
        p = a.select("key", F.when(F.col("total").isNull(), lower).otherwise((F.coalesce("rest", F.lit(0.0)) + F.col("freed") * lower) / F.col("total")).alias("p"))
        p = written(p, "kn")
    return p


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, lang, trusted, perplexity`` per document, or, instead of the first three, the columns to ``carry`` and
    ``__lang, __trusted``. ``trusted(doc_id)``: rows whose text is trusted.

    trusted: 1 counted, 2 held out, 0 not trusted. Null and empty texts have null perplexity.
    """
    ids = trusted.select(F.col(id_col).cast("long").alias("__id")).where("__id is not null").distinct().withColumn(
        "__trusted", F.when(F.pmod(F.xxhash64("__id"), F.lit(HOLD_OUT)) == 0, 2).otherwise(1))
    ids = written(ids, "trusted")
    keep = [F.col(id_col).cast("long").alias("doc_id")] if carry is None else [F.col(c) for c in carry]
    own = text_col if carry and text_col in carry and dict(docs.dtypes)[text_col] == "string" else "__text"
    text = [] if own == text_col else [F.col(text_col).cast("string").alias("__text")]
    number = F.col(id_col).cast("long")
    rows = docs.select(*keep, *text, F.col(lang_col).cast("string").alias("__lang"), number.alias("__id"))
    if ids.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(ids), "__id", "left")
    else:  # rows without an id are spread in the shuffle
        key = F.struct(F.col("__id").isNull().alias("none"), F.coalesce("__id", F.monotonically_increasing_id()).alias("id"))
        rows = rows.withColumn("__key", key).join(ids.select(F.struct(F.lit(False).alias("none"), F.col("__id").alias("id")).alias("__key"), "__trusted"), "__key", "left").drop("__key")
    rows = rows.drop("__id").withColumn("__trusted", F.coalesce("__trusted", F.lit(0)))
    blocks = bucketed(rows.mapInArrow(_blocks(own, block_chars), "block long, payload binary, keys binary, counts binary"), "blocks", "block")
    each = blocks.select("block", "keys", "counts").mapInArrow(_expand, "block long, key long, n long")
    p = probabilities(written(each.groupBy("key").agg(F.sum("n").alias("n")), "counts"))
    back = each.select("block", "key").join(p.hint("merge"), "key").repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "key").select("block", "key", "p")
    # written, so that a task needs one Python worker at a time
    logs = written(back.mapInArrow(_gather, "block long, logs binary"), "logs").hint("merge")  # the blocks lie in buckets: only the logs move
    out = StructType([*rows.drop("__text").schema.fields, StructField("perplexity", DoubleType())])
    scored = blocks.select("block", "payload").join(logs, "block", "left").select("payload", "logs").mapInArrow(_sums(own), out)
    return scored if carry is not None else scored.withColumnsRenamed({"__lang": "lang", "__trusted": "trusted"})


def quantiles(values: DataFrame, quantile: float) -> DataFrame:
    """``key, value`` to ``key, n, bound``: the least value that is not below the share ``quantile`` of a key's ``n`` values.

    Exact: distinct values are counted, dealt out in ranges, and only the range that holds the rank is looked into.
    """
    spark = values.sparkSession
    counted = values.groupBy("key", "value").agg(F.count("*").alias("n"))
    dealt = written(counted.repartitionByRange(partitions(spark), "key", "value").withColumn("part", F.spark_partition_id()), "ranks")
    of_key = Window.partitionBy("key")
    parts = dealt.groupBy("key", "part").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(of_key.orderBy("part"))).withColumn("total", F.sum("n").over(of_key))
    rank = F.greatest(F.lit(1), F.ceil(F.col("total") * quantile))
    hit = parts.withColumn("rank", rank).where((F.col("upto") - F.col("n") < F.col("rank")) & (F.col("upto") >= F.col("rank"))).select("key", "part", (F.col("upto") - F.col("n")).alias("before"), "rank", "total")
    inside = dealt.join(hit, ["key", "part"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("key", "part").orderBy("value")))
    return inside.where("upto >= rank").groupBy("key").agg(F.max("total").alias("n"), F.min("value").alias("bound"))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: ``doc_id, lang`` (or the columns to ``carry``)``, perplexity, threshold, kept``.

    The threshold is the exact quantile of the language's held-out trusted texts; a language (null is one) with fewer
    than ``LEAST_HELD`` of them takes the larger of its own and that of all, one without any that of all. A text at the
    threshold is kept. Without any trusted text, nothing is dropped but what has no text: null and empty texts
    are never kept. Repeated rows each give a row; an empty table none; a null id is never trusted. Extra columns
    are ignored. The result does not depend on how the rows are dealt out.
    """
    with temporary(docs.sparkSession) as keep:
        scored = keep(written(perplexities(docs, trusted, id_col, text_col, lang_col, carry, block_chars), "ppl"))
    lang, told = (F.col("lang"), F.col("trusted")) if carry is None else (F.col("__lang"), F.col("__trusted"))
    held = scored.where((told == 2) & F.col("perplexity").isNotNull())
    key = F.explode(F.array(F.struct(F.lit(True).alias("every"), F.lit("").alias("lang"), F.lit(False).alias("none")),
                            F.struct(F.lit(False).alias("every"), F.coalesce(lang, F.lit("")).alias("lang"), lang.isNull().alias("none"))))
    with temporary(docs.sparkSession) as keep:
        bounds = keep(written(quantiles(held.select(key.alias("key"), F.col("perplexity").alias("value")), quantile), "bounds"))
    every = bounds.where("key.every").select("bound").first()
    own = bounds.where("not key.every").select(F.when(F.col("key.none"), None).otherwise(F.col("key.lang")).alias("__l"), F.col("n").alias("__held"), F.col("bound").alias("__own"))
    same = lang.eqNullSafe(F.col("__l"))
    out = scored.join(F.broadcast(own), same, "left") if own.count() <= BROADCAST_LANGUAGES else salted_join(scored, own, same, F.monotonically_increasing_id(), "left")
    overall = F.lit(every[0] if every else None).cast("double")
    bound = F.when(F.col("__held") >= LEAST_HELD, F.col("__own")).otherwise(F.greatest("__own", overall))  # greatest skips nulls
    return out.withColumn("threshold", bound).withColumn("kept", F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))).drop(
        "trusted" if carry is None else "__trusted", "__lang", "__l", "__held", "__own")
