"""The corpus pipeline: language ID, quality, line dedup, near-dedup, packing. Each stage's rows are written as
Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from papyra.llm import langid, linededup, packing, quality, simhash
from papyra.llm._common import table, written
from papyra.llm.queries import learnable, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without a language: null, empty and letterless texts. The language found becomes ``lang``.

    Each row is decided on its own: repeated rows, repeated and null ids all keep their own text's outcome, ties go to
    the language that sorts first. An empty table gives none; columns beyond those of documents are dropped. Where
    nothing can be learned (no labelled row), nothing has a language.
    """
    learn, _ = learnable(docs)
    found = langid.identify(docs, langid.sample(learn), carry=COLUMNS).where(F.col("lang_pred") != langid.UNDETERMINED)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose perplexity is above the threshold of their language, as the stage before found it.

    Rows are decided as rows: one of two rows of an id may stay. A text at the threshold stays; null and empty texts
    go; without trusted texts all others stay. An empty table gives none; further columns are dropped.
    """
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    # smaller blocks: executors also hold what other stages have left
    return quality.classify(docs, trusted, carry=COLUMNS, block_chars=2_500_000).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines; every row stays, also if nothing is left of it. ``n_chars`` counts what is left, null for a
    null text. Null sources are a host; repeated rows are pages of their own; further columns are dropped."""
    return linededup.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, the one of the smallest id, of each group of near copies; of repeated ids any one, a null id last.
    Null and empty texts are copies of each other. An empty table gives none; further columns are dropped."""
    return simhash.representatives(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining texts into sequences. Null and empty texts are their end id alone; repeated rows are packed as
    often as they occur; an empty table gives no piece."""
    # executors also hold what the stages before have left: a small cache
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=False, cache=40_000).drop("ids")


STAGES = [("language_id", language_id), ("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: Language ID, the model and packing can't be expressed in SQL; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
