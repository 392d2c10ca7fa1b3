"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the columns of
``documents``, and any further ones that came in.

Rows count, not ids: a stage judges every row by its own doc_id and text, so of two rows with one doc_id one may go and
the other stay.  Rows that agree in both share their fate, but for near-duplicates, of which one row stays.  Rows with a
null doc_id are treated like others.  Rows are told apart by a 64-bit hash of doc_id and text: of ten billion rows, some
three pairs share one, and share a verdict.  Rows without words stay until packing, where they are the end id alone.  Empty
tables give empty results.
"""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import decontam, dedup, packing, scratch, secrets, toxicity

VOCABULARY = "word_bpe_49k.json"
_LAST: ContextVar[scratch.Tables | None] = ContextVar("last", default=None)  # of this thread, so that runs side by side keep their tables


def _begun(spark: SparkSession) -> scratch.Tables:
    """A handle for a stage's tables.  Those of the stage before go, as its result has been written."""
    if (last := _LAST.get()) is not None:
        last.clear(spark)
    made = scratch.Tables()
    _LAST.set(made)
    return made


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _by_row(docs: DataFrame) -> DataFrame:
    """The texts under a hash of doc_id and text, so that a verdict is about a row."""
    return docs.select(_key().alias("doc_id"), "text")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows whose key is not among the rejected (doc_id of ``_by_row``)."""
    mark = "_key"
    while mark in docs.columns:
        mark += "_"
    return docs.withColumn(mark, _key()).join(rejected.select(F.col("doc_id").alias(mark)).distinct(), mark, "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model rejects go."""
    with scratch.tables(_begun(spark)):
        model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return _without(docs, scratch.stored(toxicity.toxicity(_by_row(docs), model).where("predicted = 1").select("doc_id"), "toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays, that of the smallest doc_id."""
    with scratch.tables(_begun(spark)):
        return dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    with scratch.tables(_begun(spark)):
        found = decontam.contamination(_by_row(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        return _without(docs, scratch.stored(found.where("contaminated").select("doc_id"), "contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no row goes."""
    with scratch.tables(_begun(spark)):
        clean = secrets.redacted(docs)
        return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, in the order of the curve."""
    import public_tokenizers

    with scratch.tables(_begun(spark)):
        return packing.pack(docs, packing.Packing(public_tokenizers.path(VOCABULARY)))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("packing", pack)]
ORACLE_SQL = None  # dictionaries, sampled tests and a tokenizer are not SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's output goes once the next one's is written."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.Tables()
    for name, stage in STAGES[:-1]:
        out, before = stage(spark, docs, sf_dir), written
        with scratch.tables(scratch.Tables()) as written:
            docs = scratch.stored(out, f"pipeline-{name}")
        before.clear(spark)
    packed = STAGES[-1][1](spark, docs, sf_dir)  # reads its own table of token ids
    written.clear(spark)
    return packed
