"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a runner writes it as
Parquet and rereads it as the next stage's docs.  Stages before the last return the
columns of ``docs``; line dedup rewrites ``text`` (and ``n_chars``), the others drop rows.
Null ids, null texts, repeated rows, empty tables and extra columns behave as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinelytics.llm import decontam, linededup, packing, simhash, toxicity
from cinelytics.llm.common import cut, table
from cinelytics.llm.tokens import tokenizer_path


#: Rows in a batch between the JVM and Python: whole texts may be long, so a batch of Spark's
#: default 10,000 rows is much memory on both sides.  Results don't depend on it.
BATCH_ROWS = 2_000


def _bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go (operator 7)."""
    _bound_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in one of them (operator 10)."""
    _bound_batches(spark)
    return linededup.dedup_lines(docs)


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (operator 9)."""
    _bound_batches(spark)
    return simhash.keep_first(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go (operator 1)."""
    _bound_batches(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in windows of 1024 tokens (operator 4)."""
    _bound_batches(spark)
    return packing.digest(packing.pack(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [("toxicity", stage_toxicity), ("line_dedup", stage_line_dedup), ("simhash", stage_simhash),
          ("decontaminate", stage_decontaminate), ("packing", stage_packing)]
# A factorization machine, XXH64 fingerprints and a tokenizer are outside SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
