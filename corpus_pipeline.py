"""The corpus pipeline: five stages over ``documents``, each one of the operators of ``tracefold.llm``.

Every stage works on all rows its predecessor kept, and its output is written as Parquet and read again. All but the
last return the columns of ``documents``. Models are learned from the given tables ``documents`` and ``labels``,
never from a stage's input, so a document's fate depends on its text and on what the earlier stages kept only.

Defined results: a null or letter-less text has no language and is rejected; all other languages stay. Documents
scored toxic at the threshold go. Of a near-duplicate group the row with the least doc_id stays (of several rows with
that id in the group, or of a group without ids, the least by text, lang, source and n_chars). Documents contaminated by the benchmark go. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import common, decontam, langid, packing, simhash, toxicity
from tracefold.llm.queries import END_ID, tokenizer_path
from tracefold.session import materialize
from tracefold.sources.tables import table

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.3


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage runs with small Arrow batches."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bounded_batches(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


def documents(df: DataFrame) -> DataFrame:
    return df.select(*DOCUMENTS)


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (6): documents of no language go."""
    model = langid.fit(langid.learning_rows(table(spark, sf_dir, "documents")))
    return documents(langid.identify(docs, model).where(F.col("lang_pred") != langid.UNKNOWN))


@stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (2): documents scored toxic go."""
    model = toxicity.fit(toxicity.learning_labels(table(spark, sf_dir, "documents")), toxicity.learning_labels(table(spark, sf_dir, "labels")))
    return documents(toxicity.score(docs, model, TOXIC).where(F.col("predicted") == 0))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (1): the row with the least doc_id of each group stays; of several such rows the least one."""
    found = simhash.near_duplicates(docs, shingle=3, distance=2)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id", "fp", "root").distinct()
    counts = docs.groupBy("doc_id").count()
    repeated = counts.where("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    # groups without any id (none in well-formed tables): one row of each
    roots = found.where(F.col("component_id").isNull()).select("fp", "root").distinct()
    unnamed = simhash.with_fingerprint(docs.where(F.col("doc_id").isNull()), 3).join(roots, "fp")
    if repeated.isEmpty():
        named = docs.join(kept.select("doc_id"), "doc_id")
        return documents(named).unionByName(least_rows(unnamed))
    # a repeated id may stand for texts of several groups: there its rows are told apart by their fingerprints
    named = docs.join(kept.join(repeated, "doc_id", "left_anti").select("doc_id"), "doc_id")
    several = simhash.with_fingerprint(docs.join(repeated, "doc_id", "left_semi"), 3).join(kept, ["doc_id", "fp"])
    return documents(named).unionByName(least_rows(several)).unionByName(least_rows(unnamed))


def least_rows(rows: DataFrame) -> DataFrame:
    """The least row of each group, by all columns of documents."""
    return rows.groupBy("root").agg(F.min(F.struct(*DOCUMENTS)).alias("d")).select("d.*")


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (7): contaminated documents go."""
    judged = decontam.judged(docs, table(spark, sf_dir, "benchmark"), window=13)
    return documents(judged.where(~F.col("contaminated")))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (5): the documents left, as pieces of sequences of at most 4096 ids."""
    return packing.pack(docs, tokenizer_path(), END_ID)


STAGES = [("language_id", language), ("toxicity", toxic), ("simhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", benchmark), ("packing", pack)]

# Tokenizer ids, learned models and XXH64 fingerprints have no SQL form; tests/llm hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = materialize(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
