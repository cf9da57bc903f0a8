"""The registered queries ``opN_<name>``: thin calls of the operators on their whole tables, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import (chat, common, decontam, divergence, filter_audit, langid, licenses, lm, packing, paragraphs, quality, simhash,
               token_files, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query; it runs with small Arrow batches."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.bounded_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components at 2 bits or fewer (simhash.near_duplicates)."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by Kneser-Ney models learned from three of four folds (toxicity.score)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.learning_labels(docs), toxicity.learning_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, threshold=0.3).select(
        "doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by an additive model learned from two of three folds (quality.score)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(quality.learning_labels(docs), quality.learning_labels(table(spark, sf_dir, "labels")))
    return quality.score(docs, model, threshold=0.5).select(
        "doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all documents by the counts of all others' words, pairs and triples (lm.stupid_backoff)."""
    scored = lm.stupid_backoff(table(spark, sf_dir, "documents"), order=3)
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"),
                         F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE["op4_lm_score"] = lm.ORACLE


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of at most 4096 ids over all documents, cut by dynamic programming (packing.pack)."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by error-correcting output codes learned from four of five folds (langid.identify)."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.learning_rows(docs))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, by windows of 13 words (decontam.judged)."""
    return decontam.judged(table(spark, sf_dir, "documents").select("doc_id", "text"),
                           table(spark, sf_dir, "benchmark"), window=13).drop("text")


ORACLE["op7_decontamination"] = decontam.ORACLE


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 through the template, read back from the output (chat.digests)."""
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return chat.digests(chat.format_turns(turns.unionByName(extra)))


ORACLE["op8_chat_format"] = chat.ORACLE


@query
def op9_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph sketches of all documents and of their edited texts, compared by peeling (paragraphs.edited_likeness)."""
    return paragraphs.edited_likeness(table(spark, sf_dir, "documents"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as rANS token blocks, written, read back and digested (token_files.token_digests)."""
    return token_files.token_digests(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all orders, exact duplicates found by radix tries (filter_audit.audit)."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op11_filter_audit"] = filter_audit.ORACLE


@query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents, notices by an exact set-similarity join (licenses.scan)."""
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLE["op12_license_scan"] = licenses.oracle()


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word use of all (lang, source) groups, distances and leading terms by skybands (divergence.divergence)."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


ORACLE["op13_source_divergence"] = divergence.oracle()
