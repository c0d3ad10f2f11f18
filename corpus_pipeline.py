"""A training-corpus pipeline over ``documents``: five stages, each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knowntime.llm._shared import read_table, stash
from knowntime.llm.decontaminate import drop_contaminated
from knowntime.llm.jaccard import keep_representatives
from knowntime.llm.langid import drop_unidentified
from knowntime.llm.packing import pack_documents
from knowntime.llm.queries import tokenizer_path
from knowntime.llm.secrets import redact_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language stays unclear, go."""
    return drop_unidentified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Candidates of the SimHash index and of MinHash bands, held to a similarity of 0.8 of their
    five-word shingles; of each group the document of the smallest doc_id stays."""
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, a few edits allowed, go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 tokens, as few as best fit finds."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language id", language_id),
    ("SimHash near-dedup, exact shingle sets", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_scan),
    ("best-fit packing", packing),
]

#: Hashing, a trained model and edit distances are beyond SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what its predecessor wrote."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs)
    return docs
