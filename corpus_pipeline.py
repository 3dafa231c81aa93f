"""A corpus pipeline of text operators over documents: filter, deduplicate, decontaminate, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from predial.llm import decontam, neardup, packing, queries, repeats
from predial.llm.common import discard, fresh, ship, staged


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and empty texts are judged as such; all columns stay as they are."""
    ship(spark)
    score, keep = (fresh(x, docs.columns) for x in ("score", "keep"))
    return queries.site_quality(spark, docs, sf_dir, score, keep).filter(keep).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each class of near-duplicates; null and empty texts all stay."""
    ship(spark)
    return neardup.without_near_duplicates(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 bytes or more that one with a smaller doc_id has; n_chars follows. Null texts stay
    null; a text that is all passages becomes empty."""
    ship(spark)
    return repeats.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    ship(spark)
    return decontam.without_matches(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their windows; a null or empty text is one piece of one id."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: The learned model, the sampled classes and the tokenizer have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result but the last is written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage-{i}")
            discard(before)
    return docs
