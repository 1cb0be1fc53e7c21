"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination and packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents, extra ones included, whatever their names. Decisions are made for doc_ids: rows with one doc_id
stay or go together, and rows with a null doc_id are never dropped. Null and empty texts fail the quality rules; later
stages keep them as they are. Texts are read whole, however long; an empty table gives an empty table of the same
columns. What a stage leaves for the next replaces what it read, whose folder is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscope.llm.common import BROADCAST_ROWS, fresh, ready, staged, table
from docscope.llm.decontamination import leaks
from docscope.llm.line_dedup import dedup_lines
from docscope.llm.minhash import near_duplicates
from docscope.llm.packing import pack
from docscope.llm.quality import judge

NEAR_WORDS, NEAR_PERCENT = 5, 80


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of these ids, which are broadcast up to BROADCAST_ROWS; beyond, both sides are shuffled."""
    ids = staged(ids.select("doc_id").distinct(), "dropped-ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_anti").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _without(docs, judge(docs).where("not kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that occur earlier in the corpus; n_chars follows the text."""
    ready(spark)
    kept = {c: fresh(docs, f"own_{c}") for c in docs.columns if c in ("n_lines", "removed_lines", "removed_words")}
    left = dedup_lines(docs.withColumnsRenamed(kept)).drop("n_lines", "removed_lines", "removed_words")
    left = left.withColumnsRenamed({v: k for k, v in kept.items()})
    kind = dict(docs.dtypes).get("n_chars")
    return (left.withColumn("n_chars", F.length("text").cast(kind)) if kind else left).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    ready(spark)
    return _without(docs, near_duplicates(docs, NEAR_PERCENT, NEAR_WORDS).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, leaks(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the packed sequences."""
    ready(spark)
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", (docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
