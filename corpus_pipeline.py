"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of
``documents``; the last one returns packed pieces. Between stages the rows are written as Parquet and read again.
Null texts fail the quality rules; the edge cases of each stage are those of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontaminate, jaccard, lines, packing, quality
from vellum.llm.common import Scratch, load
from vellum.llm.tokens import tokenizer_path

#: SQL has no XXH64, on which two stages rest.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the log-likelihood ratio keep."""
    trusted = load(spark, sf_dir, "labels").where("quality = 1")
    return quality.judge(docs, trusted).where("_kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with later repeats of runs of lines and of lines of 20 words deleted; n_chars follows the text."""
    out = lines.drop_repeated_lines(docs, min_run=2, alone=20)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each class of texts linked by a Jaccard similarity of 0.8 or more."""
    return jaccard.drop_near_duplicates(docs, shingle=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of a benchmark item."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"), window=10)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and where each lies in its sequence."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
