"""The corpus pipeline: quality rules, line dedup, near-duplicate join, packing.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of documents. Nulls, repeated rows, empty tables and further columns are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.llm import line_dedup, ngram_join, packing, quality
from confluo.llm.common import saved, table
from confluo.llm.encoder import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another line stands for; those that lose all their text go, and n_chars follows."""
    out = line_dedup.dedup(docs, removed="_confluo_removed")
    out = out.where("NOT (_confluo_removed > 0 AND NOT text rlike '\\\\S')")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_confluo_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that five-word shingles link at a similarity of 0.8 or more."""
    groups = ngram_join.join(docs)
    losers = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_confluo_id")).distinct()
    return docs.join(losers.hint("merge"), docs["doc_id"].cast("long") == F.col("_confluo_id"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length with their ids, one row each."""
    return packing.decompose(docs, vocabulary("byte_bpe_50k.json"), end_id=0, with_ids=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("ngram_jaccard_join", near_duplicates), ("packing", pack)]

#: The learned rules and the merge tables have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
