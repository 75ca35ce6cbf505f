"""Queries of the corpus operators, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cap_filters, dac, html_text, licenses, line_dedup, merge_dropout, ngram_join, packing, quality, shards
from .common import scratch_path, table
from .encoder import vocabulary


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    written, _ = dac.write_segments(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return dac.read_digest(written)


#: Rows of a small shard, and the shares of documents that arrive together, in eighths.
ARRIVAL_ROWS, ARRIVALS = 2_000, ((0, 4), (4, 6), (6, 8))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = shards.Store(spark, scratch_path(spark, "store"))
    eighth = F.pmod(F.xxhash64(docs["doc_id"]), F.lit(8))
    for lo, hi in ARRIVALS:
        store.append(docs.where((eighth >= lo) & (eighth < hi)), rows_per_shard=ARRIVAL_ROWS)
    done = store.compact()
    file = F.col("_metadata.file_path").alias("path")
    rows = store.read().select("doc_id", F.length("text").cast("long").alias("text_chars"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), file)
    shards_of = store.listed().select("path", F.col("n_bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows"))
    joined = rows.join(shards_of, "path").select("doc_id", "text_chars", "text_crc32", F.element_at(F.split("path", "/"), -1).alias("shard"), "shard_bytes", "shard_rows")
    return joined.withColumn("version", F.lit(done.version).cast("long"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.decompose(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.judged(docs, rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("rule").cast("int"))


def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.dedup(table(spark, sf_dir, "embeddings"))


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = html_text.with_text(pages, html_text.fit(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup(docs, removed="n_removed")
    kept = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select("doc_id", "text", "n_removed", kept.alias("n_chars_kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_sharding": op2_sharding,
    "op3_license_scan": op3_license_scan,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_cap_filters": op7_cap_filters,
    "op8_merge_dropout": op8_merge_dropout,
    "op9_html_extraction": op9_html_extraction,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {}
