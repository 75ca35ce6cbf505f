"""Ground truth and blocking quality. This package reads pairs and truth; it never imports the engine's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def true_pairs(truth: DataFrame) -> DataFrame:
    """(a, b) of every two records of one entity."""
    left = truth.select("true_entity", F.col("record_id").alias("a"))
    right = truth.select("true_entity", F.col("record_id").alias("b"))
    return left.join(right, "true_entity").where("a < b").select("a", "b")


def statistics(truth: DataFrame) -> DataFrame:
    sizes = truth.groupBy("true_entity").agg(F.count("*").alias("n"))
    return sizes.groupBy(F.col("n").alias("entity_size")).agg(F.count("*").alias("n_entities"), F.sum(F.expr("n * (n - 1) div 2")).alias("n_true_pairs"), F.sum(F.expr("n - 1")).alias("n_forest_links"))


def check_assignment(truth: DataFrame) -> None:
    """Raises if a record has two entities."""
    if truth.groupBy("record_id").agg(F.countDistinct("true_entity").alias("n")).where("n > 1").take(1):
        raise ValueError("a record is assigned to two entities")


def defects(decided: DataFrame) -> DataFrame:
    """Counts of contract breaches in decisions: repeated or self pairs, wrong orientation, unknown verdicts, weights that are no number."""
    n = decided.agg(
        F.sum((F.col("a") == F.col("b")).cast("long")).alias("self_pairs"),
        F.sum((F.col("a") > F.col("b")).cast("long")).alias("misoriented"),
        F.sum((~F.col("verdict").isin("MATCH", "NON_MATCH", "GREY")).cast("long")).alias("unknown_verdicts"),
        F.sum((F.isnan("match_weight") | F.col("match_weight").isNull()).cast("long")).alias("bad_weights"),
        F.count("*").alias("n_pairs"),
    )
    repeated = decided.groupBy("a", "b").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeated"))
    return n.join(F.broadcast(repeated))


def blocking_quality(pairs: DataFrame, true: DataFrame, n_records: int) -> DataFrame:
    """Completeness, quality and reduction of candidate pairs."""
    return quality_of(pairs.agg(F.count("*").alias("n_candidates")), pairs.select("a", "b").join(true, ["a", "b"], "left_semi"), true, n_records)


def quality_of(counted: DataFrame, found: DataFrame, true: DataFrame, n_records: int) -> DataFrame:
    """The same from the number of candidates and the true pairs among them."""
    sides = counted.join(F.broadcast(found.agg(F.count("*").alias("n_found")))).join(F.broadcast(true.agg(F.count("*").alias("n_true"))))
    space = n_records * (n_records - 1) // 2
    return sides.select("n_candidates", "n_true", "n_found", F.round(F.try_divide("n_found", "n_true"), 9).alias("completeness"), F.round(F.try_divide("n_found", "n_candidates"), 9).alias("quality"), F.round(1 - F.col("n_candidates") / F.lit(max(space, 1)), 9).alias("reduction"))


def lost_pairs(pairs: DataFrame, true: DataFrame) -> DataFrame:
    return true.join(pairs.select("a", "b"), ["a", "b"], "left_anti")


def pass_contribution(pairs: DataFrame, true: DataFrame) -> DataFrame:
    """By pass: true pairs that it proposes, and those that no other pass does."""
    found = pairs.join(true, ["a", "b"], "left_semi")
    passes = F.array_distinct(F.transform("block_origin", lambda x: F.split_part(x, F.lit(":"), F.lit(1))))
    rows = found.select("a", "b", F.size(passes).alias("n"), F.explode(passes).alias("pass"))
    return rows.groupBy("pass").agg(F.count("*").alias("n_true"), F.sum((F.col("n") == 1).cast("long")).alias("n_only_here"))


def losses_by_category(lost: DataFrame, categories: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """Lost pairs by corruption of either record, and a bounded listing with a flag that tells of more."""
    c = categories.select("record_id", F.coalesce("corruptions", F.array().cast("array<string>")).alias("c"))
    both = lost.join(c.select(F.col("record_id").alias("a"), F.col("c").alias("ca")), "a", "left").join(c.select(F.col("record_id").alias("b"), F.col("c").alias("cb")), "b", "left")
    by = both.select(F.explode(F.array_union("ca", "cb")).alias("category")).groupBy("category").agg(F.count("*").alias("n_lost"))
    return by, lost.orderBy("a", "b").limit(most).withColumn("truncated", F.lit(bool(lost.limit(most + 1).count() > most)))
