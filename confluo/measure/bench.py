"""Rule baselines over pairs with both sides' values, and operating points of equal volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTRIBUTES = ("last_name", "first_name", "birth_date", "address", "postal_code", "city", "email", "phone")


def _same(name: str) -> Column:
    return F.coalesce(F.col(f"{name}_a") == F.col(f"{name}_b"), F.lit(False))


def exact_triple() -> Column:
    """Equal last name, first name and birth date."""
    return _same("last_name") & _same("first_name") & _same("birth_date")


def strong_key() -> Column:
    return _same("email") | _same("phone") | exact_triple()


def words(columns: tuple[str, ...]) -> Column:
    """The distinct words of all values."""
    return F.array_distinct(F.filter(F.split(F.concat_ws(" ", *columns), " "), lambda w: w != ""))


def jaccard() -> Column:
    """Jaccard similarity of all values' words."""
    a, b = (words(tuple(f"{x}_{s}" for x in ATTRIBUTES)) for s in "ab")
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def concordances() -> Column:
    """Number of equal attributes."""
    return sum(_same(a).cast("int") for a in ATTRIBUTES)


BASELINES = {"all": lambda: F.lit(1.0), "exact_triple": lambda: exact_triple().cast("double"), "strong_key": lambda: strong_key().cast("double"), "jaccard": lambda: F.round(jaccard(), 9), "strong_or_three": lambda: (strong_key() | (concordances() >= 3)).cast("double")}
CUTS = {"all": 1.0, "exact_triple": 1.0, "strong_key": 1.0, "jaccard": 0.5, "strong_or_three": 1.0}


def scored(pairs: DataFrame, baseline: str) -> DataFrame:
    """(a, b, match_weight, verdict) of a baseline."""
    s = BASELINES[baseline]()
    return pairs.select("a", "b", s.alias("match_weight")).withColumn("verdict", F.when(F.col("match_weight") >= CUTS[baseline], "MATCH").otherwise("NON_MATCH"))


def completed(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scores for all candidates: those left out do not match, at one below the least score."""
    least = scores.agg((F.coalesce(F.min("match_weight"), F.lit(0.0)) - 1).alias("least"))
    missing = candidates.select("a", "b").join(scores, ["a", "b"], "left_anti").join(F.broadcast(least)).select("a", "b", F.col("least").alias("match_weight"), F.lit("NON_MATCH").alias("verdict"))
    return scores.select("a", "b", "match_weight", "verdict").unionByName(missing)


def equal_volume(scores: DataFrame, k: int) -> DataFrame:
    """The score down to which about k pairs match: whole groups of equal scores, one more only if that is nearer to k."""
    down = Window.orderBy(F.desc("match_weight"))
    run = scores.groupBy("match_weight").agg(F.count("*").alias("c")).select("match_weight", F.sum("c").over(down).alias("cum"), "c")
    prev = F.col("cum") - F.col("c")
    taken = run.where((prev < k) & (F.abs(F.col("cum") - k) < F.abs(prev - k)))
    return taken.agg(F.min("match_weight").alias("least_score"), F.coalesce(F.max("cum"), F.lit(0)).alias("n_pairs"))
