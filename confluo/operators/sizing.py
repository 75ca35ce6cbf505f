"""Thresholds sized to a review budget."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FRONTIER, REVIEW_BUDGET, T_LOWER, T_UPPER


def budget(per_hour: float = 60, hours: float = 5) -> int:
    n = int(per_hour * hours)
    if n < 1:
        raise ValueError("the budget is at least one pair")
    return n


def statistics(decided: DataFrame) -> DataFrame:
    """Descriptors of match weights."""
    r = "match_weight"
    q = F.percentile(r, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    found = decided.agg(F.count(r).alias("n"), F.min(r).alias("r_min"), F.max(r).alias("r_max"), q.alias("q"), F.avg(r).alias("r_mean"), F.countDistinct(r).alias("n_distinct"))
    return found.select("n", "r_min", "r_max", *(F.col("q")[k].alias(n) for k, n in enumerate(("q05", "q25", "q50", "q75", "q95"))), F.round("r_mean", 9).alias("r_mean"), "n_distinct")


def bands(decided: DataFrame, frontier: float = FRONTIER) -> DataFrame:
    """Nested bands around the frontier: pairs inside, lower and upper bound.

    Rows counted before have n. Weights are counted by distinct value first; these are few, as they follow from at most 65,536 profiles, so the
    running sum over all of them is small.
    """
    n = F.sum("n") if "n" in decided.columns else F.count("*")
    counts = decided.groupBy("match_weight").agg(n.alias("c")).withColumn("gap", F.abs(F.col("match_weight") - F.lit(frontier)))
    w = Window.orderBy("gap", "match_weight").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(F.sum("c").over(w).alias("n_pairs"), F.min("match_weight").over(w).alias("t_lower"), F.max("match_weight").over(w).alias("t_upper"))


def sized(decided: DataFrame, pairs: int = REVIEW_BUDGET, frontier: float = FRONTIER) -> DataFrame:
    """The band whose pairs are nearest to the budget; the smaller one of two equally near."""
    return bands(decided, frontier).orderBy(F.abs(F.col("n_pairs") - F.lit(pairs)), "n_pairs").limit(1)


@dataclass(frozen=True)
class Thresholds:
    upper: float
    lower: float
    n_pairs: int
    fallback: str | None = None


def thresholds(decided: DataFrame, pairs: int = REVIEW_BUDGET, frontier: float = FRONTIER) -> Thresholds:
    """As numbers; a band of one value is widened by the least step a double can make. Without pairs the defaults stay, with the reason."""
    r = sized(decided, pairs, frontier).first()
    if r is None:
        return Thresholds(T_UPPER, T_LOWER, 0, "no pairs to size on; the default thresholds stay")
    lo, hi = r["t_lower"], r["t_upper"]
    if lo == hi:
        lo, hi = math.nextafter(lo, -math.inf), math.nextafter(hi, math.inf)
    return Thresholds(hi, lo, r["n_pairs"])
