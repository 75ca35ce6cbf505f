"""Pairwise metrics under four conventions for grey pairs. Undefined ratios are null, never zero."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = ("mv", "mf", "gv", "gf", "nv", "nf", "lost")
CONVENTIONS = ("strict", "acceptance", "optimistic", "pessimistic")
Z = 1.96


def classified(decided: DataFrame, true: DataFrame) -> DataFrame:
    """Decisions with is_true; true pairs that blocking lost are not among them."""
    return decided.join(true.withColumn("is_true", F.lit(True)), ["a", "b"], "left").withColumn("is_true", F.coalesce("is_true", F.lit(False)))


def contingency(decided: DataFrame, true: DataFrame) -> DataFrame:
    """One row: matched, grey and not matched pairs, each true (v) or false (f), and the true pairs lost before."""
    return cells(classified(decided, true), true.join(decided.select("a", "b"), ["a", "b"], "left_anti"))


def cells(rows: DataFrame, lost: DataFrame) -> DataFrame:
    """The same from decisions with is_true, and the lost pairs. Rows counted before have n."""
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    cell = lambda v, t: F.coalesce(F.sum(((F.col("verdict") == v) & (F.col("is_true") == F.lit(t))).cast("long") * n), F.lit(0)).alias
    counts = rows.agg(*(cell(v, t)(n) for n, v, t in (("mv", "MATCH", True), ("mf", "MATCH", False), ("gv", "GREY", True), ("gf", "GREY", False), ("nv", "NON_MATCH", True), ("nf", "NON_MATCH", False))))
    return counts.join(F.broadcast(lost.agg(F.count("*").alias("lost"))))


def _wilson(k: Column, n: Column, side: int) -> Column:
    p = k / n
    half = F.lit(Z) * F.sqrt(p * (1 - p) / n + F.lit(Z * Z) / (4 * n * n))
    return F.when(n > 0, (p + F.lit(Z * Z) / (2 * n) + side * half) / (1 + F.lit(Z * Z) / n))


def measures(cells: DataFrame) -> DataFrame:
    """One row per convention: tp, fp, fn, precision, recall and f1 with Wilson bounds of both."""
    c = F.col
    by = {
        "strict": (c("mv"), c("mf"), c("gv") + c("nv") + c("lost")),
        "acceptance": (c("mv") + c("gv"), c("mf") + c("gf"), c("nv") + c("lost")),
        "optimistic": (c("mv") + c("gv"), c("mf"), c("nv") + c("lost")),
        "pessimistic": (c("mv"), c("mf") + c("gf"), c("gv") + c("nv") + c("lost")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("convention"), x.alias("tp"), y.alias("fp"), z.alias("fn")) for n, (x, y, z) in by.items()]))
    r = cells.select(rows.alias("r")).select("r.*")
    tp, fp, fn = c("tp"), c("fp"), c("fn")
    return r.select(
        "convention", "tp", "fp", "fn", F.round(F.try_divide(tp, tp + fp), 9).alias("precision"), F.round(F.try_divide(tp, tp + fn), 9).alias("recall"), F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 9).alias("f1"),
        F.round(_wilson(tp, tp + fp, -1), 9).alias("precision_lo"), F.round(_wilson(tp, tp + fp, 1), 9).alias("precision_hi"), F.round(_wilson(tp, tp + fn, -1), 9).alias("recall_lo"), F.round(_wilson(tp, tp + fn, 1), 9).alias("recall_hi"),
    )


def under_abstention(cells: DataFrame) -> DataFrame:
    """Metrics over decided pairs alone, with the share that is decided. Grey true pairs leave recall's denominator; those lost by blocking stay in it."""
    c = F.col
    decided, grey = c("mv") + c("mf") + c("nv") + c("nf"), c("gv") + c("gf")
    true = c("mv") + c("nv") + c("lost")
    ratio = lambda x, y: F.round(F.try_divide(x, y), 9)
    return cells.select(
        ratio(decided, decided + grey).alias("coverage"), decided.alias("n_decided"), grey.alias("n_abstained"), ratio(c("mv"), c("mv") + c("mf")).alias("precision"), ratio(c("mv"), true).alias("recall"),
        ratio(2 * c("mv"), c("mv") + c("mf") + true).alias("f1"),
    )


def recall_parts(cells: DataFrame) -> DataFrame:
    """Recall as blocking completeness times decision recall."""
    c = F.col
    found = c("mv") + c("gv") + c("nv")
    return cells.select(F.round(F.try_divide(found, found + c("lost")), 9).alias("blocking"), F.round(F.try_divide(c("mv"), found), 9).alias("decision"), F.round(F.try_divide(c("mv"), found + c("lost")), 9).alias("end_to_end"))


def false_negatives(decided: DataFrame, true: DataFrame) -> DataFrame:
    """True pairs that are not matched, by one of four exclusive causes; weight null where blocking lost them."""
    rows = true.join(decided.select("a", "b", "verdict", "match_weight", "guarded"), ["a", "b"], "left")
    cause = F.when(F.col("verdict").isNull(), "lost_at_blocking").when(F.col("verdict") == "GREY", "grey").when(F.col("guarded"), "guarded").otherwise("decided_non_match")
    return rows.where("verdict IS NULL OR verdict <> 'MATCH'").select("a", "b", "match_weight", cause.alias("cause"))


def fn_causes(decided: DataFrame, true: DataFrame) -> DataFrame:
    return false_negatives(decided, true).groupBy("cause").agg(F.count("*").alias("n"))


def fn_top(decided: DataFrame, true: DataFrame, most: int = 50) -> DataFrame:
    """The heaviest ones, in total order; pairs without a weight come last."""
    return false_negatives(decided, true).orderBy(F.desc_nulls_last("match_weight"), "a", "b").limit(most)


def fp_top(decided: DataFrame, true: DataFrame, most: int = 50) -> DataFrame:
    wrong = decided.where("verdict = 'MATCH'").join(true, ["a", "b"], "left_anti")
    return wrong.select("a", "b", "match_weight").orderBy(F.desc("match_weight"), "a", "b").limit(most)


def mcnemar(first: DataFrame, second: DataFrame, universe: DataFrame, true: DataFrame) -> DataFrame:
    """Discordant pairs of two match sets: right in one only. The exact test follows on the driver."""
    flag = lambda df, n: df.select("a", "b").distinct().withColumn(n, F.lit(True))
    rows = universe.select("a", "b").join(flag(first, "x"), ["a", "b"], "left").join(flag(second, "y"), ["a", "b"], "left").join(flag(true, "t"), ["a", "b"], "left")
    right = lambda n: F.coalesce(F.col(n), F.lit(False)) == F.coalesce(F.col("t"), F.lit(False))
    return rows.agg(F.coalesce(F.sum((right("x") & ~right("y")).cast("long")), F.lit(0)).alias("only_first"), F.coalesce(F.sum((~right("x") & right("y")).cast("long")), F.lit(0)).alias("only_second"))


def mcnemar_p(only_first: int, only_second: int) -> float:
    """Two-sided exact binomial probability."""
    n, k = only_first + only_second, min(only_first, only_second)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
