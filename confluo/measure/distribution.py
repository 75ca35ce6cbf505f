"""How well match weights separate true from false pairs. Counts by distinct weight come first; these are few."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LO, HI = -128, 128


def by_weight(rows: DataFrame) -> DataFrame:
    """(match_weight, nv, nf): true and false pairs at each weight. Rows counted before have n."""
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    return rows.groupBy("match_weight").agg(F.sum(F.col("is_true").cast("long") * n).alias("nv"), F.sum((~F.col("is_true")).cast("long") * n).alias("nf"))


def descriptors(rows: DataFrame) -> DataFrame:
    r = "match_weight"
    return rows.groupBy("is_true").agg(F.count(r).alias("n"), F.min(r).alias("r_min"), F.max(r).alias("r_max"), F.round(F.avg(r), 6).alias("r_mean"), F.round(F.stddev_pop(r), 6).alias("r_std"), F.percentile(r, F.lit(0.5)).alias("r_median"), F.countDistinct(r).alias("n_distinct"))


def histogram(rows: DataFrame, step: float = 1.0) -> DataFrame:
    """Sparse counts on the declared grid; bin -1 holds what is outside."""
    inside = (F.col("match_weight") >= LO) & (F.col("match_weight") < HI)
    bins = F.when(inside, F.floor((F.col("match_weight") - LO) / step)).otherwise(-1).cast("long")
    return rows.groupBy(bins.alias("bin"), "is_true").agg(F.count("*").alias("n"))


def auc(rows: DataFrame) -> DataFrame:
    """Exact Mann-Whitney AUC with mid-ranks, in doubled integers."""
    counts = by_weight(rows)
    before = Window.orderBy("match_weight").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("below", F.coalesce(F.sum("nf").over(before), F.lit(0)))
    sums = ranked.agg(F.sum(F.col("nv") * (2 * F.col("below") + F.col("nf"))).alias("u2"), F.sum("nv").alias("n_true"), F.sum("nf").alias("n_false"))
    return sums.select("n_true", "n_false", F.round(F.try_divide("u2", 2 * F.col("n_true") * F.col("n_false")), 9).alias("auc"))


def sweep(rows: DataFrame) -> DataFrame:
    """(threshold, tp, fp, fn) at every midpoint between neighbouring weights; pairs above it match."""
    up = Window.orderBy("match_weight")
    counts = by_weight(rows)
    total = counts.agg(F.sum("nv").alias("tv"), F.sum("nf").alias("tf"))
    run = counts.select("match_weight", F.lead("match_weight").over(up).alias("next"), F.sum("nv").over(up).alias("cv"), F.sum("nf").over(up).alias("cf")).where("next IS NOT NULL")
    return run.join(F.broadcast(total)).select(((F.col("match_weight") + F.col("next")) / 2).alias("threshold"), (F.col("tv") - F.col("cv")).alias("tp"), (F.col("tf") - F.col("cf")).alias("fp"), F.col("cv").alias("fn"))


def best_threshold(rows: DataFrame) -> DataFrame:
    """The threshold of the highest F1; the smallest one of several."""
    f1 = F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 9)
    return sweep(rows).select(F.round("threshold", 9).alias("threshold"), "tp", "fp", "fn", f1.alias("f1")).orderBy(F.desc_nulls_last("f1"), "threshold").limit(1)


def average_precision(rows: DataFrame) -> DataFrame:
    """Sum of precision times the gain of recall, by falling weight."""
    down = Window.orderBy(F.desc("match_weight"))
    run = by_weight(rows).select(F.sum("nv").over(down).alias("tp"), F.sum("nf").over(down).alias("fp"), "nv")
    total = F.sum("nv")
    return run.agg(F.round(F.try_divide(F.sum(F.col("nv") * F.col("tp") / (F.col("tp") + F.col("fp"))), total), 6).alias("ap"), F.max(F.col("tp")).alias("n_true"))


def kolmogorov_smirnov(rows: DataFrame) -> DataFrame:
    """The largest gap of the cumulative shares, and the smallest weight where it is reached."""
    up = Window.orderBy("match_weight")
    counts = by_weight(rows)
    total = counts.agg(F.sum("nv").alias("tv"), F.sum("nf").alias("tf"))
    run = counts.select("match_weight", F.sum("nv").over(up).alias("cv"), F.sum("nf").over(up).alias("cf")).join(F.broadcast(total))
    return run.select("match_weight", F.round(F.abs(F.try_divide("cv", "tv") - F.try_divide("cf", "tf")), 9).alias("d")).orderBy(F.desc_nulls_last("d"), "match_weight").limit(1)


def overlap(rows: DataFrame, step: float = 1.0) -> DataFrame:
    """Overlap of the two histograms and their total variation distance."""
    h = histogram(rows, step)
    flat = h.groupBy("bin").agg(F.sum(F.when(F.col("is_true"), F.col("n")).otherwise(0)).alias("nv"), F.sum(F.when(~F.col("is_true"), F.col("n")).otherwise(0)).alias("nf"))
    total = flat.agg(F.sum("nv").alias("tv"), F.sum("nf").alias("tf"))
    both = flat.join(F.broadcast(total)).agg(F.round(F.sum(F.least(F.try_divide("nv", "tv"), F.try_divide("nf", "tf"))), 6).alias("ovl"))
    return both.select("ovl", F.round(1 - F.col("ovl"), 6).alias("tvd"))


def margin(rows: DataFrame) -> DataFrame:
    """Lowest true weight minus highest false one."""
    lo, hi = F.min(F.when(F.col("is_true"), F.col("match_weight"))), F.max(F.when(~F.col("is_true"), F.col("match_weight")))
    return rows.agg(F.round(lo - hi, 9).alias("margin"))


def bayes_floor(rows: DataFrame) -> DataFrame:
    """Errors that no rule on the weight alone avoids, and the pairs at weights that both kinds have."""
    mixed = (F.col("nv") > 0) & (F.col("nf") > 0)
    return by_weight(rows).agg(F.sum(F.least("nv", "nf")).alias("floor"), F.coalesce(F.sum(F.when(mixed, F.col("nv") + F.col("nf"))), F.lit(0)).alias("n_mixed"), F.sum(mixed.cast("long")).alias("mixed_values"))
