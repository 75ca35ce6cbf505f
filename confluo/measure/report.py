"""What a reader of a run asks for: placement of thresholds, doubt, reconciliation, folds, systems side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import distribution, metrics

#: True grey pairs from which the AUC inside the band is given.
LEAST_TRUE_GREY = 5
_R = "match_weight"


def _n(condition: F.Column) -> F.Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def _ratio(x, y) -> F.Column:
    return F.round(F.try_divide(x, y), 9)


def threshold_placement(rows: DataFrame, upper: float, lower: float) -> DataFrame:
    """By class: shares at or below each threshold, pairs above the upper, below the lower and between."""
    r = F.col(_R)
    n = F.count("*")
    return rows.groupBy("is_true").agg(
        n.alias("n"), _ratio(_n(r <= upper), n).alias("share_upto_upper"), _ratio(_n(r <= lower), n).alias("share_upto_lower"), _n(r > upper).alias("n_above"), _n(r < lower).alias("n_below"), _n((r >= lower) & (r <= upper)).alias("n_between")
    )


def imbalance(rows: DataFrame, n_true_total: int | None = None) -> DataFrame:
    """True against false pairs, and the true pairs that would have to be misplaced for the AUC that is seen."""
    counts = distribution.auc(rows)
    out = counts.select("auc", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_true", "n_false")))
    return out.select(
        "n_true", "n_false", _ratio("n_false", "n_true").alias("ratio"), _ratio("n_true", F.col("n_true") + F.col("n_false")).alias("positive_rate"), F.round((1 - F.col("auc")) * F.col("n_true"), 6).alias("misplaced_scored"),
        F.round((1 - F.col("auc")) * (F.col("n_true") if n_true_total is None else F.lit(n_true_total)), 6).alias("misplaced_all"),
    )


def irreducibility(rows: DataFrame) -> DataFrame:
    """Whether doubt in the band could be settled by any rule on the weight: mixed values, their share, the least errors, the AUC inside."""
    grey = rows.where("verdict = 'GREY'")
    by = distribution.by_weight(grey)
    mixed = (F.col("nv") > 0) & (F.col("nf") > 0)
    floor = by.agg(F.count("*").alias("n_values"), _n(mixed).alias("mixed_values"), F.coalesce(F.sum(F.when(mixed, F.col("nv") + F.col("nf"))), F.lit(0)).alias("n_mixed"), F.coalesce(F.sum(F.least("nv", "nf")), F.lit(0)).alias("floor"))
    auc = distribution.auc(grey)
    shown = F.when((F.col("n_true") >= LEAST_TRUE_GREY) & (F.col("n_false") > 0), F.col("auc"))
    return floor.join(auc).select("n_values", "mixed_values", _ratio("n_mixed", F.col("n_true") + F.col("n_false")).alias("share_mixed"), "floor", shown.alias("auc_inside"))


def evidence(rows: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """Inside and outside the band: pairs, the upper median of informative attributes, and the share of missing levels."""
    missing = sum((F.col(f"lvl_{a}") == "MISSING").cast("long") for a in attributes)
    where = F.when(F.col("verdict") == "GREY", "inside").otherwise("outside")
    counts = rows.groupBy(where.alias("band"), F.col("n_informative").cast("long").alias("k")).agg(F.count("*").alias("c"), F.sum(missing).alias("m"))
    # At most nine counts for each side.
    listed = counts.groupBy("band").agg(F.sum("c").alias("n"), F.sum("m").alias("m"), F.sort_array(F.collect_list(F.struct("k", "c"))).alias("ks"))
    at = F.expr("aggregate(ks, named_struct('seen', 0L, 'at', cast(null as bigint)), (s, x) -> named_struct('seen', s.seen + x.c, 'at', CASE WHEN s.at IS NULL AND s.seen + x.c > n div 2 THEN x.k ELSE s.at END)).at")
    return listed.select("band", "n", at.alias("median_informative"), _ratio("m", F.col("n") * len(attributes)).alias("missing_rate"))


def band_reconciliation(decided: DataFrame, upper: float, lower: float) -> DataFrame:
    """Pairs between the thresholds against grey verdicts and guarded pairs; a gap tells of an inconsistency."""
    inside = F.col(_R).between(lower, upper)
    counts = decided.agg(_n(inside).alias("n_between"), _n(F.col("verdict") == "GREY").alias("n_grey"), _n(F.col("guarded")).alias("n_guarded"), _n(inside & F.col("guarded")).alias("n_guarded_between"))
    gap = F.col("n_between") - F.col("n_grey") - F.col("n_guarded_between")
    return counts.select("*", gap.alias("gap"), (gap == 0).alias("coherent"))


def fold_f1(split: DataFrame, true_by_fold: DataFrame) -> DataFrame:
    """The best single threshold of fold 1, and the F1 it has in both folds; true pairs lost by blocking count in recall.

    ``split`` has (fold, match_weight, is_true), with n where rows were counted before, and ``true_by_fold`` (fold, n_true).
    """
    best = distribution.best_threshold(split.where("fold = 1")).select("threshold")
    above = split.where("fold IN (1, 2)").join(F.broadcast(best)).where(F.col(_R) > F.col("threshold"))
    n = F.col("n") if "n" in split.columns else F.lit(1)
    hits = above.groupBy("fold", "threshold").agg(*(F.coalesce(F.sum(F.expr(c).cast("long") * n), F.lit(0)).alias(k) for k, c in (("tp", "is_true"), ("fp", "NOT is_true"))))
    out = hits.join(true_by_fold, "fold")
    return out.select("fold", "threshold", "tp", "fp", "n_true", _ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_true")).alias("f1"))


def systems(scored: dict[str, DataFrame], true: DataFrame) -> DataFrame:
    """Strict measures of several systems, each a table of (a, b, verdict) over the same candidates, by one path."""
    out = None
    for name, rows in scored.items():
        cells = metrics.contingency(rows.withColumn("guarded", F.lit(False)).withColumn(_R, F.lit(0.0)), true)
        m = metrics.measures(cells).where("convention = 'strict'").select(F.lit(name).alias("system"), "tp", "fp", "fn", "precision", "recall", "f1")
        out = m if out is None else out.union(m)
    return out


def pair_evidence(decided: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """Why a pair was linked or queued: its attributes by level, and the weight of the strongest for and against."""
    of = lambda level: F.array_join(F.array_compact(F.array(*[F.when(F.col(f"lvl_{a}") == level, a) for a in attributes])), ",")
    weights = F.array(*[F.col(f"w_{a}") for a in attributes])
    rows = decided.where("verdict IN ('MATCH', 'GREY')")
    return rows.select("a", "b", "verdict", "match_weight", of("STRONG").alias("agree"), of("PARTIAL").alias("partly"), of("DISAGREE").alias("differ"), of("MISSING").alias("missing"), F.round(F.array_max(weights), 9).alias("most_for"), F.round(F.array_min(weights), 9).alias("most_against"))


def equal_after_normalization(pairs: DataFrame, normalized: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """(a, b, equal): attributes whose normal forms are the same, whatever the level says."""
    for side in "ab":
        pairs = pairs.join(normalized.select(F.col("record_id").alias(side), *(F.col(x).alias(f"{x}_{side}") for x in attributes)), side)
    return pairs.select("a", "b", F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{x}_a") == F.col(f"{x}_b"), x) for x in attributes])), ",").alias("equal"))


def to_verify(decided: DataFrame, parts: DataFrame) -> DataFrame:
    """By entity: its grey pairs within and with other entities, and the heaviest of them."""
    grey = decided.where("verdict = 'GREY'").select("a", "b", _R)
    of = lambda k: parts.select(F.col("record_id").alias(k), F.col("entity_id").alias(f"e{k}"))
    ends = grey.join(of("a"), "a").join(of("b"), "b")
    rows = ends.select(F.explode(F.array_distinct(F.array("ea", "eb"))).alias("entity_id"), (F.col("ea") == F.col("eb")).alias("inside"), _R)
    return rows.groupBy("entity_id").agg(_n(F.col("inside")).alias("n_inside"), _n(~F.col("inside")).alias("n_between"), F.max(_R).alias("heaviest"))


def truth_check(true_stats: DataFrame, announced: int | None) -> DataFrame:
    """True pairs as counted against the number that a pack announces."""
    n = F.coalesce(F.sum("n_true_pairs"), F.lit(0)).cast("long")
    said = F.lit(announced).cast("long")
    return true_stats.agg(said.alias("announced"), n.alias("counted"), (n - said).alias("gap"), (n == said).alias("agrees"))
