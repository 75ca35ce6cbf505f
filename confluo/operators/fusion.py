"""Golden records: per entity and attribute, a vote decided by a cascade of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NORMALISERS
from ..schema import ATTRIBUTES, CANONICAL, COMPLETENESS, ID, MAJORITY, POLICY, SOURCE, SOURCE_PRIORITY


def check_policy(policy: tuple[str, ...]) -> None:
    if not policy or len(set(policy)) < len(policy) or set(policy) - set(POLICY) or policy[-1] != CANONICAL:
        raise ValueError("a policy names known rules once and ends with the canonical order")


def source_rank(priority: tuple[str, ...]) -> Column:
    """Place in the priority list; sources not on it are last."""
    if not priority:
        return F.lit(0)
    ranks = F.create_map(*[F.lit(x) for k, s in enumerate(priority) for x in (s, k)])
    return F.coalesce(F.element_at(ranks, F.col(SOURCE)), F.lit(len(priority)))


def ballots(records: DataFrame, parts: DataFrame, priority: tuple[str, ...] = ()) -> DataFrame:
    """(entity_id, attribute, norm, n_records, n_sources, best_rank, norm_length, raw_form, origin): one row per different value.

    Values are told apart by their normal form; sources vote, not records, and records without a source share a vote.
    The raw form is the most frequent spelling, then that of the smallest record, then the smallest spelling.
    """
    rank = source_rank(priority)
    rows = records.join(parts, ID).select("entity_id", ID, SOURCE, rank.alias("rank"), *ATTRIBUTES)
    values = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("raw"), NORMALISERS[a](F.col(a).cast("string")).alias("norm")) for a in ATTRIBUTES])
    long = rows.select("entity_id", ID, SOURCE, "rank", F.explode(values).alias("v")).select("entity_id", ID, SOURCE, "rank", "v.*").where("norm IS NOT NULL")
    spelled = long.groupBy("entity_id", "attribute", "norm", "raw").agg(F.count("*").alias("n"), F.min(ID).alias("least"), F.collect_set(F.coalesce(SOURCE, F.lit("\x00"))).alias("sources"), F.min("rank").alias("rank"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "least", "raw"))
    grouped = spelled.groupBy("entity_id", "attribute", "norm").agg(
        F.sum("n").alias("n_records"), F.size(F.array_distinct(F.flatten(F.collect_list("sources")))).cast("long").alias("n_sources"), F.min("rank").cast("long").alias("best_rank"), best.alias("form"), F.min("least").alias("origin_any")
    )
    return grouped.select("entity_id", "attribute", "norm", "n_records", "n_sources", "best_rank", F.length("norm").cast("long").alias("norm_length"), F.col("form.raw").alias("raw_form"), F.col("form.least").alias("origin"))


_KEYS = {MAJORITY: F.desc, COMPLETENESS: F.desc, SOURCE_PRIORITY: F.asc, CANONICAL: F.asc}
_OF = {MAJORITY: "n_sources", COMPLETENESS: "norm_length", SOURCE_PRIORITY: "best_rank", CANONICAL: "norm"}


def arbitrated(votes: DataFrame, policy: tuple[str, ...] = POLICY) -> DataFrame:
    """The winner of each ballot with the rule that decided.

    Each rule keeps all of its best values, so the cascade's winner is the first in lexicographic order of the rules'
    keys. The deciding rule is the first one after which a single value is left; rules that changed nothing before it
    abstained. A ballot of one value is not decided by any rule.
    """
    check_policy(policy)
    place = Window.partitionBy("entity_id", "attribute")
    order = place.orderBy(*[_KEYS[r](_OF[r]) for r in policy])
    rows = votes.withColumn("_rn", F.row_number().over(order)).withColumn("n_values", F.count("*").over(place))
    best = rows.withColumn("_second", F.lead("n_sources").over(place.orderBy(F.desc("n_sources"), "norm")))
    top = F.max("n_sources").over(place)
    runner = F.sort_array(F.collect_list("n_sources").over(place), asc=False)
    best = best.withColumn("majority_gap", F.when(F.col("n_values") > 1, top - F.get(runner, F.lit(1))))
    for k in range(1, len(policy) + 1):
        keys = Window.partitionBy("entity_id", "attribute", *[_OF[r] for r in policy[:k]])
        best = best.withColumn(f"_left{k}", F.count("*").over(keys))
    won = best.where("_rn = 1")
    left = [F.col("n_values"), *(F.col(f"_left{k}") for k in range(1, len(policy) + 1))]
    rule = F.when(F.col("n_values") == 1, F.lit(None).cast("string"))
    for k, r in enumerate(policy, 1):
        rule = rule.when(left[k] == 1, r)
    abstained = F.array_join(F.array_compact(F.array(*[F.when((left[k - 1] > 1) & (left[k] == left[k - 1]), r) for k, r in enumerate(policy, 1)])), ",")
    return won.select("entity_id", "attribute", "raw_form", "norm", "origin", "n_values", rule.alias("rule"), abstained.alias("abstained"), "majority_gap")


def golden_records(records: DataFrame, parts: DataFrame, winners: DataFrame) -> DataFrame:
    """One row per entity: its records, each attribute's kept raw value and the record it is from."""
    members = parts.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list(ID)), ",").alias("record_ids"), F.count("*").alias("n_records"))
    wide = winners.groupBy("entity_id").pivot("attribute", list(ATTRIBUTES)).agg(F.first("raw_form").alias("v"), F.first("origin").alias("o"))
    columns = [F.col(f"{a}_v").alias(a) for a in ATTRIBUTES] + [F.col(f"{a}_o").alias(f"origin_{a}") for a in ATTRIBUTES]
    return members.join(wide, "entity_id", "left").select("entity_id", "record_ids", "n_records", *columns)


def discarded(votes: DataFrame, winners: DataFrame) -> DataFrame:
    """Values that competed and were not kept."""
    kept = winners.select("entity_id", "attribute", "norm")
    return votes.join(kept, ["entity_id", "attribute", "norm"], "left_anti").select("entity_id", "attribute", "raw_form", "norm", "n_sources")
