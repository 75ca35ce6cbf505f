"""Review of grey pairs by replayed answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ABSTAIN, ATTRIBUTES, GREY, ID, MATCH, MATCH_AFTER, NON_MATCH_AFTER, NOT_REVIEWED, REVIEWED
from ..scratch import saved

BUDGET_SPENT, NO_ANSWER, UNAVAILABLE = "budget_spent", "no_answer", "reviewer_unavailable"


def payload(pairs: DataFrame, normalized: DataFrame) -> DataFrame:
    """(a, b, key, prompt): the two value lists in an order given by their content, nulls first, and its sha256."""
    for side in "ab":
        values = F.struct(*[F.struct(F.col(x).isNotNull().alias("known"), F.col(x).alias("v")).alias(x) for x in ATTRIBUTES])
        pairs = pairs.join(normalized.select(F.col(ID).alias(side), values.alias(f"_{side}")), side)
    first, second = F.least("_a", "_b"), F.greatest("_a", "_b")
    shown = lambda s: F.concat_ws("\x1f", *[F.concat_ws("=", F.lit(x), F.coalesce(s[x]["v"], F.lit("\x00"))) for x in ATTRIBUTES])
    text = F.concat_ws("\x1e", shown(first), shown(second))
    prompt = F.concat_ws("\n", F.lit("Do these two records describe one entity?"), F.to_json(first), F.to_json(second), F.lit("Answer with one line: MATCH, NON_MATCH or ABSTAIN."))
    return pairs.select("a", "b", F.sha2(text, 256).alias("key"), prompt.alias("prompt"))


def parsed(answer: Column) -> Column:
    """A decision line alone decides; none or two different ones abstain."""
    found = F.array_distinct(F.regexp_extract_all(answer, F.lit("(?m)^\\s*(MATCH|NON_MATCH|ABSTAIN)\\s*$"), F.lit(1)))
    one = F.when(F.size(found) == 1, F.get(found, F.lit(0)))
    return F.when(one == "MATCH", MATCH_AFTER).when(one == "NON_MATCH", NON_MATCH_AFTER).otherwise(ABSTAIN)


def reviewed(decided: DataFrame, keys: DataFrame, answers: DataFrame | None, budget: int | None = None) -> DataFrame:
    """Decisions with status, review_decision and reason. Only grey pairs are reviewed, the first ``budget`` by (a, b).

    ``answers`` has (key, answer); None stands for a reviewer that is not available. The ranking of grey pairs is one
    ordered pass over them alone, and only where a budget is given.
    """
    grey = decided.where(F.col("verdict") == GREY).drop("review")
    if budget is not None:
        inside = grey.select("a", "b").orderBy("a", "b").limit(budget).withColumn("_in", F.lit(True))
        grey = grey.join(inside, ["a", "b"], "left")
    else:
        grey = grey.withColumn("_in", F.lit(True))
    grey = grey.join(keys.select("a", "b", "key"), ["a", "b"], "left")
    if answers is None:
        grey = grey.withColumn("answer", F.lit(None).cast("string"))
        missing = UNAVAILABLE
    else:
        grey = grey.join(answers.select("key", "answer").dropDuplicates(["key"]), "key", "left")
        missing = NO_ANSWER
    done = F.col("_in").isNotNull() & F.col("answer").isNotNull()
    reason = F.when(F.col("_in").isNull(), BUDGET_SPENT).when(F.col("answer").isNull(), missing)
    grey = grey.withColumn("status", F.when(done, REVIEWED).otherwise(NOT_REVIEWED)).withColumn("review_decision", F.when(done, parsed(F.col("answer")))).withColumn("reason", reason)
    rest = decided.where(F.col("verdict") != GREY).drop("review")
    for c in ("status", "review_decision", "reason", "key"):
        rest = rest.withColumn(c, F.lit(None).cast("string"))
    return rest.unionByName(grey.drop("_in", "answer"))


def linking() -> Column:
    """Matches, and grey pairs that review promoted; compared by equality, as one decision's name contains the other's."""
    return (F.col("verdict") == MATCH) | ((F.col("verdict") == GREY) & (F.col("review_decision") == MATCH_AFTER))


def match_set(decided: DataFrame) -> DataFrame:
    return decided.where(F.coalesce(linking(), F.lit(False)))


def ranked(decided: DataFrame) -> DataFrame:
    """Grey pairs with their place in the review queue: places within ranges of (a, b), after the sizes of those before."""
    grey = decided.where(F.col("verdict") == GREY).select("a", "b", "match_weight")
    dealt, _ = saved(grey.repartitionByRange("a", "b").withColumn("_part", F.spark_partition_id()), "review-queue")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("a", "b"))
    return dealt.withColumn("_at", place).join(sizes, "_part").select("a", "b", "match_weight", (F.col("_first") + F.col("_at")).cast("long").alias("place"))
