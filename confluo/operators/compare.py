"""Comparison vectors of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..schema import ATTRIBUTES, ID, PARTIAL_FROM, STRONG_FROM


def with_values(pairs: DataFrame, normalized: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with both sides' attributes and further columns, as <attribute>_a and <attribute>_b."""
    for side in "ab":
        values = normalized.select(F.col(ID).alias(side), *(F.col(x).alias(f"{x}_{side}") for x in (*ATTRIBUTES, *more)))
        pairs = pairs.join(values, side)
    return pairs


def of_one_side() -> dict[str, Column]:
    """What a comparison needs of one side alone."""
    return {"_grams": F.when(F.col("address").isNotNull(), S.bigrams(F.col("address")))}


def prepared(normalized: DataFrame) -> DataFrame:
    """Normalised records with what a comparison needs of one side alone."""
    return normalized.select(ID, *ATTRIBUTES, *(v.alias(c) for c, v in of_one_side().items()))


def similarities(pairs: DataFrame, normalized: DataFrame) -> DataFrame:
    """(a, b, block_origin, sim_<attribute>...)."""
    return similarities_of(with_values(pairs, prepared(normalized), ("_grams",)))


def similarities_of(wide: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The same of pairs that have both sides' prepared values; ``more`` names columns that stay."""
    side = lambda x: (F.col(f"{x}_a"), F.col(f"{x}_b"))
    # One pass through Python for names, cities and dates that are no dates; null asks for nothing.
    dates = [F.when(~F.col("birth_date_a").rlike(S.ISO) | ~F.col("birth_date_b").rlike(S.ISO), c) for c in side("birth_date")]
    wide = wide.withColumn("_k", S.jaro_winkler_columns([*(side(x) for x in S.BY_KERNEL), tuple(dates)]))
    raw = {x: F.col(f"_k.s{k}") for k, x in enumerate(S.BY_KERNEL)} | {
        "birth_date": S.date(*side("birth_date"), F.col(f"_k.s{len(S.BY_KERNEL)}")),
        "address": S.dice(*side("address"), *side("_grams")),
        "postal_code": S.postal(*side("postal_code")),
        "email": S.mail(*side("email")),
        "phone": S.equal(*side("phone")),
    }
    known = lambda x: side(x)[0].isNotNull() & side(x)[1].isNotNull()
    return wide.select("a", "b", "block_origin", *more, *(F.when(known(x), S.bounded(raw[x])).alias(f"sim_{x}") for x in ATTRIBUTES))


def levels(sims: DataFrame, strong: float = STRONG_FROM, partial: float = PARTIAL_FROM) -> DataFrame:
    """(a, b, block_origin, sims, lvl_<attribute>...)."""
    if not 0 <= partial <= strong <= 1:
        raise ValueError("cutoffs must satisfy 0 <= partial <= strong <= 1")
    return sims.select("*", *(S.level(F.col(f"sim_{x}"), strong, partial).alias(f"lvl_{x}") for x in ATTRIBUTES))
