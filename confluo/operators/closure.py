"""Entities as the transitive closure of linking pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ID
from .graph import connected


def check_pairs(pairs: DataFrame) -> None:
    """Raises if a pair links a record with itself."""
    if pairs.where("a = b").take(1):
        raise ValueError("a pair links a record with itself")


def edges(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def entities(links: DataFrame, universe: DataFrame) -> DataFrame:
    """(record_id, entity_id) of every record; an entity is named by its smallest record."""
    of = connected(links).withColumnRenamed("id", ID)
    return universe.select(ID).join(of, ID, "left").select(ID, F.coalesce("component_id", ID).alias("entity_id"))


def coverage(parts: DataFrame, links: DataFrame) -> DataFrame:
    """By entity of two records or more: size, pairs inside, direct links and pairs that the closure adds."""
    sizes = parts.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1")
    direct = links.join(parts.withColumnRenamed(ID, "a"), "a").groupBy("entity_id").agg(F.count("*").alias("n_direct"))
    inside = F.expr("n * (n - 1) div 2")
    return sizes.join(direct, "entity_id").select("entity_id", F.col("n").alias("n_records"), inside.alias("n_pairs"), "n_direct", (inside - F.col("n_direct")).alias("n_recovered"))


def unknown_ends(links: DataFrame, universe: DataFrame) -> DataFrame:
    """Links with an end outside the universe; a sound run has none."""
    ids = universe.select(F.col(ID).alias("e"))
    ends = links.select("a", "b", F.explode(F.array("a", "b")).alias("e"))
    return ends.join(ids, "e", "left_anti").select("a", "b").distinct()
