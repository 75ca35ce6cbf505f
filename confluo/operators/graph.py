"""Connected components of a link table: distributed union-find by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluo.scratch import dropped, is_empty, saved


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) for every id that has a link to another one: the smallest id reachable by links.

    In a round every id hooks to the smallest of its neighbours and itself, pointers jump to their roots, and links
    between different roots stay as links of the contracted graph. Each round at least halves the ids that still have
    links, and each jump halves a chain. Nothing but emptiness tests reaches the driver; minima are combined before
    the shuffle, so a hub with very many links costs a task no more than others. Rows with a null end, loops and
    repeated links change nothing; without links the result is empty.
    """
    spark = links.sparkSession
    lo, hi = F.least(a, b), F.greatest(a, b)
    edges, at = saved(links.where(f"`{a}` <> `{b}`").select(lo.alias("a"), hi.alias("b")).distinct(), "links")
    total, done = None, []
    while not is_empty(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("to"))
        hook, hook_at = saved(hook, "hooks")
        while True:
            far = hook.where("id <> to").select(F.col("id").alias("to"), F.col("to").alias("next"))
            if is_empty(hook.join(far, "to", "left_semi")):
                break
            jumped, jumped_at = saved(hook.join(far, "to", "left").select("id", F.coalesce("next", "to").alias("to")), "hooks")
            dropped(spark, hook_at)
            hook, hook_at = jumped, jumped_at
        near = edges.join(hook.select(F.col("id").alias("a"), F.col("to").alias("ra")), "a").join(hook.select(F.col("id").alias("b"), F.col("to").alias("rb")), "b")
        left = near.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        left, left_at = saved(left, "links")
        if total is None:
            whole, whole_at = hook, hook_at
        else:
            step = hook.select(F.col("id").alias("component_id"), "to")
            whole, whole_at = saved(total.join(step, "component_id", "left").select("id", F.coalesce("to", "component_id").alias("to")), "components")
            done.append(hook_at)
        dropped(spark, at, *done)
        done = [whole_at]
        total, edges, at = whole.withColumnRenamed("to", "component_id"), left, left_at
    dropped(spark, at)
    return total if total is not None else links.select(F.col(a).alias("id"), F.col(b).alias("component_id")).limit(0)
