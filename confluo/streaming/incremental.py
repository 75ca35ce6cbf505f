"""Incremental linking of a stream of records against those already kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import blocking, compare, decide
from ..schema import ID


def new_pairs(arrived: DataFrame, kept: DataFrame, passes: tuple[str, ...] = blocking.DEFAULT_PASSES) -> DataFrame:
    """Candidate pairs with at least one new record; kept records meet only what arrived."""
    n, k = blocking.block_keys(arrived, passes), blocking.block_keys(kept, passes)
    left, right = n.withColumnRenamed(ID, "x"), n.unionByName(k).withColumnRenamed(ID, "y")
    pairs = left.join(right, ["pass", "key"]).where("x <> y")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "pass", "key"))).alias("block_origin"))


def linker(kept_path: str, decisions_path: str, weights: decide.Table, upper: float, lower: float) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: links each batch with fixed weights, appends decisions and records. Batches that were written before are written again to the same folder, so a restart changes nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = normalize(batch.dropDuplicates([ID]))
        try:
            kept = spark.read.parquet(f"{kept_path}/*").where(F.col("batch") < batch_id).drop("batch")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            kept = spark.createDataFrame([], arrived.schema)
        both = kept.unionByName(arrived)
        levels = compare.levels(compare.similarities(new_pairs(arrived, kept), both))
        decide.decisions(levels, weights, upper, lower).select("a", "b", "match_weight", "verdict").write.mode("overwrite").parquet(f"{decisions_path}/b{batch_id}")
        arrived.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{kept_path}/b{batch_id}")

    return run
