"""Tables written to the folder that the cluster shares, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset, as in local tests, a temporary one."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="confluo-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/confluo/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet below the shared folder and read it back; gives the path too, for dropped()."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def swept(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that have ended: Spark deletes them only once the driver collects garbage."""
    spark.sparkContext._jvm.System.gc()


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
