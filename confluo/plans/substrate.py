"""Tables that all queries over one input share: normalised records, profiles, links, entities and, where few, pairs.

Each is computed once for a session and an input, written below the shared folder and read from there by whoever asks
next; an input whose files change gets tables of its own. Pairs grow with the square of a block, so compared pairs and
decisions are written only while there are at most FEW_PAIRS of them; beyond that every query makes them anew, in one
pass from blocks to its result, and nothing of their size comes to disk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..scratch import saved

INPUTS = ("customer", "nation", "supplier")
#: Candidate pairs up to which compared pairs are written; by this alone results do not differ.
FEW_PAIRS = 4_000_000
#: Pairs that a task makes on average, where they are not few.
PAIRS_A_TASK = 8_000_000
_HELD: dict[tuple, tuple[str, object]] = {}
_COUNTED: dict[tuple, int] = {}


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Sizes and times of change of the input tables."""
    found = []
    for t in INPUTS:
        fs, p = _path(spark, f"{sf_dir}/{t}.parquet")
        found.append((fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()))
    return (sf_dir, *found)


def held(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The shared table of that name; ``make`` computes it where it is not there yet."""
    key = (spark.sparkContext.applicationId, name, *stamp(spark, sf_dir))
    if key in _HELD:
        at, schema = _HELD[key]
        fs, p = _path(spark, at)
        if fs.exists(p):
            return spark.read.schema(schema).parquet(at)
    out, at = saved(make(), name)
    _HELD[key] = (at, out.schema)
    return out


def counted(spark: SparkSession, sf_dir: str, count: Callable[[], int]) -> int:
    """The number of candidate pairs, which ``count`` tells once for a session and an input."""
    key = (spark.sparkContext.applicationId, *stamp(spark, sf_dir))
    if key not in _COUNTED:
        _COUNTED[key] = count()
    return _COUNTED[key]


def few(spark: SparkSession, sf_dir: str, count: Callable[[], int]) -> bool:
    """Whether the input has at most FEW_PAIRS candidate pairs."""
    return counted(spark, sf_dir, count) <= FEW_PAIRS


def held_if(small: bool, spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    return held(spark, sf_dir, name, make) if small else make()
