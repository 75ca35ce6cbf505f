"""Sharding by size-tiered compaction, with built-in functions and the file system's own calls only.

A store is a folder. Arrivals are appended as small immutable Parquet shards. A manifest names the shards of a version;
it is written aside and then renamed to its version's name, which fails if another writer was first, so a version
appears whole or not at all. Compaction takes the tiers of like-sized shards that have FANOUT shards or more, merges
each tier's run into files of up to the target size, and commits a manifest with the merged files in their place.

Merging is a read and a write without exchange: Spark's own packing of files into read partitions of at most the target
size makes one output file of each. Compaction deletes nothing, so readers of older versions and writers that have not
committed yet go on undisturbed. expire() is a call of its own: it removes versions beyond the last few, and folders
that no kept version names once they are older than a writer can take; so what a dead writer leaves goes in time.

A manifest is a small JSON with the version's schema and the name of its list of shards, a Parquet table with a row for
each shard, which Spark reads and joins like any other.

Defined results: empty arrivals add no shard and still make a version; nulls, repeated rows and any columns are stored
as they are; an arrival of another schema than the store's is refused; a shard larger than the target is left alone;
shards of one size are merged in the order of their paths; reading an empty store is an error.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
FANOUT = 4
#: Shards up to this size are of the lowest tier.
LEAST_BYTES = 1 << 20
#: Shards that one merge takes at most; the rest of a tier follows in the next round.
MOST_AT_ONCE = 10_000
#: Age from which expire() takes a folder that no version names for one that a dead writer left.
ABANDONED_S = 24 * 3600

LISTED = "path string, n_bytes long, n_rows long, tier int"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str | None
    listed: str | None
    n_shards: int = 0
    n_rows: int = 0


def tier_of(n_bytes: int) -> int:
    return max(0, math.ceil(math.log(max(n_bytes, 1) / LEAST_BYTES, FANOUT)))


def _tier() -> F.Column:
    """tier_of as an expression of n_bytes."""
    bounds = [LEAST_BYTES * FANOUT**k for k in range(12)]
    out = F.when(F.col("n_bytes") <= bounds[0], 0)
    for k, b in enumerate(bounds[1:], 1):
        out = out.when(F.col("n_bytes") <= b, k)
    return out.otherwise(len(bounds)).cast("int")


def _shape(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


class Store:
    """Shards below a folder of any store that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _list(self, path) -> list:
        return list(self.fs.listStatus(path)) if self.fs.exists(path) else []

    # Manifests ----------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._list(self._path("manifests")))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest(0, None, None)
        stream = self.fs.open(self._path(f"manifests/v{version:012d}.json"))
        try:
            return Manifest(**json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def listed(self, version: int | None = None) -> DataFrame:
        """(path, n_bytes, n_rows, tier) of a version; one row per shard."""
        m = self.manifest(version)
        return self.spark.read.schema(LISTED).parquet(f"{self.root}/{m.listed}") if m.listed else self.spark.createDataFrame([], LISTED)

    def _commit(self, version: int, schema: str, rows: DataFrame) -> Manifest:
        """Writes the list of shards and then, under its final name or not at all, the manifest."""
        name = f"lists/{uuid.uuid4().hex}"
        rows.coalesce(1 + self.manifest().n_shards // 100_000).write.parquet(f"{self.root}/{name}")
        n, total = self.spark.read.schema(LISTED).parquet(f"{self.root}/{name}").agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
        new = Manifest(version, schema, name, n, total)
        aside, to = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{version:012d}.json")
        out = self.fs.create(aside)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        plain = self.spark.sparkContext._gateway.new_array(rename, 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf).rename(aside, to, plain)
        except Exception as e:
            self.fs.delete(aside, False)
            self.fs.delete(self._path(name), True)
            if self.fs.exists(to):
                raise Conflict(f"version {version} exists") from e
            raise
        return new

    # Shards -------------------------------------------------------------------------------------------------------

    def _written(self, df: DataFrame, **options) -> DataFrame:
        """Writes df's partitions as shards below a folder of their own, and lists them; rows are counted from footers."""
        at = f"{self.root}/shards/{uuid.uuid4().hex}"
        df.write.options(**options).parquet(at)
        rows = self.spark.read.schema(df.schema).parquet(at).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("n_bytes")).agg(F.count("*").alias("n_rows"))
        return rows.withColumn("tier", _tier()).select("path", "n_bytes", "n_rows", "tier")

    def append(self, df: DataFrame, rows_per_shard: int = 0) -> Manifest:
        """Commits df as new small shards."""

        def fits(now: Manifest) -> None:
            if now.schema is not None and _shape(self._schema(now)) != _shape(df.schema):
                raise ValueError(f"the store has {_shape(self._schema(now))}, the arrival {_shape(df.schema)}")

        fits(self.manifest())
        new = self._written(df, **({"maxRecordsPerFile": rows_per_shard} if rows_per_shard else {}))
        while True:
            now = self.manifest()
            fits(now)
            try:
                return self._commit(now.version + 1, now.schema or df.schema.json(), self.listed(now.version).union(new))
            except Conflict:
                time.sleep(0.05)

    def runs(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> dict[int, list[str]]:
        """The tiers' runs that are due, as paths by tier: shards of at most half the target, MOST_AT_ONCE of a tier."""
        small = self.listed().where(F.col("n_bytes") <= target // 2)
        due = sorted(r.tier for r in small.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= fanout).collect())
        return {t: [r.path for r in small.where(F.col("tier") == t).orderBy("path").limit(MOST_AT_ONCE).select("path").collect()] for t in due}

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> Manifest:
        """Merges due runs until none is left; each merge commits one version and deletes nothing."""
        stuck: set[tuple[str, ...]] = set()
        while due := [run for run in self.runs(target, fanout).values() if tuple(run) not in stuck]:
            for run in due:
                now = self.manifest()
                new = self._merged(self._schema(now), run, target)
                gone = self.spark.createDataFrame([(p,) for p in run], "path string")
                before = self.listed(now.version).join(gone, "path", "left_semi").agg(F.sum("n_rows")).first()[0]
                n, rows = new.agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
                if rows != before:
                    raise RuntimeError("a merge changed the number of rows")
                if n >= len(run):
                    stuck.add(tuple(run))
                    continue
                while True:
                    now = self.manifest()
                    listed = self.listed(now.version)
                    if listed.join(gone, "path", "left_semi").count() != len(run):
                        raise Conflict("another compaction took these shards")
                    try:
                        self._commit(now.version + 1, now.schema, listed.join(gone, "path", "left_anti").union(new))
                        break
                    except Conflict:
                        time.sleep(0.05)
        return self.manifest()

    def _schema(self, m: Manifest) -> StructType:
        return StructType.fromJson(json.loads(m.schema))

    def _merged(self, schema: StructType, paths: list[str], target: int) -> DataFrame:
        """Writes the files anew, in read partitions of at most the target size."""
        conf = self.spark.conf
        keys = {"spark.sql.files.maxPartitionBytes": str(target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        before = {k: conf.get(k, None) for k in keys}
        try:
            for k, v in keys.items():
                conf.set(k, v)
            return self._written(self.spark.read.schema(schema).parquet(*paths))
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def expire(self, keep: int = 1, abandoned_s: float = ABANDONED_S) -> None:
        """Removes all versions but the last ``keep``, and folders older than ``abandoned_s`` seconds that none of these names."""
        versions = self.versions()
        kept = versions[-keep:]
        used = {self.manifest(v).listed.split("/")[1] for v in kept}
        for v in kept:
            folders = self.listed(v).select(F.element_at(F.split("path", "/"), -2).alias("f")).distinct()
            used |= {r.f for r in folders.toLocalIterator()}
        for v in versions[:-keep]:
            self.fs.delete(self._path(f"manifests/v{v:012d}.json"), False)
        for top in ("shards", "lists"):
            for folder in self._list(self._path(top)):
                if folder.getPath().getName() not in used and folder.getModificationTime() <= 1000 * (time.time() - abandoned_s):
                    self.fs.delete(folder.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the hidden _metadata column of Spark's file sources."""
        m = self.manifest(version)
        if m.schema is None:
            raise ValueError("the store is empty")
        paths = [r.path for r in self.listed(m.version).select("path").toLocalIterator()]
        return self.spark.read.schema(self._schema(m)).parquet(*paths) if paths else self.spark.createDataFrame([], self._schema(m))
