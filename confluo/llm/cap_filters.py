"""Embedding near-dedup by spherical-cap filters.

Directions come from a random product code: the space is cut into PARTS blocks (one in fewer than WHOLE dimensions), each
block has a random codebook of unit vectors, and every combination of code words is a filter direction; TABLES codes differ in a random rotation. A vector passes a filter if its inner product
with the direction exceeds a threshold; list decoding finds all of them from the blocks' scores alone, since a sum of
two halves is above the threshold only where one half leaves the other enough. Close vectors pass common filters, so
vectors are joined on filters, and cosines in double precision verify what meets.

The threshold gives two vectors at the wanted cosine COMMON filters in common on average, by the exact distribution of a
random direction in their dimension, so the share of links found does not depend on the number of vectors. The codebooks
grow with that number, so filters hold few vectors at every size; a vector's filters follow from its direction alone. Filters of more than
BLOCK vectors are cut into blocks that meet pair by pair. A pair counts in the first filter that both its vectors pass.
Links are not given out: a task gives for its vectors the number of links, and a spanning forest of the links.

Equal vectors are one class, for which the smallest vec_id goes through the search with the number of its members, so a
group of copies costs one vector and no pair within it is made.

The search can miss pairs whose caps have no common filter; the README has the measured recall.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors
of different dimension do not link; rows that repeat both vec_id and vector count once; a null vec_id links with nothing
and is kept; a cosine of just the wanted value links; long vectors are handled whole, in batches of BATCH_ROWS; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, dropped, saved
from .components import connected
from .ngram_join import common_counts

PARTS, TABLES = 2, 12
#: Below this dimension a code has one block, of at most ONE_BLOCK words: blocks of few dimensions have too few directions.
WHOLE, ONE_BLOCK = 16, 8192
COMMON = 14.0
#: Code words of a block: as many as make the filters of all codes three times the vectors, within these.
LEAST_WORDS, MOST_WORDS = 32, 4096
BLOCK = 512
COSINE = 0.9


def both_pass(least: float, dim: int, cosine: float) -> float:
    """Probability that a random direction has an inner product of at least ``least`` with two unit vectors at that cosine."""
    half = math.acos(max(-1.0, min(1.0, cosine))) / 2
    if dim <= 2:
        return max(0.0, math.acos(least) - half) / math.pi
    # The squared length r^2 of the direction's part in the vectors' plane has P(r^2 > s) = (1 - s)^((dim - 2) / 2).
    power = (dim - 2) / 2
    tail = power * math.log1p(-least * least) + np.linspace(-60.0, 0.0, 20_001)
    r = np.sqrt(np.maximum(-np.expm1(tail / power), least * least))
    angle = np.clip(np.arccos(np.minimum(1.0, np.divide(least, r, out=np.zeros_like(r), where=r > 0))) - half, 0.0, None)
    return float(np.trapezoid(angle, np.exp(tail))) / math.pi


def threshold(dim: int, filters: float, cosine: float, common: float = COMMON) -> float:
    """The threshold at which two unit vectors at that cosine pass ``common`` of the filters together, on average."""
    lo, hi = 0.0, 1.0 - 1e-12
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if filters * both_pass(mid, dim, cosine) > common else (lo, mid)
    return lo


class Code:
    """The product code of a dimension."""

    def __init__(self, dim: int, words: int, seed: int = 0, cosine: float = COSINE, common: float = COMMON):
        rng = np.random.default_rng([seed, dim, words])
        self.cuts = np.array_split(np.arange(dim), PARTS if dim >= WHOLE else 1)
        if len(self.cuts) == 1:
            words = min(ONE_BLOCK if dim > 1 else 4, words * words)
        self.words = words
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.turn = turn
        self.books = []
        for cut in self.cuts:
            book = rng.standard_normal((words, len(cut)))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True) * math.sqrt(len(cut) / dim))
        self.least = threshold(dim, TABLES * float(words) ** len(self.cuts), cosine, common)

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """Numbers of all filters that each of the unit vectors passes, ascending."""
        x = unit @ self.turn
        sums = [x[:, cut] @ book.T for cut, book in zip(self.cuts, self.books, strict=True)]
        half = (len(sums) + 1) // 2
        left, right = _all_sums(sums[:half]), _all_sums(sums[half:]) if sums[half:] else np.zeros((len(x), 1))
        out = []
        most = right.max(axis=1)
        for k in range(len(x)):
            i = np.flatnonzero(left[k] > self.least - most[k])
            a, b = np.nonzero(right[k][None, :] > self.least - left[k][i][:, None])
            out.append(np.sort(i[a].astype(np.int64) * right.shape[1] + b))
        return out


def _all_sums(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0]
    for p in parts[1:]:
        out = (out[:, :, None] + p[:, None, :]).reshape(len(out), -1)
    return out


_CODES: dict[tuple, Code] = {}


def _code(*key) -> Code:
    if key not in _CODES:
        _CODES[key] = Code(*key)
    return _CODES[key]


def _decoded(words: int, seed: int, cosine: float, common: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, members = (batch.column(k).to_pylist() for k in range(3))
            by_dim: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(k)
            for dim, ks in by_dim.items():
                x = np.array([vectors[k] for k in ks], dtype=np.float64)
                size = np.abs(x).max(axis=1)  # first by the largest component: squares neither vanish nor overflow
                ok = np.isfinite(size) & (size > 0)
                x, ks = x[ok] / size[ok][:, None], [k for k, f in zip(ks, ok, strict=True) if f]
                if not ks:
                    continue
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                tables = [_code(dim, words, seed * TABLES + t, cosine, common).filters(unit) for t in range(TABLES)]
                found = [np.concatenate([f + (t << 40) for t, f in enumerate(fs)]) for fs in zip(*tables, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in ks], pa.int64()), pa.array([dim] * len(ks), pa.int32()), pa.array(list(unit), pa.list_(pa.float64())), pa.array(found, pa.list_(pa.int64())), pa.array([members[k] for k in ks], pa.int64())], ["vec_id", "dim", "unit", "filters", "members"]
                )

    return run


def _verified(cosine: float):
    def group(rows: list[tuple]) -> tuple[list, list]:
        key = rows[0][0]
        ids = np.array([r[2] for r in rows], dtype=np.int64)
        x = np.array([r[4] for r in rows])
        side = np.array([r[3] for r in rows])
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        linked &= ids[:, None] != ids[None, :]
        if key[2] != key[3]:
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return [], []
        some = linked.any(axis=1)
        linked, ids = linked[np.ix_(some, some)], ids[some]
        lists = [r[5] for r, s in zip(rows, some, strict=True) if s]
        first = linked & (common_counts([f[f < key[1]] for f in lists]) == 0)
        members = np.array([r[6] for r, s in zip(rows, some, strict=True) if s], dtype=np.int64)
        counts = [(int(i), int(n)) for i, n in zip(ids, first @ members, strict=True) if n]
        label = np.arange(len(ids))
        order = np.argsort(ids, kind="stable")
        label[order] = np.arange(len(ids))
        while True:
            best = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(axis=1))
            if (best == label).all():
                break
            label = best
        roots = ids[order][label]
        return counts, [(int(a), int(b)) for a, b in zip(ids, roots, strict=True) if a != b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def flush() -> None:
            if len(held) > 1:
                counts, links = group(held)
                out.extend((i, None, n) for i, n in counts)
                out.extend((a, b, None) for a, b in links)

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["a", "b", "n"])

        for batch in batches:
            for r in batch.to_pylist():
                key = (r["dim"], r["filter"], r["b1"], r["b2"])
                if key != now:
                    flush()
                    now, held = key, []
                held.append((key, r["filter"], r["vec_id"], r["side"], r["unit"], np.array(r["filters"], dtype=np.int64), r["members"]))
            if len(out) > 10_000:
                yield given()
                out = []
        flush()
        yield given()

    return run


def near_links(vectors: DataFrame, cosine: float = COSINE, seed: int = 0, common: float = COMMON, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vec_id, n_links) of vectors with links, and (a, b): links that hold each component together."""
    spark = vectors.sparkSession
    n = vectors.count()
    words = min(MOST_WORDS, max(LEAST_WORDS, math.ceil(math.sqrt(3 * n / TABLES))))
    e = vectors[embedding].cast("array<double>")
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), e.alias("e")).where("vec_id IS NOT NULL AND size(e) > 0 AND NOT exists(e, x -> x IS NULL OR isnan(x))").distinct()
    classes = rows.groupBy("e").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("members"))
    with batches(spark):
        decoded, decoded_at = saved(classes.select("vec_id", "e", "members").mapInArrow(_decoded(words, seed, cosine, common), "vec_id long, dim int, unit array<double>, filters array<long>, members long"), "filters")
    passed = decoded.select("vec_id", "dim", F.explode("filters").alias("filter"))
    sizes = passed.groupBy("dim", "filter").agg(F.count("*").alias("m")).where("m > 1").withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int"))
    met = passed.join(sizes, ["dim", "filter"]).withColumn("side", F.expr("cast(pmod(xxhash64(vec_id), nb) as int)"))
    tasks = met.select("vec_id", "dim", "filter", "side", F.explode(F.expr("sequence(0, nb - 1)")).alias("o"))
    tasks = tasks.select("vec_id", "dim", "filter", "side", F.least("side", "o").alias("b1"), F.greatest("side", "o").alias("b2"))
    whole = tasks.join(decoded.select("vec_id", "unit", "filters", "members", F.col("dim").alias("_d")), "vec_id").where("dim = _d").drop("_d")
    keys = ["dim", "filter", "b1", "b2"]
    whole = whole.repartition(*keys).sortWithinPartitions(*keys)
    with batches(spark):
        found, _ = saved(whole.mapInArrow(_verified(cosine), "a long, b long, n long"), "vector-links")
    # Vectors that have no direction are in no class of the search, and link with none of their copies either.
    many = rows.join(classes.withColumnRenamed("vec_id", "first"), "e").join(decoded.select(F.col("vec_id").alias("first"), F.col("dim").alias("_d")), "first").where("_d = size(e)")
    of_class, of_at = saved(many.select("vec_id", "first", "members"), "vector-classes")
    dropped(spark, decoded_at)
    sums = found.where("n IS NOT NULL").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("n"))
    counts = of_class.join(sums, "first", "left").groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    copies = of_class.where("vec_id <> first").select(F.col("vec_id").alias("a"), F.col("first").alias("b"))
    return counts, found.where("b IS NOT NULL").select("a", "b").union(copies)


def dedup(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", **how) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable) and kept."""
    counts, links = near_links(vectors, cosine, vec_id=vec_id, embedding=embedding, **how)
    of = connected(links).withColumnRenamed("id", "vec_id")
    out = vectors.select(vectors[vec_id].cast("long").alias("vec_id")).join(counts, "vec_id", "left").join(of, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
