"""Exact n-gram Jaccard join as a metric-space join.

The Jaccard distance d = 1 - |x & y| / |x | y| of shingle sets is a metric; documents link when d <= r.

1. Documents with equal sets form one class; its document of the smallest id stands for it.
2. All shingles are ordered, rare ones first. Sets at distance r share one of the first n - ceil((1 - r) n) + 1 shingles
   of each. Of the documents that hold a shingle among these, the one of the smallest id is a pivot for all of them. A
   document's pivots are few, since copies of one text have the same ones; the region of a pivot are the documents that
   have it, and linked documents share a region.
3. Distances to the pivots are bounded from the first shingles, and measured exactly where the bound leaves a link
   possible. Documents within r of a pivot form its Voronoi cell: they are in one component and are not compared with
   each other. By the triangle inequality only documents up to 2 r from the pivot, the rim, can link with a document of
   the cell; documents beyond are compared with the rim and among each other.
4. Regions with more than one component join recursively: large ones are cut into blocks of cell, rim and beyond, of
   which only the pairs that can hold a link meet. In a pair of blocks, common shingles of all documents are counted by
   a matrix product, over the first shingles to drop documents without a possible partner in another component, then
   over whole sets. Links between components already joined in the block are not given out, so a block gives fewer
   links than it has documents.

Shingle frequencies only set the order. They are counted over all documents; the frequent ones number at most
FREQUENT, which bounds the broadcast.

Defined results: null or empty texts and texts without words have an empty set and link with nothing; very long texts
are compared whole; of documents with equal sets the smallest doc_id stands for all; a null doc_id is in no component; rows that repeat a doc_id count as one document; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, dropped, saved, swept, texts
from .components import connected
from .shingles import shingle_set

WIDTH, PERCENT = 5, 80
#: Shingles that are ordered last are at most so many: those that make up 1 / FREQUENT of all or more.
FREQUENT = 2_000_000
LEAST_FREQUENT = 12
#: Documents of a block.
BLOCK = 512
CELL, RIM, BEYOND = 0, 1, 2
#: Shingles counted together before a task's counts of LOCAL or more go out.
FLUSH, LOCAL = 4_000_000, 2


def prefix_length(n: int, percent: int) -> int:
    """Places of a set of n shingles so that sets linked at ``percent`` share one of theirs."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _local_counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, 0

        def counted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["shingle", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, width)
                held.append(s)
                size += len(s)
                total += len(s)
                if size >= FLUSH:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["shingle", "n"])

    return run


def frequent(docs: DataFrame, width: int, text: str = "text") -> np.ndarray:
    """Sorted hashes of the frequent shingles, at most FREQUENT."""
    rows, at = saved(docs.select(texts(docs, text).alias("t")).mapInArrow(_local_counts(width), "shingle long, n long"), "shingle-counts")
    total = rows.where("shingle IS NULL").agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_FREQUENT, -(-total // FREQUENT))
    often = rows.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = often.select("shingle").toPandas()["shingle"].to_numpy(dtype=np.int64)
    dropped(docs.sparkSession, at)
    return np.sort(found.view(np.uint64))


def _described(width: int, percent: int, often):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = often.value
        for batch in batches:
            n, digest, light, heavy = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(late):
                    at = np.searchsorted(late, s)
                    at[at == len(late)] = 0
                    is_late = late[at] == s
                else:
                    is_late = np.zeros(len(s), dtype=bool)
                first = s[~is_late]
                k = prefix_length(len(s), percent)
                light.append(first[:k])
                heavy.append(s[is_late][: k - min(k, len(first))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _lists(light), _lists(heavy)], ["doc_id", "n", "digest", "light", "heavy"])

    return run


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    places = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in arrays], out=places[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(flat.view(np.int64)))


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(t, width) for t in batch.column(1).to_pylist()])], ["id", "shingles"])

    return run


def common_counts(arrays: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of each two arrays of distinct elements."""
    m = len(arrays)
    of = np.repeat(np.arange(m), [len(x) for x in arrays])
    flat = np.concatenate(arrays) if m else np.empty(0, dtype=np.int64)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1
    of, column = of[shared], column[shared]
    out = np.zeros((m, m), dtype=np.float32)
    if len(column):
        column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
        for at in range(0, int(column[-1]) + 1, 4096):
            lo, hi = np.searchsorted(column, [at, at + 4096])
            a = np.zeros((m, 4096), dtype=np.float32)
            a[of[lo:hi], column[lo:hi] - at] = 1
            out += a @ a.T
    return out.astype(np.int64)


def _compared(percent: int, exact: bool):
    """Rows (task, id, n, c, state, rest, items), sorted by task, as links (exact) or as the rows with a possible partner."""

    def group(task: int, rows: list[tuple]) -> list[tuple[int, int]]:
        ids, n, c, state, rest = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(5))
        both = common_counts([r[5] for r in rows])
        nn = n[:, None] + n[None, :]
        if not exact:
            both = np.minimum(np.minimum(n[:, None], n[None, :]), both + np.maximum(rest[:, None], rest[None, :]))
        ok = 100 * both >= percent * (nn - both)
        ok &= c[:, None] != c[None, :]
        cell, beyond = state == CELL, state == BEYOND
        ok &= ~(cell[:, None] & (cell | beyond)[None, :]) & ~(beyond[:, None] & cell[None, :])
        if not exact:
            return [(task, int(x)) for x in ids[ok.any(axis=1)]]
        parent = {int(x): int(x) for x in c}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in np.argwhere(np.triu(ok)):
            a, b = root(int(c[i])), root(int(c[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
        return out

    names = ["a", "b"] if exact else ["task", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names)

        for batch in batches:
            tasks, columns = batch.column(0).to_pylist(), [batch.column(k).to_pylist() for k in range(1, 6)]
            items, places = batch.column(6).flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(batch.column(6).value_lengths().to_numpy(zero_copy_only=False))]
            for k, task in enumerate(tasks):
                if task != now:
                    if len(held) > 1:
                        out += group(now, held)
                    now, held = task, []
                held.append((*(x[k] for x in columns), np.array(items[places[k] : places[k + 1]])))
            if len(out) > 10_000:
                yield given()
                out = []
        if len(held) > 1:
            out += group(now, held)
        yield given()

    return run


class _Join:
    """One run over a table of documents."""

    def __init__(self, docs: DataFrame, width: int, percent: int, doc_id: str, text: str):
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        self.texts = docs.select(docs[doc_id].cast("long").alias("id"), texts(docs, text).alias("text"))
        often = self.spark.sparkContext.broadcast(frequent(self.texts, width))
        self.all, self.all_at = saved(self.texts.mapInArrow(_described(width, percent, often), "doc_id long, n long, digest binary, light array<long>, heavy array<long>"), "first-pivots")
        full = self.all.where("doc_id IS NOT NULL AND digest IS NOT NULL")
        classes = full.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("members"), F.countDistinct("doc_id").alias("ids"))
        self.classes, _ = saved(classes.where("members > 1"), "classes")
        # Sides without a proven bound are never broadcast, however small: the plan is the same at every size.
        copies = full.select("doc_id", "digest").join(self.classes.hint("merge"), "digest").where("doc_id <> id").select("doc_id").distinct()
        self.firsts = full.join(copies.hint("merge"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "n", "light", "heavy")

    # Similarities -------------------------------------------------------------------------------------------------

    def measured(self, pairs: DataFrame) -> tuple[DataFrame, list[str]]:
        """pairs (a, b) as (a, b, linked, near): near where a bound leaves d <= 2 r possible. Far pairs have no row."""
        p, reach = self.percent, 2 * self.percent - 100
        x = self.shared.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("items").alias("ia"))
        y = self.shared.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("items").alias("ib"))
        sized = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where(f"100 * least(na, nb) >= {reach} * greatest(na, nb)")
        most = F.least("na", "nb", F.size(F.array_intersect("ia", "ib")) + F.greatest("ra", "rb"))
        bounded = sized.select("a", "b", "na", "nb", most.alias("most")).where(f"100 * most >= {reach} * (na + nb - most)")
        bounded, bounded_at = saved(bounded.withColumn("open", F.expr(f"100 * most >= {p} * (na + nb - most)")), "bounded")
        asked = bounded.where("open").select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets, sets_at = self.sets_of(asked)
        left = bounded.where("open").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
        both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        common = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("c"))
        exact = common.select("a", "b", F.expr(f"100 * c >= {p} * (na + nb - c)").alias("linked"), F.expr(f"100 * c >= {reach} * (na + nb - c)").alias("near"))
        out, out_at = saved(exact.union(bounded.where("NOT open").select("a", "b", F.lit(False), F.lit(True))).where("linked OR near"), "distances")
        dropped(self.spark, bounded_at, sets_at)
        swept(self.spark)
        return out, [out_at]

    def sets_of(self, asked: DataFrame) -> tuple[DataFrame, str]:
        """(id, shingles) of the asked ids."""
        some = self.texts.join(asked.select("id").distinct().hint("merge"), "id", "left_semi")
        return saved(some.select("id", "text").mapInArrow(_sets(self.width), "id long, shingles array<long>"), "sets")

    # Regions ------------------------------------------------------------------------------------------------------

    def regions(self) -> tuple[DataFrame, list[str]]:
        """Distinct (p, id): documents by their pivots. Sets self.shared to what bounds need: (id, n, rest, items).

        Of the first shingles only those that another document has among its own can be common, so items has no others.
        """

        def of(column: str, once: bool) -> DataFrame:
            rows = self.firsts.select("id", F.explode(column).alias("shingle"))
            # A light shingle has few documents, so all rows of one can come together, and in one exchange.
            rows = rows.repartition("shingle") if once else rows
            pivots = rows.groupBy("shingle").agg(F.min("id").alias("p"), F.max("id").alias("last")).where("p < last").select("shingle", "p")
            return rows.join(pivots, "shingle").select("p", "id", "shingle")

        met, met_at = saved(of("light", True).union(of("heavy", False)), "met")
        items = met.groupBy("id").agg(F.collect_set("shingle").alias("items"))
        sizes = self.firsts.select("id", F.col("n"), (F.col("n") - F.size("light") - F.size("heavy")).alias("rest"))
        self.shared, shared_at = saved(items.join(sizes, "id").select("id", "n", "rest", "items"), "shared")
        cells, at = saved(met.select("p", "id").distinct(), "regions")
        # The first shingles are in items now; what is left to say of a document is short.
        wide_at = self.all_at
        self.all, self.all_at = saved(self.all.select("doc_id", "n", "digest"), "documents")
        dropped(self.spark, met_at, wide_at)
        swept(self.spark)
        return cells, [at, shared_at]

    def tasks(self, cells: DataFrame) -> DataFrame:
        """(task, id, c, state) for the pairs of blocks of each region of (p, id, c, state) that can hold a link."""
        count = lambda k: F.ceil(F.sum(F.when(F.col("state") == k, 1).otherwise(0)) / BLOCK).cast("int")
        sizes = cells.groupBy("p").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), count(CELL).alias("n0"), count(RIM).alias("n1"), count(BEYOND).alias("n2"))
        sizes = sizes.where("lo <> hi").drop("lo", "hi")
        block = "pmod(xxhash64(id), CASE state WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END)"
        rows = cells.join(sizes, "p").withColumn("b", F.expr(f"cast({block} as int)"))
        upto = lambda n: f"filter(sequence(0, {n}), j -> j < {n})"
        same = lambda k: f"transform({upto(f'n{k}')}, j -> xxhash64(p, {k}, least(b, j), {k}, greatest(b, j)))"
        mixed = lambda other, k: f"transform({upto(f'n{other}')}, j -> xxhash64(p, 1, {'j, ' + str(k) + ', b' if other == 1 else 'b, ' + str(other) + ', j'}))"
        tasks = F.expr(f"""CASE WHEN m <= {BLOCK} THEN array(xxhash64(p))
            WHEN state = 0 THEN {mixed(1, 0)}
            WHEN state = 1 THEN concat({same(1)}, {mixed(0, 1)}, {mixed(2, 1)})
            ELSE concat({same(2)}, {mixed(1, 2)}) END""")
        return rows.select(F.explode(tasks).alias("task"), "id", "c", "state")

    def compared(self, rows: DataFrame, exact: bool) -> DataFrame:
        rows = rows.select("task", "id", "n", "c", "state", "rest", "items").repartition("task").sortWithinPartitions("task")
        return rows.mapInArrow(_compared(self.percent, exact), "a long, b long" if exact else "task long, id long")

    def run(self) -> DataFrame:
        regions, made = self.regions()
        found, (found_at,) = self.measured(regions.where("p <> id").select(F.col("p").alias("a"), F.col("id").alias("b")))
        links = found.where("linked").select("a", "b")
        of, of_at = saved(connected(links), "components")
        state = F.when((F.col("p") == F.col("id")) | F.col("linked"), CELL).when(F.col("near"), RIM).otherwise(BEYOND)
        known = found.select(F.col("a").alias("p"), F.col("b").alias("id"), "linked", "near")
        cells = regions.join(known, ["p", "id"], "left").join(of, "id", "left").select("p", "id", F.coalesce("component_id", "id").alias("c"), state.alias("state"))
        cells, cells_at = saved(cells, "cells")
        tasks, tasks_at = saved(self.tasks(cells), "tasks")
        first = tasks.join(self.shared.hint("merge"), "id")
        open_rows, open_at = saved(self.compared(first, exact=False), "open")
        swept(self.spark)
        sets, sets_at = self.sets_of(open_rows.select("id").distinct())
        whole = tasks.join(open_rows, ["task", "id"]).join(sets.select("id", F.size("shingles").cast("long").alias("n"), F.lit(0).cast("long").alias("rest"), F.col("shingles").alias("items")), "id")
        more, more_at = saved(self.compared(whole, exact=True), "links")
        swept(self.spark)
        of = connected(links.union(more))
        dropped(self.spark, *made, found_at, of_at, cells_at, tasks_at, open_at, sets_at, more_at)
        members = self.all.select("doc_id", "n", "digest").join(self.classes.select("digest", "id").hint("merge"), "digest", "left")
        out = members.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("id", "doc_id").alias("id"))
        return out.join(of, "id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id reachable by links of Jaccard similarity percent / 100 or more."""
    if not 50 < percent <= 100:
        raise ValueError("percent is above 50 and at most 100")
    with batches(docs.sparkSession):
        return _Join(docs, width, percent, doc_id, text).run()
