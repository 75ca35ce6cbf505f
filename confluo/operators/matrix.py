"""Pairs of large blocks compared as matrices: every pair is compared, by the distinct values of its block.

Two tiles of a block come together in a task (blocking.dealt). For each attribute the distinct values of both sides give a
small matrix of levels, and a pair's level is a cell of it; the levels of all attributes make up the pair's code. Levels are
those of compare.levels, with the cutoffs where rounding to six decimals puts them. What leaves a task is counts of codes,
the pairs of some codes, or a matrix of codes that the JVM turns into one row for each pair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import characters, jaro_winkler_at
from ..schema import ATTRIBUTES, ID, LEVELS, MISSING

#: Cells of a matrix of codes, rows of blocks that are taken together, and values whose level by value pair a worker keeps.
CELLS, SMALL, KEPT = 1 << 20, 256, 4096
#: Similarities are rounded to six decimals before they are held against 0.9 and 0.7.
STRONG_AT, PARTIAL_AT = 0.8999995, 0.6999995
N_STRONG, N_PARTIAL, N_DISAGREE, N_MISSING = range(4)
#: Bits of a code: two for each attribute's level, two for the fold, one for truth.
FOLD, TRUE = 2 * len(ATTRIBUTES), 2 * len(ATTRIBUTES) + 2
PROFILES = 1 << FOLD
#: The code of a cell that is no pair of its block.
NONE = -1
DATE = re.compile(r"(\d{4})-(\d{2})-(\d{2})", re.ASCII)


# Levels of distinct values ---------------------------------------------------------------------------------------


def _level(s: np.ndarray) -> np.ndarray:
    return np.where(s >= STRONG_AT, N_STRONG, np.where(s >= PARTIAL_AT, N_PARTIAL, N_DISAGREE)).astype(np.uint8)


def _all_pairs(u: list[str], v: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(u)), len(v)), np.tile(np.arange(len(v)), len(u))


def names(u: list[str], v: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return _level(jaro_winkler_at(u, v, i, j))


def _common_prefix(x: str, y: str) -> int:
    n = 0
    for c, d in zip(x, y, strict=False):
        if c != d:
            break
        n += 1
    return n


def postal(u: list[str], v: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    (a, lu), (b, lv) = characters(u), characters(v)
    n, same = np.zeros(len(i)), np.ones(len(i), dtype=bool)
    for k in range(min(a.shape[1], b.shape[1])):
        same &= (a[:, k][i] == b[:, k][j]) & (k < lu[i]) & (k < lv[j])
        if not same.any():
            break
        n += same
    return _level(n / np.maximum(lu[i], lv[j]))


class _Kept:
    """Levels by pair of values, kept in a worker from task to task while there are at most KEPT values."""

    def __init__(self, of: Callable):
        self.of, self.ids, self.values = of, {}, []
        self.table = np.full((0, 0), 255, dtype=np.uint8)

    def levels(self, u: list[str], v: list[str]) -> np.ndarray:
        if len(u) + len(v) > KEPT:
            out = np.empty((len(u), len(v)), dtype=np.uint8)
            step = max(1, CELLS // max(1, len(v)))
            for at in range(0, len(u), step):
                i, j = _all_pairs(u[at : at + step], v)
                out[at : at + step] = self.of(u[at : at + step], v, i, j).reshape(-1, len(v))
            return out
        new = {x for x in (*u, *v) if x not in self.ids}
        if len(self.ids) + len(new) > KEPT:
            self.__init__(self.of)
            new = {*u, *v}
        for x in new:
            self.ids[x] = len(self.values)
            self.values.append(x)
        if len(self.values) > len(self.table):
            grown = np.full((min(KEPT, max(64, 2 * len(self.values))),) * 2, 255, dtype=np.uint8)
            grown[: len(self.table), : len(self.table)] = self.table
            self.table = grown
        at = np.ix_([self.ids[x] for x in u], [self.ids[x] for x in v])
        out = self.table[at]
        if (out == 255).any():
            i, j = np.nonzero(out == 255)
            out[i, j] = self.of(u, v, i, j)
            self.table[at] = out
        return out


_NAMES, _POSTAL = _Kept(names), _Kept(postal)
_GRAMS: dict[str, tuple[int, ...]] = {}
_GRAM_IDS: dict[tuple[str, int], int] = {}


def _grams(x: str) -> tuple[int, ...]:
    """Bigrams as numbers, the k-th of equal ones apart from the others."""
    if x not in _GRAMS:
        seen: Counter = Counter()
        out = []
        for g in [x] if len(x) < 2 else [x[k : k + 2] for k in range(len(x) - 1)]:
            seen[g] += 1
            out.append(_GRAM_IDS.setdefault((g, seen[g]), len(_GRAM_IDS)))
        _GRAMS[x] = tuple(out)
    return _GRAMS[x]


def incidence(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 0/1 matrix of distinct values by bigram, bigrams of one value alone left out, and the numbers of bigrams."""
    if len(_GRAMS) > 200_000:
        _GRAMS.clear()
        _GRAM_IDS.clear()
    sets = [_grams(x) for x in values]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.fromiter((g for s in sets for g in s), dtype=np.int64, count=int(sizes.sum()))
    of = np.repeat(np.arange(len(sets)), sizes)
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    often = n > 1
    column = np.cumsum(often) - 1
    out = np.zeros((len(sets), max(1, int(often.sum()))), dtype=np.float32)
    some = often[at]
    out[of[some], column[at[some]]] = 1
    return out, sizes


def _least_common(total: int, cut: float) -> int:
    """The least c with 2 c / total at the cutoff or above, in the doubles that the comparison uses."""
    c = max(0, int(cut * total / 2) - 2)
    while 2.0 * c / total < cut:
        c += 1
    return c


def dice(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    common = x @ y.T
    out = np.empty(common.shape, dtype=np.uint8)
    totals = {int(t) for a in np.unique(nx) for t in a + np.unique(ny)}
    strong, partial = np.zeros(max(totals) + 1, dtype=np.float32), np.zeros(max(totals) + 1, dtype=np.float32)
    for t in totals:
        strong[t], partial[t] = _least_common(t, STRONG_AT), _least_common(t, PARTIAL_AT)
    for n in np.unique(nx):
        rows = nx == n
        c = common[rows]
        out[rows] = np.uint8(N_DISAGREE) - (c >= partial[n + ny]) - (c >= strong[n + ny]).astype(np.uint8)
    return out


def _dates(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Year, month, day, month-day and day-month of ISO dates, and which values are such."""
    found = [DATE.fullmatch(v) for v in values]
    ymd = np.array([[int(g) for g in m.groups()] if m else (-1, -1, -1) for m in found], dtype=np.int16).reshape(-1, 3)
    return np.column_stack([ymd, ymd[:, 1] * 100 + ymd[:, 2], ymd[:, 2] * 100 + ymd[:, 1]]).astype(np.int16), np.array([m is not None for m in found], dtype=bool)


def dates(u: list[str], v: list[str], x: tuple, y: tuple) -> np.ndarray:
    (a, iso_a), (b, iso_b) = x, y
    same = lambda k, m: a[:, k][:, None] == b[:, m][None, :]
    year = same(0, 0)
    n = year.astype(np.uint8)
    n += same(1, 1)
    n += same(2, 2)
    # Day and month swapped counts as two equal components.
    swapped = year & same(3, 4) & (n < 2)
    out = np.uint8(N_DISAGREE) - (n >= 2).astype(np.uint8) - (n == 3).astype(np.uint8)
    out[swapped] = N_PARTIAL
    for k in np.nonzero(~iso_a)[0]:
        out[k] = names(u, v, np.full(len(v), k), np.arange(len(v)))
    for k in np.nonzero(~iso_b)[0]:
        out[:, k] = names(u, v, np.arange(len(u)), np.full(len(u), k))
    return out


def _one_edit(x: str, y: str) -> bool:
    if abs(len(x) - len(y)) > 1:
        return False
    n = _common_prefix(x, y)
    return x[n + (len(x) >= len(y)) :] == y[n + (len(y) >= len(x)) :]


def _runs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i of left and j of right with equal elements."""
    order = np.argsort(right, kind="stable")
    ordered = right[order]
    lo, hi = np.searchsorted(ordered, left, "left"), np.searchsorted(ordered, left, "right")
    n = hi - lo
    i = np.repeat(np.arange(len(left)), n)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]


def near(values: list[str], longest: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y), x <> y, of distinct values with one edit between them, in both orders.

    Values with an edit between them are equal without one character each, or one equals the other without a character.
    """
    lengths = np.array([len(v) for v in values], dtype=np.int64)
    out: set[tuple[int, int]] = set()
    for x in np.nonzero(lengths > longest)[0]:
        for y in np.nonzero(np.abs(lengths - lengths[x]) <= 1)[0]:
            if x != y and _one_edit(values[x], values[y]):
                out |= {(int(x), int(y)), (int(y), int(x))}
    short = np.nonzero(lengths <= longest)[0]
    if len(short) > 1:
        texts = [values[k] for k in short]
        n, size = lengths[short], int(lengths[short].max())
        cells = np.zeros((len(short), size), dtype=np.uint64)
        cells[np.arange(size) < n[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        with np.errstate(over="ignore"):
            base, other, third = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
            powers = np.ones(size + 2, dtype=np.uint64)
            for k in range(size + 1):
                powers[k + 1] = powers[k] * base
            prefix = np.zeros((len(short), size + 1), dtype=np.uint64)
            for k in range(size):
                prefix[:, k + 1] = prefix[:, k] * base + cells[:, k] + np.uint64(1)
            whole = prefix[np.arange(len(short)), n]
            at, of = np.arange(size)[None, :], n[:, None]
            # Without character k: what is before it moves one place, and what is after it stays.
            rest = powers[np.maximum(of - at - 1, 0)]
            without = prefix[:, :-1] * rest + (whole[:, None] - prefix[:, 1:] * rest)
            inside = at < of
            row, place = np.nonzero(inside)
            gone = without[inside]
            same = (gone ^ (gone >> np.uint64(29))) * other + place.astype(np.uint64) * third + n[row].astype(np.uint64) * base
        i, j = _runs(same, same)
        found = [(row[i], row[j])]
        i, j = _runs(gone, whole)
        fits = n[row[i]] == n[j] + 1
        found += [(row[i][fits], j[fits]), (j[fits], row[i][fits])]
        x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        for p, q in np.unique(np.column_stack([x, y])[x != y], axis=0).tolist():
            if _one_edit(texts[p], texts[q]):
                out.add((int(short[p]), int(short[q])))
    both = np.array(sorted(out), dtype=np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


# Blocks ----------------------------------------------------------------------------------------------------------


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Codes of a column's values, -1 where null, and the values."""
    found = column.combine_chunks().dictionary_encode()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


class Unit:
    """Rows of two tiles of a block, of one tile with itself, or of several small blocks."""

    def __init__(self, table: pa.Table):
        self.table = table
        t, i, j = (table.column(c).to_numpy() for c in "tij")
        self.block = _coded(table.column("k"))[0]
        self.apart = bool(i[0] != j[0])
        self.a = np.nonzero(t == i)[0] if self.apart else np.arange(table.num_rows)
        self.b = np.nonzero(t == j)[0] if self.apart else self.a
        self.ids = table.column(ID).combine_chunks()
        codes, ids = _coded(table.column(ID))
        place = np.empty(len(ids), dtype=np.int64)
        place[sorted(range(len(ids)), key=lambda k: ids[k].encode("utf-8", "surrogatepass"))] = np.arange(len(ids))
        self.rank = place[codes]
        lists = table.column("before").combine_chunks()
        n = lists.value_lengths().to_numpy()
        flat, keys = _coded(pa.chunked_array([lists.flatten()]))
        passes = [k.split(":", 1)[0] for k in keys]
        row, kind = np.repeat(np.arange(len(n)), n), np.array([sorted(set(passes)).index(p) for p in passes], dtype=np.int64)[flat] if len(flat) else flat
        self.before: dict[int, list[np.ndarray]] = {}
        if len(np.unique(row * (len(passes) + 1) + kind)) == len(row):
            for p in np.unique(kind).tolist():
                self.before[p] = [np.full(len(n), -1, dtype=np.int32)]
                self.before[p][0][row[kind == p]] = flat[kind == p]
            return
        for r, p, code in zip(row.tolist(), kind.tolist(), flat.tolist(), strict=True):
            columns = self.before.setdefault(p, [np.full(len(n), -1, dtype=np.int32)])
            free = next((c for c in columns if c[r] < 0), None)
            if free is None:
                columns.append(free := np.full(len(n), -1, dtype=np.int32))
            free[r] = code

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(a, b, kept): rows of both sides and which of their pairs this block makes; None where all."""
        step, at = max(1, CELLS // max(1, len(self.b))), 0
        blocks = len(self.block) and int(self.block.max()) > 0
        while at < len(self.a):
            a = self.a[at : at + step]
            # Rows are sorted by block and record, so that a row of one tile meets those from its own place on.
            b = self.b if self.apart else self.b[at:]
            at += len(a)
            kept = None if self.apart else self.rank[a][:, None] < self.rank[b][None, :]
            if blocks:
                kept &= self.block[a][:, None] == self.block[b][None, :]
            for columns in self.before.values():
                for x in columns:
                    for y in columns:
                        other = (x[a][:, None] != y[b][None, :]) | (x[a] < 0)[:, None]
                        kept = other if kept is None else kept & other
            yield a, b, kept


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[Unit]:
    """Units of rows sorted by (k, i, j); small blocks are taken together."""
    held, small, rows = [], [], 0
    now = None

    def ended():
        nonlocal held, small, rows
        table, held = pa.Table.from_batches(held), []
        if table.num_rows < SMALL and table["i"][0] == table["j"][0]:
            small.append(table)
            rows += table.num_rows
            if rows < SMALL:
                return
            table, small, rows = pa.concat_tables(small), [], 0
        if table.num_rows > 1:
            yield Unit(table)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [_coded(pa.chunked_array([batch.column("k")]))[0], *(batch.column(c).to_numpy() for c in "ij")]
        cuts = np.nonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))[0] + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            part = batch.slice(lo, hi - lo)
            key = tuple(part.column(c)[0].as_py() for c in "kij")
            if key != now and held:
                yield from ended()
            now = key
            held.append(part)
    if held:
        yield from ended()
    if small:
        table = pa.concat_tables(small)
        if table.num_rows > 1:
            yield Unit(table)


# Codes of pairs --------------------------------------------------------------------------------------------------


class Profiles:
    """Codes of agreement profiles, with fold and truth where rows have these."""

    def __init__(self, unit: Unit):
        self.coded = {x: _coded(unit.table.column(x)) for x in ATTRIBUTES}
        self.near = {}
        for x in ("email", "phone"):
            values = self.coded[x][1]
            own = np.arange(len(values))
            p, q = near(values) if x == "email" else (own[:0], own[:0])
            self.near[x] = np.concatenate([own, p]), np.concatenate([own, q])
        values = self.coded["birth_date"][1]
        self.dates = _dates(values)
        self.grams = incidence(self.coded["address"][1])
        self.fold = self.entity = None
        if "true_entity" in unit.table.column_names:
            self.fold = unit.table.column("fold").fill_null(0).to_numpy().astype(np.uint32)
            self.entity = _coded(unit.table.column("true_entity"))[0]

    def levels(self, x: str, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        values = self.coded[x][1]
        left, right = [values[k] for k in u], [values[k] for k in v]
        if x == "birth_date":
            return dates(left, right, *((self.dates[0][k], self.dates[1][k]) for k in (u, v)))
        if x == "address":
            out = dice(self.grams[0][u], self.grams[1][u], self.grams[0][v], self.grams[1][v])
            out[_runs(u, v)] = N_STRONG
            return out
        return (_POSTAL if x == "postal_code" else _NAMES).levels(left, right)

    def codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)), dtype=np.int32)
        for k, x in enumerate(ATTRIBUTES):
            code = self.coded[x][0]
            ca, cb = code[a], code[b]
            if x in self.near:
                p, q = self.near[x]
                base = np.array([[N_DISAGREE, N_MISSING], [N_MISSING, N_MISSING]], dtype=np.int32) << 2 * k
                na, nb = (ca < 0).astype(np.int64), (cb < 0).astype(np.int64)
                out += base[0, 0] if not na.any() and not nb.any() else base[na][:, nb]
                i, at = _runs(ca, p)
                r, j = _runs(q[at], cb)
                out[i[r], j] += (N_STRONG - N_DISAGREE) * (1 << 2 * k)
                continue
            (u, iu), (v, iv) = np.unique(ca, return_inverse=True), np.unique(cb, return_inverse=True)
            # A missing value is the first, as -1.
            mu, mv = int(u[0] < 0), int(v[0] < 0)
            table = np.full((len(u), len(v)), N_MISSING, dtype=np.int32)
            if len(u) > mu and len(v) > mv:
                table[mu:, mv:] = self.levels(x, u[mu:], v[mv:])
            table <<= 2 * k
            out += table[0, 0] if table.size == 1 else np.take(table if len(u) == len(a) and np.array_equal(iu, np.arange(len(a))) else table[iu], iv, axis=1)
        if self.fold is not None:
            fa, fb = self.fold[a], self.fold[b]
            out += ((fa[:, None] == fb[None, :]) * fa[:, None]).astype(np.int32) << FOLD
            ea, eb = self.entity[a], self.entity[b]
            known = np.nonzero(ea >= 0)[0]
            i, j = _runs(ea[known], eb)
            out[known[i], j] += 1 << TRUE
        return out


def counted(rows: DataFrame) -> DataFrame:
    """(lvl_<attribute>..., is_true, fold, n) of the pairs of dealt rows with true_entity and fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << TRUE + 1, dtype=np.int64)
        for unit in units(batches):
            of = Profiles(unit)
            for a, b, kept in unit.chunks():
                codes = of.codes(a, b)
                total += np.bincount(codes.ravel() if kept is None else codes[kept], minlength=len(total))
        found = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["code", "n"])

    sums = rows.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    truth = F.expr(f"(code >> {TRUE}) = 1").alias("is_true")
    return sums.select(*level_columns(), truth, F.expr(f"(code >> {FOLD}) & 3").cast("int").alias("fold"), "n")


def level_columns() -> list:
    """The levels that a column ``code`` stands for."""
    return [F.get(F.array(*map(F.lit, LEVELS)), F.expr(f"(code >> {2 * k}) & 3")).alias(f"lvl_{x}") for k, x in enumerate(ATTRIBUTES)]


def all_profiles(spark) -> DataFrame:
    """Each profile with its code."""
    return spark.range(PROFILES).select(F.col("id").cast("int").alias("code")).select("code", *level_columns())


def linked(rows: DataFrame, codes: list[int]) -> DataFrame:
    """(a, b) of the pairs of dealt rows whose profile is among the codes."""
    wanted = np.zeros(PROFILES, dtype=bool)
    wanted[codes] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            of = Profiles(unit)
            for a, b, kept in unit.chunks():
                found = wanted[of.codes(a, b)]
                i, j = np.nonzero(found if kept is None else found & kept)
                for at in range(0, len(i), CELLS):
                    p, q = a[i[at : at + CELLS]], b[j[at : at + CELLS]]
                    yield pa.RecordBatch.from_arrays([unit.ids.take(pa.array(p)), unit.ids.take(pa.array(q))], ["a", "b"])

    return rows.mapInArrow(run, "a string, b string")


def pairs(rows: DataFrame, of: Callable[[Unit], object], values: Callable[[np.ndarray, object], list[pa.Array]], schema: str) -> DataFrame:
    """(a, b, <schema>) of every pair of dealt rows.

    ``of(unit).codes(a, b)`` gives a matrix of codes and ``values`` the columns of distinct codes. A matrix is one
    row on its way to the JVM, which makes the pairs of it.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        for unit in units(batches):
            make = of(unit)
            for a, b, kept in unit.chunks():
                found = make.codes(a, b)
                there = np.zeros(int(found.max()) + 1, dtype=bool)
                there[found] = True
                codes = np.nonzero(there)[0]
                place = (np.cumsum(there, dtype=np.int32) - 1)[found]
                if kept is not None:
                    place[~kept] = NONE
                ids = [unit.ids.take(pa.array(x)) for x in (a, b)]
                columns = [*ids, pa.array(place.ravel(), pa.int32()), *values(codes, make)]
                yield pa.RecordBatch.from_arrays([listed(x) for x in columns], ["_a", "_b", "_codes", *(f"_{c}" for c in names)])

    wide = ", ".join(f"_{c.split()[0]} array<{c.split()[1]}>" for c in schema.split(", "))
    made = rows.mapInArrow(run, f"_a array<string>, _b array<string>, _codes array<int>, {wide}")
    made = made.select("*", F.posexplode("_codes").alias("_at", "_code")).where(f"_code <> {NONE}")
    side = [F.expr("get(_a, cast(_at div size(_b) AS int))").alias("a"), F.expr("get(_b, _at % size(_b))").alias("b")]
    return made.select(*side, *(F.expr(f"get(_{c}, _code)").alias(c) for c in names))


def decided(rows: DataFrame, decisions: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(a, b, columns...) of every pair: ``decisions`` has them, named with their types, for all_profiles()."""
    table = decisions.select("code", *(F.col(c).cast(t).alias(c) for c, t in columns.items())).orderBy("code").toArrow().combine_chunks()
    own = [table.column(c).combine_chunks() for c in columns]

    def values(codes: np.ndarray, of) -> list[pa.Array]:
        return [c.take(pa.array(codes)) for c in own]

    return pairs(rows, Profiles, values, ", ".join(f"{c} {t}" for c, t in columns.items()))


# Rules and words -------------------------------------------------------------------------------------------------


class Passes:
    """Codes of which passes give both records the same key: one bit for each pass column."""

    def __init__(self, unit: Unit, passes: tuple[str, ...]):
        self.coded = [_coded(unit.table.column(f"key_{p}"))[0].astype(np.int32) for p in passes]

    def codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)), dtype=np.int32)
        for k, code in enumerate(self.coded):
            known = code[a] >= 0
            if known.any():
                out |= ((code[a][:, None] == code[b][None, :]) & known[:, None]).astype(np.int32) << k
        return out


def ruled(rows: DataFrame, passes: tuple[str, ...]) -> DataFrame:
    """(a, b, rules) of every pair of dealt rows with columns key_<pass>: the passes that propose it, in order of name."""

    def values(codes: np.ndarray, of) -> list[pa.Array]:
        return [pa.array([",".join(sorted(p for k, p in enumerate(passes) if c >> k & 1)) for c in codes.tolist()], pa.string())]

    return pairs(rows, lambda unit: Passes(unit, passes), values, "rules string")


class Words:
    """Codes of common and all words of two records: common << bits, plus all."""

    def __init__(self, unit: Unit):
        lists = unit.table.column("words").combine_chunks()
        self.sizes = lists.value_lengths().to_numpy().astype(np.int64)
        self.bits = int(2 * self.sizes.max()).bit_length()
        flat, values = _coded(pa.chunked_array([lists.flatten()]))
        of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        n = np.bincount(flat, minlength=len(values))
        # Frequent words by a matrix product; of the others, which few records have, the pairs that share one.
        often = n * 24 >= unit.table.num_rows
        column = np.cumsum(often) - 1
        self.often = np.zeros((len(self.sizes), max(1, int(often.sum()))), dtype=np.float32)
        some = often[flat]
        self.often[of[some], column[flat[some]]] = 1
        rare = ~some & (n[flat] > 1)
        self.rare_of, self.rare = of[rare], flat[rare]

    def codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = (self.often[a] @ self.often[b].T).astype(np.int32)
        at = np.full(len(self.sizes), -1)
        at[a] = np.arange(len(a))
        to = np.full(len(self.sizes), -1)
        to[b] = np.arange(len(b))
        left, right = at[self.rare_of] >= 0, to[self.rare_of] >= 0
        i, j = _runs(self.rare[left], self.rare[right])
        cells = at[self.rare_of[left]][i] * len(b) + to[self.rare_of[right]][j]
        common += np.bincount(cells, minlength=common.size).reshape(common.shape).astype(np.int32)
        union = self.sizes[a][:, None] + self.sizes[b][None, :] - common
        return (common << self.bits) + union.astype(np.int32)


def jaccard(rows: DataFrame, cut: float) -> DataFrame:
    """(a, b, match_weight, verdict) of every pair of dealt rows with distinct words."""

    def values(codes: np.ndarray, of) -> list[pa.Array]:
        all_ = (1 << of.bits) - 1
        share = [Decimal(repr((c >> of.bits) / (c & all_))) if c & all_ else Decimal(0) for c in codes.tolist()]
        s = [float(x.quantize(Decimal("1e-9"), ROUND_HALF_UP)) for x in share]
        return [pa.array(s, pa.float64()), pa.array(["MATCH" if x >= cut else "NON_MATCH" for x in s], pa.string())]

    return pairs(rows, Words, values, "match_weight double, verdict string")


assert LEVELS[N_MISSING] == MISSING
