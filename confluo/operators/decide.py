"""Fellegi-Sunter weights by EM over agreement profiles, and three-zone decisions."""

from __future__ import annotations

import hashlib
import math
import random
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import (
    ATTRIBUTES, DISAGREE, EM_DIRICHLET, EM_ITERATIONS, EM_JITTER, EM_LEAST_PAIRS, EM_PRIOR, EM_TOLERANCE, GREY, LEVELS, MATCH, MISSING, NON_MATCH, PARTIAL, PENDING, PRIOR_M, PRIOR_U, STRONG, T_LOWER, T_UPPER,
)

SEEN = (STRONG, PARTIAL, DISAGREE)
Table = dict[str, dict[str, float]]


def profiles(levels: DataFrame) -> DataFrame:
    """Counts of agreement profiles: at most 4 ** 8 rows, whatever the number of pairs. Rows counted before have n."""
    n = F.sum("n") if "n" in levels.columns else F.count("*")
    return levels.groupBy(*(f"lvl_{a}" for a in ATTRIBUTES)).agg(n.alias("n"))


def seed_of(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest(), 16) % 2**32


@dataclass
class Estimate:
    m: Table
    u: Table
    p: float
    iterations: int = 0
    converged: bool = False
    fallback: str | None = None
    unseen: list[str] = field(default_factory=list)

    def weights(self) -> Table:
        """log2(m / u) by attribute and level; a missing value weighs nothing."""
        return {a: {lv: math.log2(self.m[a][lv] / self.u[a][lv]) for lv in SEEN} | {MISSING: 0.0} for a in ATTRIBUTES}


def priors(seed: str | None = None) -> Estimate:
    """The priors, each jittered by a seeded draw where a seed is given."""
    rng = random.Random(seed_of(seed)) if seed is not None else None

    def table(prior: dict[str, float]) -> Table:
        out = {}
        for a in ATTRIBUTES:
            raw = {lv: prior[lv] * (1 + (rng.uniform(-EM_JITTER, EM_JITTER) if rng else 0)) for lv in SEEN}
            total = math.fsum(raw.values())
            out[a] = {lv: v / total for lv, v in raw.items()}
        return out

    return Estimate(table(PRIOR_M), table(PRIOR_U), EM_PRIOR)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def estimate(counts: list[tuple[tuple[str, ...], int]], seed: str = "confluo", iterations: int = EM_ITERATIONS, tolerance: float = EM_TOLERANCE) -> Estimate:
    """Two latent classes over profiles. The likelihood depends on profiles alone, so this equals EM over pairs.

    Falls back to the plain priors, with the reason, for too few pairs, without convergence and for a degenerate share;
    an attribute that no pair informs on has the priors too. Sums are exact and sorted, so the result does not depend on
    partitioning.
    """
    counts = sorted(counts)
    total = sum(n for _, n in counts)
    now = priors(seed)

    def fallen(reason: str, steps: int = 0) -> Estimate:
        out = priors()
        out.fallback, out.iterations, out.unseen = reason, steps, unseen
        return out

    unseen: list[str] = []
    if total < EM_LEAST_PAIRS:
        return fallen("too few pairs")
    unseen = [a for k, a in enumerate(ATTRIBUTES) if all(lv[k] == MISSING for lv, _ in counts)]
    for step in range(1, iterations + 1):
        odds = math.log(now.p) - math.log(1 - now.p)
        gamma = []
        for levels, _ in counts:
            terms = [math.log(now.m[a][lv]) - math.log(now.u[a][lv]) for a, lv in zip(ATTRIBUTES, levels, strict=True) if lv != MISSING]
            gamma.append(_sigmoid(math.fsum([odds, *terms])))
        p = min(1 - 1e-9, max(1e-9, math.fsum(g * n for g, (_, n) in zip(gamma, counts, strict=True)) / total))
        m, u = {}, {}
        for k, a in enumerate(ATTRIBUTES):
            if a in unseen:
                m[a], u[a] = dict(PRIOR_M), dict(PRIOR_U)
                continue
            for out, w in ((m, gamma), (u, [1 - g for g in gamma])):
                mass = {lv: math.fsum(g * n for g, (lvs, n) in zip(w, counts, strict=True) if lvs[k] == lv) + EM_DIRICHLET for lv in SEEN}
                whole = math.fsum(mass.values())
                out[a] = {lv: v / whole for lv, v in mass.items()}
        change = max([abs(p - now.p), *(abs(new[a][lv] - old[a][lv]) for new, old in ((m, now.m), (u, now.u)) for a in ATTRIBUTES for lv in SEEN)])
        now = Estimate(m, u, p, step, change < tolerance, None, unseen)
        if now.converged:
            break
    if not now.converged:
        return fallen("not converged", now.iterations)
    now = oriented(now)
    if now.p <= 2e-9 or now.p >= 1 - 2e-9:
        return fallen("degenerate share", now.iterations)
    return now


def oriented(e: Estimate) -> Estimate:
    """Class m is the one with more strong agreement."""
    if math.fsum(e.u[a][STRONG] for a in ATTRIBUTES) > math.fsum(e.m[a][STRONG] for a in ATTRIBUTES):
        e.m, e.u, e.p = e.u, e.m, 1 - e.p
    return e


def fit(levels: DataFrame, seed: str = "confluo") -> Estimate:
    """EM on the driver over the collected profiles, of which there are at most 65,536."""
    rows = profiles(levels).collect()
    return estimate([(tuple(r[f"lvl_{a}"] for a in ATTRIBUTES), r["n"]) for r in rows], seed)


def weight_table(spark: SparkSession, w: Table) -> DataFrame:
    return spark.createDataFrame([(a, lv, round(w[a][lv], 9)) for a in ATTRIBUTES for lv in LEVELS], "attribute string, level string, weight double")


def weight(attribute: str, w: Table) -> Column:
    """The weight of an attribute's level as a literal map lookup."""
    return F.element_at(F.create_map(*[F.lit(x) for lv in LEVELS for x in (lv, w[attribute][lv])]), F.col(f"lvl_{attribute}"))


def verdict(r: Column, upper: float, lower: float) -> Column:
    """Strictly above the upper threshold matches, strictly below the lower does not; both ends are grey."""
    return F.when(r > upper, MATCH).when(r < lower, NON_MATCH).otherwise(GREY)


def decisions(levels: DataFrame, w: Table, upper: float = T_UPPER, lower: float = T_LOWER) -> DataFrame:
    """One decision per pair: match_weight (bits), n_informative, verdict, guarded (no informative attribute), review."""
    if lower > upper:
        raise ValueError("t_lower is above t_upper")
    total = None
    for a in ATTRIBUTES:
        total = weight(a, w) if total is None else total + weight(a, w)
    informative = sum((F.col(f"lvl_{a}") != MISSING).cast("int") for a in ATTRIBUTES)
    out = levels.withColumn("match_weight", F.round(total, 9)).withColumn("n_informative", informative)
    for a in ATTRIBUTES:
        out = out.withColumn(f"w_{a}", weight(a, w))
    out = out.withColumn("guarded", F.col("n_informative") == 0)
    out = out.withColumn("verdict", F.when(F.col("guarded"), NON_MATCH).otherwise(verdict(F.col("match_weight"), upper, lower)))
    return out.withColumn("review", F.when(F.col("verdict") == GREY, PENDING))


def histogram(decided: DataFrame) -> DataFrame:
    return decided.groupBy("verdict").agg(F.count("*").alias("n"))
