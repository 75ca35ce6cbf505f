"""The whole chain: normalise, block, compare, weigh, decide, review, close, fuse."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import blocking, closure, compare, decide, fusion, review, sizing
from ..schema import ATTRIBUTES, FRONTIER, ID, LEVELS, PARTIAL_FROM, POLICY, PREFIX_LENGTH, RECORD, REVIEW_BUDGET, STRONG_FROM, T_LOWER, T_UPPER
from ..scratch import saved


@dataclass(frozen=True)
class Parameters:
    passes: tuple[str, ...] = blocking.DEFAULT_PASSES
    prefix_length: int = PREFIX_LENGTH
    largest_block: int | None = None
    strong: float = STRONG_FROM
    partial: float = PARTIAL_FROM
    t_upper: float = T_UPPER
    t_lower: float = T_LOWER
    seed: str = "confluo"

    def __post_init__(self):
        if not 0 <= self.partial <= self.strong <= 1 or self.t_lower > self.t_upper:
            raise ValueError("inconsistent cutoffs or thresholds")


@dataclass(frozen=True)
class OperatingPoint:
    t_upper: float
    t_lower: float
    name: str
    derived: bool
    provenance: dict = field(default_factory=dict)


@dataclass
class Run:
    normalized: DataFrame
    levels: DataFrame
    estimate: decide.Estimate
    decisions: DataFrame
    #: Levels by profile with their number n, which suffice to size thresholds.
    counted: DataFrame


def check_ids(records: DataFrame) -> None:
    """Raises on missing or repeated record ids."""
    bad = records.groupBy(ID).agg(F.count("*").alias("n")).where(f"n > 1 OR {ID} IS NULL OR {ID} = ''")
    if bad.take(1):
        raise ValueError("record ids are missing or repeated")


def levels_of(records: DataFrame, p: Parameters = Parameters()) -> tuple[DataFrame, DataFrame]:
    """Normalised records and the comparison levels of their candidate pairs."""
    normalized = normalize(records)
    pairs = blocking.candidate_pairs(blocking.block_keys(normalized, p.passes), p.largest_block, compare.prepared(normalized))
    return normalized, compare.levels(compare.similarities_of(pairs), p.strong, p.partial)


def engine(records: DataFrame, p: Parameters = Parameters(), compared: tuple[DataFrame, DataFrame] | None = None, counted: DataFrame | None = None) -> Run:
    """Records to decisions. Profiles are written once, as the estimate and the thresholds both read them; pairs are not.

    ``compared`` has the normalised records and the levels, and ``counted`` their profiles, where a run over the same
    records has made them.
    """
    check_ids(records)
    if compared is None:
        compared = levels_of(records, p)
    normalized, levels = compared
    if counted is None:
        counted, _ = saved(decide.profiles(levels), "profiles")
    e = decide.fit(counted, p.seed)
    return Run(normalized, levels, e, decide.decisions(levels, e.weights(), p.t_upper, p.t_lower), counted)


def population_fingerprint(normalized: DataFrame) -> str:
    """Of all normalised rows in any order: sums of their sha256 by 32-bit parts, hashed."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c), F.lit("\x00")) for c in RECORD)), 256)
    parts = normalized.select(*(F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)").alias(f"p{k}") for k in range(8)))
    sums = parts.agg(F.count("*"), *(F.sum(f"p{k}").cast("string") for k in range(8))).first()
    return hashlib.sha256("|".join(map(str, sums)).encode()).hexdigest()


def weights_fingerprint(w: decide.Table) -> str:
    return hashlib.sha256(json.dumps({a: {lv: round(w[a][lv], 9) for lv in LEVELS} for a in ATTRIBUTES}, sort_keys=True).encode()).hexdigest()


def derived_point(run: Run, budget: int = REVIEW_BUDGET, frontier: float = FRONTIER) -> OperatingPoint:
    """Thresholds sized on a run's own decisions, with what they hold for."""
    t = sizing.thresholds(decide.decisions(run.counted, run.estimate.weights()), budget, frontier)
    return OperatingPoint(t.upper, t.lower, "sized", True, {"population": population_fingerprint(run.normalized), "weights": weights_fingerprint(run.estimate.weights()), "budget": budget, "reached": t.n_pairs})


def check_provenance(point: OperatingPoint, run: Run) -> None:
    """Refuses a derived point for other records or weights."""
    if point.derived and (point.provenance.get("population") != population_fingerprint(run.normalized) or point.provenance.get("weights") != weights_fingerprint(run.estimate.weights())):
        raise ValueError("the operating point was derived for other records or weights")


@dataclass
class Chain:
    run: Run
    decisions: DataFrame
    parts: DataFrame
    golden: DataFrame
    report: dict


def chain(records: DataFrame, point: OperatingPoint | None = None, answers: DataFrame | None = None, budget: int | None = None, policy: tuple[str, ...] = POLICY, priority: tuple[str, ...] = (), p: Parameters = Parameters(), run: Run | None = None) -> Chain:
    """Records to golden records; without a point it is sized on the records themselves."""
    run = run or engine(records, p)
    if point is None:
        point = derived_point(run)
    else:
        check_provenance(point, run)
    decided = decide.decisions(run.levels, run.estimate.weights(), point.t_upper, point.t_lower)
    grey = decided.where("verdict = 'GREY'").select("a", "b")
    decided = review.reviewed(decided, review.payload(grey, run.normalized), answers, budget)
    # Of all decisions only the links are written.
    matched, _ = saved(review.match_set(decided).select("a", "b"), "matches")
    closure.check_pairs(matched)
    links = closure.edges(matched)
    parts, _ = saved(closure.entities(links, records), "entities")
    winners = fusion.arbitrated(fusion.ballots(records, parts, priority), policy)
    golden = fusion.golden_records(records, parts, winners)
    report = {"point": asdict(point), "em": {"iterations": run.estimate.iterations, "converged": run.estimate.converged, "fallback": run.estimate.fallback, "p": run.estimate.p}}
    return Chain(run, decided, parts, golden, report)


def content_fingerprint(rows: DataFrame) -> str:
    """Order-free fingerprint of a result's rows."""
    h = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    parts = h.agg(F.count("*"), *(F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(8))).first()
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()
