"""Names and constants of the entity-resolution engine."""

from __future__ import annotations

ID, SOURCE = "record_id", "source_id"
ATTRIBUTES = ("last_name", "first_name", "birth_date", "address", "postal_code", "city", "email", "phone")
RECORD = (ID, SOURCE, *ATTRIBUTES)

STRONG, PARTIAL, DISAGREE, MISSING = "STRONG", "PARTIAL", "DISAGREE", "MISSING"
LEVELS = (STRONG, PARTIAL, DISAGREE, MISSING)
MATCH, NON_MATCH, GREY = "MATCH", "NON_MATCH", "GREY"
PENDING, REVIEWED, NOT_REVIEWED = "PENDING", "REVIEWED", "NOT_REVIEWED"
MATCH_AFTER, NON_MATCH_AFTER, ABSTAIN = "MATCH_AFTER_REVIEW", "NON_MATCH_AFTER_REVIEW", "ABSTAIN"
MAJORITY, COMPLETENESS, SOURCE_PRIORITY, CANONICAL = "MAJORITY", "COMPLETENESS", "SOURCE_PRIORITY", "CANONICAL"
POLICY = (MAJORITY, COMPLETENESS, SOURCE_PRIORITY, CANONICAL)

# Defaults that results depend on.
STRONG_FROM, PARTIAL_FROM = 0.90, 0.70
T_UPPER, T_LOWER = 8.0, -8.0
PREFIX_LENGTH = 4
EM_ITERATIONS, EM_TOLERANCE, EM_DIRICHLET, EM_LEAST_PAIRS, EM_JITTER, EM_PRIOR = 200, 1e-9, 0.5, 4, 0.05, 0.10
PRIOR_M = {STRONG: 0.85, PARTIAL: 0.10, DISAGREE: 0.05}
PRIOR_U = {STRONG: 0.05, PARTIAL: 0.15, DISAGREE: 0.80}
REVIEW_BUDGET, FRONTIER = 300, 0.0
