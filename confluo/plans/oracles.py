"""The same queries as DuckDB SQL, built from shared table expressions."""

from __future__ import annotations

from ..functions.text import LEGAL_FORMS, STREET
from ..schema import ATTRIBUTES
from ..sources.records import view_sql

_A = ATTRIBUTES


def _plain(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower(strip_accents({x})), '[^0-9a-z]+', ' ', 'g')), '')"


def _expanded(x: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"array_to_string(list_transform(string_split({_plain(x)}, ' '), lambda w: CASE w {cases} ELSE w END), ' ')"


# Runs of single letters become one word: a space goes where the words on both sides have one letter.
def _initials(x: str) -> str:
    w = f"string_split({x}, ' ')"
    single = lambda i: f"({i} >= 1 AND {i} <= len({w}) AND regexp_matches({w}[{i}], '^[a-z]$'))"
    return f"CASE WHEN {x} IS NOT NULL THEN array_to_string(list_transform(range(1, len({w}) + 1), lambda i: concat(CASE WHEN i = 1 OR ({single('i - 1')} AND {single('i')}) THEN '' ELSE ' ' END, {w}[i])), '') END"


_forms = ", ".join(f"'{x}'" for x in LEGAL_FORMS)
_last = f"array_to_string(CASE WHEN len(list_filter(string_split(ini, ' '), lambda w: w NOT IN ({_forms}))) = 0 THEN string_split(ini, ' ') ELSE list_filter(string_split(ini, ' '), lambda w: w NOT IN ({_forms})) END, ' ')"
_digits = lambda x: f"nullif(regexp_replace({x}, '[^0-9]', '', 'g'), '')"
_y = "^(\\d{4})[^0-9](\\d{1,2})[^0-9](\\d{1,2})$"
_c = "^(\\d{4})(\\d{2})(\\d{2})$"
_d = "^(\\d{1,2})[^0-9](\\d{1,2})[^0-9](\\d{4})$"


def _iso(p: str, y: int, m: int, d: int) -> str:
    g = lambda k: f"regexp_extract(trim(birth_date), '{p}', {k})"
    return f"WHEN regexp_matches(trim(birth_date), '{p}') THEN concat_ws('-', {g(y)}, lpad({g(m)}, 2, '0'), lpad({g(d)}, 2, '0'))"


_hex = "list_reduce(list_prepend(0::bigint, list_transform(range(0, 8), lambda i: cast(concat('0x', substr(sha256(concat('confluo::', true_entity)), i * 8 + 1, 8)) AS bigint))), lambda acc, x: (acc * 7296 + x) % 10000)"
_fold = f"CASE WHEN {_hex} < 5000 THEN 1 ELSE 2 END"

_CTES = {
    "rec": view_sql(),
    "norm": f"""SELECT record_id, source_id, {_last} AS last_name, {_plain('first_name')} AS first_name,
        CASE {_iso(_y, 1, 2, 3)} {_iso(_c, 1, 2, 3)} {_iso(_d, 3, 2, 1)} ELSE {_plain('birth_date')} END AS birth_date,
        {_expanded('address', STREET)} AS address, {_digits('postal_code')} AS postal_code, {_expanded('city', {k: STREET[k] for k in ('st', 'ste')})} AS city,
        nullif(lower(regexp_replace(email, '\\s+', '', 'g')), '') AS email,
        CASE WHEN {_digits('phone')} LIKE '0033%' AND length({_digits('phone')}) = 13 THEN concat('0', substr({_digits('phone')}, 5, 9)) WHEN {_digits('phone')} LIKE '33%' AND length({_digits('phone')}) = 11 THEN concat('0', substr({_digits('phone')}, 3, 9)) ELSE {_digits('phone')} END AS phone FROM (SELECT *, {_initials(_plain('last_name'))} AS ini FROM rec) rec""",
    "keys": """SELECT * FROM (SELECT record_id, 'CP' AS pass, postal_code AS key FROM norm UNION ALL
        SELECT record_id, 'PREF', CASE WHEN last_name IS NOT NULL THEN substr(concat(replace(last_name, ' ', ''), coalesce(replace(first_name, ' ', ''), '')), 1, 4) END FROM norm) q WHERE key IS NOT NULL AND key <> ''""",
    "blocks": "SELECT pass, key, count(*) AS n FROM keys GROUP BY ALL HAVING count(*) >= 2",
    "pairs": """SELECT x.record_id AS a, y.record_id AS b, list_sort(list(DISTINCT concat(x.pass, ':', x.key))) AS block_origin
        FROM keys x JOIN keys y ON x.pass = y.pass AND x.key = y.key AND x.record_id < y.record_id GROUP BY ALL""",
    "vals": "SELECT p.a, p.b, p.block_origin, " + ", ".join(f"x.{c} AS {c}_a, y.{c} AS {c}_b" for c in _A) + " FROM pairs p JOIN norm x ON p.a = x.record_id JOIN norm y ON p.b = y.record_id",
}
_both = lambda c, e: f"CASE WHEN {c}_a IS NOT NULL AND {c}_b IS NOT NULL THEN round(least(1.0, greatest(0.0, cast({e} AS double))), 6) END AS sim_{c}"
_JW = ("last_name", "first_name", "city", "birth_date")
_jw = lambda c: f"jw_{c}"
_grams = lambda x: f"CASE WHEN length({x}) < 2 THEN [{x}] ELSE list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)) END"
_tagged = lambda x: f"list_transform(range(1, len({x}) + 1), lambda i: concat({x}[i], '#', len(list_filter({x}[1:i - 1], lambda o: o = {x}[i]))))"
_CTES |= {
    "gr": f"SELECT *, {_grams('address_a')} AS ga, {_grams('address_b')} AS gb FROM vals",
    "gt": f"SELECT *, {_tagged('ga')} AS ta, {_tagged('gb')} AS tb FROM gr",
    # The built-in similarity halves an odd number of moved characters down; this one does not.
    "jp": "SELECT DISTINCT x, y, greatest(0, greatest(length(x), length(y)) // 2 - 1) AS r FROM (" + " UNION ALL ".join(f"SELECT {c}_a AS x, {c}_b AS y FROM vals" for c in _JW) + ") q WHERE x IS NOT NULL AND y IS NOT NULL",
    "jm": """SELECT x, y, list_transform(list_filter(string_split(list_reduce(list_prepend('', list_transform(range(1, length(x) + 1), lambda i: cast(i AS varchar))),
        lambda acc, i: concat(acc, coalesce(concat(',', nullif(cast(list_filter(range(greatest(1, cast(i AS int) - r), least(length(y), cast(i AS int) + r) + 1), lambda j: substr(y, j, 1) = substr(x, cast(i AS int), 1) AND NOT contains(concat(acc, ','), concat(',', cast(j AS varchar), ',')))[1] AS varchar), '')), ''))), ','), lambda s: s <> ''), lambda s: cast(s AS int)) AS ms FROM jp""",
    "jj": """SELECT x, y, CASE WHEN x = y THEN 1.0::double WHEN len(ms) = 0 THEN 0.0::double ELSE (len(ms) / length(x) + len(ms) / length(y) + (len(ms) - len(list_filter(range(1, len(ms) + 1), lambda k: substr(y, ms[k], 1) <> substr(y, list_sort(ms)[k], 1))) / 2) / len(ms)) / 3 END AS j,
        len(list_filter(range(1, least(4, length(x), length(y)) + 1), lambda k: left(x, k) = left(y, k))) AS p FROM jm""",
    "jw": "SELECT x, y, CASE WHEN j > 0.7 THEN j + p * 0.1::double * (1 - j) ELSE j END AS s FROM jj",
    "gj": "SELECT gt.*, " + ", ".join(f"q_{c}.s AS jw_{c}" for c in _JW) + " FROM gt " + " ".join(f"LEFT JOIN jw q_{c} ON q_{c}.x = {c}_a AND q_{c}.y = {c}_b" for c in _JW),
    "sims": "SELECT a, b, block_origin, "
    + ", ".join(
        [
            _both("last_name", _jw("last_name")),
            _both("first_name", _jw("first_name")),
            _both(
                "birth_date",
                f"""CASE WHEN NOT regexp_matches(birth_date_a, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') OR NOT regexp_matches(birth_date_b, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {_jw('birth_date')}
            WHEN substr(birth_date_a, 9, 2) = substr(birth_date_b, 6, 2) AND substr(birth_date_a, 6, 2) = substr(birth_date_b, 9, 2) AND left(birth_date_a, 4) = left(birth_date_b, 4) AND substr(birth_date_a, 9, 2) <> substr(birth_date_a, 6, 2) THEN 0.75
            ELSE [0.0, 0.4, 0.75, 1.0][1 + cast(left(birth_date_a, 4) = left(birth_date_b, 4) AS int) + cast(substr(birth_date_a, 6, 2) = substr(birth_date_b, 6, 2) AS int) + cast(substr(birth_date_a, 9, 2) = substr(birth_date_b, 9, 2) AS int)] END""",
            ),
            _both("address", "CASE WHEN address_a = address_b THEN 1.0 ELSE 2.0 * len(list_intersect(ta, tb)) / (len(ta) + len(tb)) END"),
            _both("postal_code", "len(list_filter(range(1, least(length(postal_code_a), length(postal_code_b)) + 1), lambda k: left(postal_code_a, k) = left(postal_code_b, k))) / greatest(length(postal_code_a), length(postal_code_b))"),
            _both("city", _jw("city")),
            _both("email", "CASE WHEN email_a = email_b THEN 1.0 WHEN levenshtein(email_a, email_b) <= 1 THEN 0.9 ELSE 0.0 END"),
            _both("phone", "CASE WHEN phone_a = phone_b THEN 1.0 ELSE 0.0 END"),
        ]
    )
    + " FROM gj",
    "lvls": "SELECT *, " + ", ".join(f"CASE WHEN sim_{c} IS NULL THEN 'MISSING' WHEN sim_{c} >= 0.9 THEN 'STRONG' WHEN sim_{c} >= 0.7 THEN 'PARTIAL' ELSE 'DISAGREE' END AS lvl_{c}" for c in _A) + " FROM sims",
    "wts": "SELECT *, " + ", ".join(f"CASE lvl_{c} WHEN 'STRONG' THEN log2(0.85::double / 0.05::double) WHEN 'PARTIAL' THEN log2(0.10::double / 0.15::double) WHEN 'DISAGREE' THEN log2(0.05::double / 0.80::double) ELSE 0.0::double END AS w_{c}" for c in _A) + " FROM lvls",
    "wsum": "SELECT *, round(" + " + ".join(f"w_{c}" for c in _A) + ", 9) AS match_weight, cast(" + " + ".join(f"cast(lvl_{c} <> 'MISSING' AS int)" for c in _A) + " AS bigint) AS n_informative FROM wts",
    "dec": "SELECT *, n_informative = 0 AS guarded, CASE WHEN n_informative = 0 THEN 'NON_MATCH' WHEN match_weight > 8 THEN 'MATCH' WHEN match_weight < -8 THEN 'NON_MATCH' ELSE 'GREY' END AS verdict FROM wsum",
    "tp": "SELECT x.record_id AS a, y.record_id AS b FROM rec x JOIN rec y ON x.true_entity = y.true_entity AND x.record_id < y.record_id",
    "rws": "SELECT d.*, t.a IS NOT NULL AS is_true FROM dec d LEFT JOIN tp t ON d.a = t.a AND d.b = t.b",
    "cel": """SELECT coalesce(sum(cast(verdict = 'MATCH' AND is_true AS bigint)), 0) AS mv, coalesce(sum(cast(verdict = 'MATCH' AND NOT is_true AS bigint)), 0) AS mf, coalesce(sum(cast(verdict = 'GREY' AND is_true AS bigint)), 0) AS gv,
        coalesce(sum(cast(verdict = 'GREY' AND NOT is_true AS bigint)), 0) AS gf, coalesce(sum(cast(verdict = 'NON_MATCH' AND is_true AS bigint)), 0) AS nv, coalesce(sum(cast(verdict = 'NON_MATCH' AND NOT is_true AS bigint)), 0) AS nf,
        (SELECT count(*) FROM tp t WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.a = t.a AND p.b = t.b)) AS lost FROM rws""",
    "bw": "SELECT match_weight, sum(cast(is_true AS bigint)) AS nv, sum(cast(NOT is_true AS bigint)) AS nf FROM rws GROUP BY 1",
    "fth": f"""SELECT round((match_weight + nxt) / 2, 9) AS threshold FROM (SELECT match_weight, nxt, tv - cv AS tp, tf - cf AS fp, cv AS fn FROM
        (SELECT match_weight, lead(match_weight) OVER (ORDER BY match_weight) AS nxt, sum(nv) OVER (ORDER BY match_weight) AS cv, sum(nf) OVER (ORDER BY match_weight) AS cf, sum(nv) OVER () AS tv, sum(nf) OVER () AS tf FROM
        (SELECT match_weight, sum(cast(is_true AS int)) AS nv, sum(cast(NOT is_true AS int)) AS nf FROM rws r JOIN (SELECT record_id, {_fold} AS fold FROM rec) x ON r.a = x.record_id JOIN (SELECT record_id, {_fold} AS fold FROM rec) y ON r.b = y.record_id WHERE x.fold = 1 AND y.fold = 1 GROUP BY 1) b) q WHERE nxt IS NOT NULL) z
        ORDER BY round(cast(2 * tp AS double) / nullif(2 * tp + fp + fn, 0), 9) DESC NULLS LAST, 1 LIMIT 1""",
    "lnk": "SELECT a, b FROM dec WHERE verdict = 'MATCH'",
    "sym": "SELECT a AS x, b AS y FROM lnk UNION SELECT b, a FROM lnk",
    "reach": "SELECT record_id AS x, record_id AS y FROM rec UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x",
    "ent": "SELECT x AS record_id, min(y) AS entity_id FROM reach GROUP BY x",
    "long": " UNION ALL ".join(f"SELECT e.entity_id, r.record_id, r.source_id, '{c}' AS attribute, r.{c} AS raw, n.{c} AS norm FROM rec r JOIN norm n USING (record_id) JOIN ent e USING (record_id) WHERE n.{c} IS NOT NULL" for c in _A),
    "spl": "SELECT entity_id, attribute, norm, raw, count(*) AS n, min(record_id) AS least FROM long GROUP BY ALL",
    "frm": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute, norm ORDER BY n DESC, least, raw) AS rn FROM spl) q WHERE rn = 1",
    "bal": """SELECT l.entity_id, l.attribute, l.norm, count(*) AS n_records, count(DISTINCT l.source_id) AS n_sources, min(CASE l.source_id WHEN 'SRC_A' THEN 0 WHEN 'SRC_B' THEN 1 WHEN 'SRC_C' THEN 2 ELSE 3 END)::bigint AS best_rank,
        length(l.norm)::bigint AS norm_length, any_value(f.raw) AS raw_form, any_value(f.least) AS origin FROM long l JOIN frm f ON l.entity_id = f.entity_id AND l.attribute = f.attribute AND l.norm = f.norm GROUP BY l.entity_id, l.attribute, l.norm""",
    "win": """SELECT *, count(*) OVER (PARTITION BY entity_id, attribute) AS n_values, count(*) OVER (PARTITION BY entity_id, attribute, n_sources) AS l1, count(*) OVER (PARTITION BY entity_id, attribute, n_sources, norm_length) AS l2,
        count(*) OVER (PARTITION BY entity_id, attribute, n_sources, norm_length, best_rank) AS l3, row_number() OVER (PARTITION BY entity_id, attribute ORDER BY n_sources DESC, norm_length DESC, best_rank, norm) AS rn,
        list_sort(list(n_sources) OVER (PARTITION BY entity_id, attribute ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 'DESC') AS ns FROM bal""",
}
_ORDER = list(_CTES)


def _needs(sql: str, seen: set[str]) -> None:
    import re

    for name in _ORDER:
        if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            seen.add(name)
            _needs(_CTES[name], seen)


def _q(sql: str) -> str:
    """The query with the table expressions that it needs, in order; derived ones are computed once."""
    seen: set[str] = set()
    _needs(sql, seen)
    parts = [f"{n} AS {'' if n == 'reach' else 'MATERIALIZED '}({_CTES[n]})" for n in _ORDER if n in seen]
    return f"WITH {'RECURSIVE ' if 'reach' in seen else ''}{', '.join(parts)} {sql}" if parts else sql


_run = "OVER (ORDER BY match_weight ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_down = "OVER (ORDER BY match_weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_swp = f"""(SELECT (match_weight + nxt) / 2 AS threshold, cast(tv - cv AS bigint) AS tp, cast(tf - cf AS bigint) AS fp, cast(cv AS bigint) AS fn FROM
    (SELECT match_weight, lead(match_weight) OVER (ORDER BY match_weight) AS nxt, sum(nv) {_run} AS cv, sum(nf) {_run} AS cf, sum(nv) OVER () AS tv, sum(nf) OVER () AS tf FROM bw) q WHERE nxt IS NOT NULL)"""
_CONV = """(SELECT 'strict' AS convention, mv AS tp, mf AS fp, gv + nv + lost AS fn FROM cel UNION ALL SELECT 'acceptance', mv + gv, mf + gf, nv + lost FROM cel
    UNION ALL SELECT 'optimistic', mv + gv, mf, nv + lost FROM cel UNION ALL SELECT 'pessimistic', mv, mf + gf, gv + nv + lost FROM cel)"""


def _ratio(x: str, y: str, digits: int = 9) -> str:
    return f"round(cast({x} AS double) / nullif({y}, 0), {digits})"


def _wilson(k: str, n: str, s: str) -> str:
    p = f"(cast({k} AS double) / ({n}))"
    return f"CASE WHEN {n} > 0 THEN round(({p} + 1.96*1.96 / (2 * ({n})) {s} 1.96 * sqrt({p} * (1 - {p}) / ({n}) + 1.96*1.96 / (4.0 * ({n}) * ({n})))) / (1 + 1.96*1.96 / ({n})), 9) END"


_same = lambda c: f"coalesce({c}_a = {c}_b, false)"
_triple = f"({_same('last_name')} AND {_same('first_name')} AND {_same('birth_date')})"
_strong = f"({_same('email')} OR {_same('phone')} OR {_triple})"
_words = lambda s: "list_distinct(list_filter(string_split(concat_ws(' ', " + ", ".join(f"{c}_{s}" for c in _A) + "), ' '), lambda w: w <> ''))"
_fns = "SELECT t.a, t.b, d.match_weight, CASE WHEN d.verdict IS NULL THEN 'lost_at_blocking' WHEN d.verdict = 'GREY' THEN 'grey' WHEN d.guarded THEN 'guarded' ELSE 'decided_non_match' END AS cause FROM tp t LEFT JOIN dec d ON t.a = d.a AND t.b = d.b WHERE d.verdict IS NULL OR d.verdict <> 'MATCH'"


def _scored(expr: str, cut: float) -> str:
    return _q(f"SELECT a, b, s AS match_weight, CASE WHEN s >= {cut} THEN 'MATCH' ELSE 'NON_MATCH' END AS verdict FROM (SELECT a, b, cast({expr} AS double) AS s FROM vals) q")


SQL = {
    "records_view": view_sql(),
    "normalized_records": _q("SELECT * FROM norm"),
    "block_keys": _q("SELECT * FROM keys"),
    "candidate_pairs": _q("SELECT a, b, array_to_string(block_origin, ',') AS block_origin FROM pairs"),
    "block_stats": _q("SELECT pass, count(*) AS n_blocks, cast(sum(n * (n - 1) // 2) AS bigint) AS n_pairs, max(n) AS largest FROM blocks GROUP BY pass"),
    "capped_blocks": _q("SELECT * FROM blocks WHERE n > 12"),
    "capped_pairs": _q("SELECT DISTINCT x.record_id AS a, y.record_id AS b FROM keys x JOIN keys y ON x.pass = y.pass AND x.key = y.key AND x.record_id < y.record_id JOIN blocks k ON k.pass = x.pass AND k.key = x.key WHERE k.n <= 12"),
    "linker_rule_pairs": _q(
        """SELECT a, b, count(*) AS n_rules FROM (SELECT x.record_id AS a, y.record_id AS b FROM norm x JOIN norm y ON x.last_name = y.last_name AND x.first_name = y.first_name AND x.record_id < y.record_id
        UNION ALL SELECT x.record_id, y.record_id FROM norm x JOIN norm y ON x.email = y.email AND x.record_id < y.record_id UNION ALL SELECT x.record_id, y.record_id FROM norm x JOIN norm y ON x.phone = y.phone AND x.record_id < y.record_id) q GROUP BY ALL"""
    ),
    "comparison_cost": _q("SELECT cast(1000 * (" + " + ".join(f"coalesce(max(length({c})), 0) * coalesce(max(length({c})), 0)" for c in _A) + ") AS bigint) AS cost FROM norm"),
    "similarities": _q("SELECT a, b, " + ", ".join(f"sim_{c}" for c in _A) + " FROM sims"),
    "agreement_levels": _q("SELECT a, b, " + ", ".join(f"lvl_{c}" for c in _A) + " FROM lvls"),
    "profile_counts": _q("SELECT " + ", ".join(f"lvl_{c}" for c in _A) + ", count(*) AS n FROM lvls GROUP BY ALL"),
    "fixed_weight_decisions": _q("SELECT a, b, match_weight, n_informative, verdict, guarded, CASE WHEN verdict = 'GREY' THEN 'PENDING' END AS review FROM dec"),
    "field_weights": _q("SELECT a, b, " + ", ".join(f"round(w_{c}, 9) AS w_{c}" for c in _A) + " FROM wts"),
    "verdict_histogram": _q("SELECT verdict, count(*) AS n FROM dec GROUP BY verdict"),
    "score_stats": _q("SELECT count(*) AS n, min(match_weight) AS r_min, max(match_weight) AS r_max, " + ", ".join(f"quantile_cont(match_weight, {q}) AS {n}" for q, n in ((0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95"))) + ", round(avg(match_weight), 9) AS r_mean, count(DISTINCT match_weight) AS n_distinct FROM dec"),
    "sized_thresholds": _q(
        """SELECT cast(n_pairs AS bigint) AS n_pairs, t_lower, t_upper FROM (SELECT sum(c) OVER w AS n_pairs, min(match_weight) OVER w AS t_lower, max(match_weight) OVER w AS t_upper FROM (SELECT match_weight, count(*) AS c FROM dec GROUP BY 1) q
        WINDOW w AS (ORDER BY abs(match_weight), match_weight ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) z ORDER BY abs(n_pairs - 300), n_pairs LIMIT 1"""
    ),
    "review_queue": _q("SELECT a, b, match_weight, row_number() OVER (ORDER BY a, b) AS place FROM dec WHERE verdict = 'GREY'"),
    "link_edges": _q("SELECT * FROM lnk"),
    "entities": _q("SELECT * FROM ent"),
    "closure_coverage": _q(
        "SELECT s.entity_id, s.n AS n_records, s.n * (s.n - 1) // 2 AS n_pairs, d.n_direct, s.n * (s.n - 1) // 2 - d.n_direct AS n_recovered FROM (SELECT entity_id, count(*) AS n FROM ent GROUP BY 1 HAVING count(*) > 1) s JOIN (SELECT e.entity_id, count(*) AS n_direct FROM lnk l JOIN ent e ON l.a = e.record_id GROUP BY 1) d ON s.entity_id = d.entity_id"
    ),
    "ballots": _q("SELECT * FROM bal"),
    "fusion_decisions": _q(
        """SELECT entity_id, attribute, norm, raw_form, origin, n_values, CASE WHEN n_values = 1 THEN NULL WHEN l1 = 1 THEN 'MAJORITY' WHEN l2 = 1 THEN 'COMPLETENESS' WHEN l3 = 1 THEN 'SOURCE_PRIORITY' ELSE 'CANONICAL' END AS rule,
        array_to_string(list_filter([CASE WHEN n_values > 1 AND l1 = n_values THEN 'MAJORITY' END, CASE WHEN l1 > 1 AND l2 = l1 THEN 'COMPLETENESS' END, CASE WHEN l2 > 1 AND l3 = l2 THEN 'SOURCE_PRIORITY' END], lambda x: x IS NOT NULL), ',') AS abstained,
        CASE WHEN n_values > 1 THEN ns[1] - ns[2] END AS majority_gap FROM win WHERE rn = 1"""
    ),
    "fused_records": _q(
        "SELECT m.entity_id, m.record_ids, m.n_records, " + ", ".join(f"max(CASE WHEN w.attribute = '{c}' THEN w.raw_form END) AS {c}, max(CASE WHEN w.attribute = '{c}' THEN w.origin END) AS origin_{c}" for c in _A) + " FROM (SELECT entity_id, string_agg(record_id, ',' ORDER BY record_id) AS record_ids, count(*) AS n_records FROM ent GROUP BY 1) m LEFT JOIN win w ON w.entity_id = m.entity_id AND w.rn = 1 GROUP BY m.entity_id, m.record_ids, m.n_records"
    ),
    "completeness_first": _q(
        """SELECT entity_id, attribute, norm, CASE WHEN k0 = 1 THEN NULL WHEN k1 = 1 THEN 'COMPLETENESS' WHEN k2 = 1 THEN 'SOURCE_PRIORITY' ELSE 'CANONICAL' END AS rule FROM (SELECT *, count(*) OVER (PARTITION BY entity_id, attribute) AS k0, count(*) OVER (PARTITION BY entity_id, attribute, norm_length) AS k1,
        count(*) OVER (PARTITION BY entity_id, attribute, norm_length, best_rank) AS k2, row_number() OVER (PARTITION BY entity_id, attribute ORDER BY norm_length DESC, best_rank, norm) AS r FROM bal) q WHERE r = 1"""
    ),
    "discarded_values": _q("SELECT entity_id, attribute, raw_form, norm, n_sources FROM win WHERE rn > 1"),
    "truth_pairs": _q("SELECT * FROM tp"),
    "truth_stats": _q("SELECT n AS entity_size, count(*) AS n_entities, cast(sum(n * (n - 1) // 2) AS bigint) AS n_true_pairs, cast(sum(n - 1) AS bigint) AS n_forest_links FROM (SELECT true_entity, count(*) AS n FROM rec GROUP BY 1) q GROUP BY 1"),
    "decision_defects": _q("SELECT 0::bigint AS self_pairs, cast(sum(cast(a > b AS bigint)) AS bigint) AS misoriented, cast(sum(cast(verdict NOT IN ('MATCH', 'NON_MATCH', 'GREY') AS bigint)) AS bigint) AS unknown_verdicts, cast(sum(cast(match_weight IS NULL AS bigint)) AS bigint) AS bad_weights, count(*) AS n_pairs, count(*) - count(DISTINCT (a, b)) AS repeated FROM dec"),
    "blocking_quality": _q(
        f"SELECT c AS n_candidates, t AS n_true, f AS n_found, {_ratio('f', 't')} AS completeness, {_ratio('f', 'c')} AS quality, round(1 - c / cast(r * (r - 1) // 2 AS double), 9) AS reduction FROM (SELECT (SELECT count(*) FROM pairs) AS c, (SELECT count(*) FROM tp) AS t, (SELECT count(*) FROM pairs p JOIN tp t ON p.a = t.a AND p.b = t.b) AS f, (SELECT count(*) FROM rec) AS r) q"
    ),
    "pass_contribution": _q("SELECT pass, count(*) AS n_true, cast(sum(cast(n = 1 AS bigint)) AS bigint) AS n_only_here FROM (SELECT len(ps) AS n, unnest(ps) AS pass FROM (SELECT list_distinct(list_transform(block_origin, lambda x: split_part(x, ':', 1))) AS ps FROM pairs p JOIN tp t ON p.a = t.a AND p.b = t.b) q) z GROUP BY pass"),
    "lost_pairs": _q("SELECT t.a, t.b FROM tp t WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.a = t.a AND p.b = t.b)"),
    "contingency": _q("SELECT cast(mv AS bigint) AS mv, cast(mf AS bigint) AS mf, cast(gv AS bigint) AS gv, cast(gf AS bigint) AS gf, cast(nv AS bigint) AS nv, cast(nf AS bigint) AS nf, lost FROM cel"),
    "pair_metrics": _q(
        f"SELECT convention, cast(tp AS bigint) AS tp, cast(fp AS bigint) AS fp, cast(fn AS bigint) AS fn, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {_wilson('tp', '(tp + fp)', '-')} AS precision_lo, {_wilson('tp', '(tp + fp)', '+')} AS precision_hi, {_wilson('tp', '(tp + fn)', '-')} AS recall_lo, {_wilson('tp', '(tp + fn)', '+')} AS recall_hi FROM {_CONV} q"
    ),
    "abstention_metrics": _q(f"SELECT {_ratio('n - gv - gf', 'n')} AS coverage, cast(n - gv - gf AS bigint) AS n_decided, cast(gv + gf AS bigint) AS n_abstained, {_ratio('mv', 'mv + mf')} AS precision, {_ratio('mv', 't - gv')} AS recall, {_ratio('2 * mv', 'mv + mf + t - gv')} AS f1 FROM (SELECT *, (SELECT count(*) FROM dec) AS n, (SELECT count(*) FROM tp) AS t FROM cel) z"),
    "recall_parts": _q(f"SELECT {_ratio('mv + gv + nv', 'mv + gv + nv + lost')} AS blocking, {_ratio('mv', 'mv + gv + nv')} AS decision, {_ratio('mv', 'mv + gv + nv + lost')} AS end_to_end FROM cel"),
    "fn_causes": _q(f"SELECT cause, count(*) AS n FROM ({_fns}) q GROUP BY cause"),
    "fn_top": _q(f"SELECT * FROM ({_fns}) q ORDER BY match_weight DESC NULLS LAST, a, b LIMIT 50"),
    "fp_top": _q("SELECT a, b, match_weight FROM rws WHERE verdict = 'MATCH' AND NOT is_true ORDER BY match_weight DESC, a, b LIMIT 50"),
    "score_descriptors": _q("SELECT is_true, count(*) AS n, min(match_weight) AS r_min, max(match_weight) AS r_max, round(avg(match_weight), 6) AS r_mean, round(stddev_pop(match_weight), 6) AS r_std, quantile_cont(match_weight, 0.5) AS r_median, count(DISTINCT match_weight) AS n_distinct FROM rws GROUP BY is_true"),
    "score_histogram": _q("SELECT CASE WHEN match_weight >= -128 AND match_weight < 128 THEN cast(floor(match_weight + 128) AS bigint) ELSE -1 END AS bin, is_true, count(*) AS n FROM rws GROUP BY ALL"),
    "auc": _q("SELECT cast(sum(nv) AS bigint) AS n_true, cast(sum(nf) AS bigint) AS n_false, round(cast(sum(nv * (2 * below + nf)) AS double) / nullif(2 * sum(nv) * sum(nf), 0), 9) AS auc FROM (SELECT *, coalesce(sum(nf) OVER (ORDER BY match_weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM bw) q"),
    "threshold_sweep": _q(f"SELECT round(threshold, 9) AS threshold, tp, fp, fn FROM {_swp} s"),
    "best_threshold": _q(f"SELECT round(threshold, 9) AS threshold, tp, fp, fn, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM {_swp} s ORDER BY f1 DESC NULLS LAST, threshold LIMIT 1"),
    "average_precision": _q(f"SELECT round(sum(cast(nv AS double) * tp / (tp + fp)) / nullif(sum(nv), 0), 6) AS ap, cast(max(tp) AS bigint) AS n_true FROM (SELECT nv, sum(nv) {_down} AS tp, sum(nf) {_down} AS fp FROM bw) q"),
    "kolmogorov_smirnov": _q(f"SELECT match_weight, round(abs(cast(cv AS double) / nullif(tv, 0) - cast(cf AS double) / nullif(tf, 0)), 9) AS d FROM (SELECT match_weight, sum(nv) {_run} AS cv, sum(nf) {_run} AS cf, sum(nv) OVER () AS tv, sum(nf) OVER () AS tf FROM bw) q ORDER BY d DESC NULLS LAST, match_weight LIMIT 1"),
    "overlap": _q("SELECT ovl, round(1 - ovl, 6) AS tvd FROM (SELECT round(sum(least(cast(nv AS double) / tv, cast(nf AS double) / tf)), 6) AS ovl FROM (SELECT nv, nf, sum(nv) OVER () AS tv, sum(nf) OVER () AS tf FROM (SELECT floor(match_weight + 128) AS bin, sum(cast(is_true AS bigint)) AS nv, sum(cast(NOT is_true AS bigint)) AS nf FROM rws GROUP BY 1) h) q) z"),
    "separation_margin": _q("SELECT round(min(CASE WHEN is_true THEN match_weight END) - max(CASE WHEN NOT is_true THEN match_weight END), 9) AS margin FROM rws"),
    "bayes_floor": _q("SELECT cast(sum(least(nv, nf)) AS bigint) AS floor, cast(coalesce(sum(CASE WHEN nv > 0 AND nf > 0 THEN nv + nf END), 0) AS bigint) AS n_mixed, cast(sum(cast(nv > 0 AND nf > 0 AS bigint)) AS bigint) AS mixed_values FROM bw"),
    "grey_composition": _q(
        f"SELECT n, n_true, least(n_true, n - n_true) AS n_minor, {_ratio('n_true', 'n')} AS share_true, CASE WHEN n_true > 0 AND n_true < n THEN round(-(p * log2(p) + (1 - p) * log2(1 - p)), 6) WHEN n > 0 THEN 0.0 END AS entropy FROM (SELECT *, cast(n_true AS double) / nullif(n, 0) AS p FROM (SELECT count(*) AS n, cast(coalesce(sum(cast(is_true AS bigint)), 0) AS bigint) AS n_true FROM rws WHERE verdict = 'GREY') q) z"
    ),
    "grey_profiles": _q("SELECT concat_ws('|', " + ", ".join(f"lvl_{c}" for c in _A) + ") AS profile, count(*) AS n FROM rws WHERE verdict = 'GREY' GROUP BY 1 ORDER BY n DESC, profile LIMIT 5"),
    "doubt_bounds": _q(f"SELECT {_ratio('2 * (mv + gv)', '2 * (mv + gv) + mf + nv + lost')} AS f1_best, {_ratio('2 * mv', '2 * mv + mf + gf + gv + nv + lost')} AS f1_worst FROM cel"),
    "entity_split": _q(f"SELECT record_id, {_fold} AS fold FROM rec"),
    "fold_counts": _q(f"SELECT CASE WHEN x.fold = y.fold THEN x.fold ELSE 0 END AS fold, count(*) AS n, cast(sum(cast(is_true AS bigint)) AS bigint) AS n_true FROM rws r JOIN (SELECT record_id, {_fold} AS fold FROM rec) x ON r.a = x.record_id JOIN (SELECT record_id, {_fold} AS fold FROM rec) y ON r.b = y.record_id GROUP BY 1"),
    "baseline_all": _scored("1.0", 1.0),
    "baseline_exact_triple": _scored(f"CASE WHEN {_triple} THEN 1 ELSE 0 END", 1.0),
    "baseline_strong_key": _scored(f"CASE WHEN {_strong} THEN 1 ELSE 0 END", 1.0),
    "baseline_jaccard": _scored(f"coalesce(round(cast(len(list_intersect({_words('a')}, {_words('b')})) AS double) / nullif(len(list_distinct(list_concat({_words('a')}, {_words('b')}))), 0), 9), 0)", 0.5),
    "baseline_strong_or_three": _scored(f"CASE WHEN {_strong} OR " + " + ".join(f"cast({_same(c)} AS int)" for c in _A) + " >= 3 THEN 1 ELSE 0 END", 1.0),
    "equal_volume_point": _q(f"SELECT min(match_weight) AS least_score, cast(coalesce(max(cum), 0) AS bigint) AS n_pairs FROM (SELECT match_weight, c, sum(c) {_down} AS cum FROM (SELECT match_weight, count(*) AS c FROM dec GROUP BY 1) q) z WHERE cum - c < 500 AND abs(cum - 500) < abs(cum - c - 500)"),
    "mcnemar_counts": _q(
        f"SELECT cast(coalesce(sum(cast(m = t AND s <> t AS bigint)), 0) AS bigint) AS only_first, cast(coalesce(sum(cast(m <> t AND s = t AS bigint)), 0) AS bigint) AS only_second FROM (SELECT r.verdict = 'MATCH' AS m, r.is_true AS t, {_strong} AS s FROM rws r JOIN vals v ON r.a = v.a AND r.b = v.b) q"
    ),
    "threshold_placement": _q(
        f"SELECT is_true, count(*) AS n, {_ratio('sum(cast(match_weight <= 8 AS int))', 'count(*)')} AS share_upto_upper, {_ratio('sum(cast(match_weight <= -8 AS int))', 'count(*)')} AS share_upto_lower, cast(sum(cast(match_weight > 8 AS int)) AS bigint) AS n_above, cast(sum(cast(match_weight < -8 AS int)) AS bigint) AS n_below, cast(sum(cast(match_weight BETWEEN -8 AND 8 AS int)) AS bigint) AS n_between FROM rws GROUP BY is_true"
    ),
    "class_imbalance": _q(
        f"SELECT n_true, n_false, {_ratio('n_false', 'n_true')} AS ratio, {_ratio('n_true', 'n_true + n_false')} AS positive_rate, round((1 - auc) * n_true, 6) AS misplaced_scored, round((1 - auc) * n_true, 6) AS misplaced_all FROM (SELECT cast(sum(nv) AS bigint) AS n_true, cast(sum(nf) AS bigint) AS n_false, round(cast(sum(nv * (2 * below + nf)) AS double) / nullif(2 * sum(nv) * sum(nf), 0), 9) AS auc FROM (SELECT *, coalesce(sum(nf) OVER (ORDER BY match_weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM bw) q) z"
    ),
    "irreducibility": _q(
        f"SELECT count(*) AS n_values, cast(coalesce(sum(cast(nv > 0 AND nf > 0 AS int)), 0) AS bigint) AS mixed_values, {_ratio('sum(CASE WHEN nv > 0 AND nf > 0 THEN nv + nf ELSE 0 END)', 'sum(nv + nf)')} AS share_mixed, cast(coalesce(sum(least(nv, nf)), 0) AS bigint) AS floor, CASE WHEN sum(nv) >= 5 AND sum(nf) > 0 THEN round(cast(sum(nv * (2 * below + nf)) AS double) / (2 * sum(nv) * sum(nf)), 9) END AS auc_inside FROM (SELECT *, coalesce(sum(nf) OVER (ORDER BY match_weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT match_weight, sum(cast(is_true AS int)) AS nv, sum(cast(NOT is_true AS int)) AS nf FROM rws WHERE verdict = 'GREY' GROUP BY 1) b) q"
    ),
    "band_evidence": _q(
        "SELECT band, count(*) AS n, list_sort(list(n_informative))[count(*) // 2 + 1] AS median_informative, round(cast(sum(miss) AS double) / (8 * count(*)), 9) AS missing_rate FROM (SELECT CASE WHEN verdict = 'GREY' THEN 'inside' ELSE 'outside' END AS band, n_informative, " + " + ".join(f"cast(lvl_{c} = 'MISSING' AS int)" for c in _A) + " AS miss FROM dec) q GROUP BY band"
    ),
    "band_reconciliation": _q(
        "SELECT *, n_between - n_grey - n_guarded_between AS gap, n_between = n_grey + n_guarded_between AS coherent FROM (SELECT cast(sum(cast(match_weight BETWEEN -8 AND 8 AS int)) AS bigint) AS n_between, cast(sum(cast(verdict = 'GREY' AS int)) AS bigint) AS n_grey, cast(sum(cast(guarded AS int)) AS bigint) AS n_guarded, cast(sum(cast(guarded AND match_weight BETWEEN -8 AND 8 AS int)) AS bigint) AS n_guarded_between FROM dec) q"
    ),
    "fold_f1": _q(
        f"""SELECT r.fold, th.threshold, r.tp, r.fp, t.n_true, {_ratio('2 * r.tp', 'r.tp + r.fp + t.n_true')} AS f1 FROM
        (SELECT x.fold, cast(sum(cast(r.is_true AS int)) AS bigint) AS tp, cast(sum(cast(NOT r.is_true AS int)) AS bigint) AS fp FROM rws r JOIN (SELECT record_id, {_fold} AS fold FROM rec) x ON r.a = x.record_id JOIN (SELECT record_id, {_fold} AS fold FROM rec) y ON r.b = y.record_id AND x.fold = y.fold
            WHERE r.match_weight > (SELECT threshold FROM fth) GROUP BY x.fold) r
        JOIN (SELECT x.fold, count(*) AS n_true FROM tp p JOIN (SELECT record_id, {_fold} AS fold FROM rec) x ON p.a = x.record_id JOIN (SELECT record_id, {_fold} AS fold FROM rec) y ON p.b = y.record_id AND x.fold = y.fold GROUP BY x.fold) t ON r.fold = t.fold CROSS JOIN fth th"""
    ),
    "system_metrics": _q(
        "SELECT system, tp, fp, fn, " + ", ".join((_ratio("tp", "tp + fp") + " AS precision", _ratio("tp", "tp + fn") + " AS recall", _ratio("2 * tp", "2 * tp + fp + fn") + " AS f1")) + " FROM (SELECT system, cast(sum(cast(m AND t AS int)) AS bigint) AS tp, cast(sum(cast(m AND NOT t AS int)) AS bigint) AS fp, (SELECT count(*) FROM tp) - cast(sum(cast(m AND t AS int)) AS bigint) AS fn FROM ("
        + " UNION ALL ".join(
            [
                "SELECT 'engine' AS system, verdict = 'MATCH' AS m, is_true AS t FROM rws",
                *(
                    f"SELECT '{n}', cast({e} AS double) >= {c}, r.is_true FROM vals v JOIN rws r ON v.a = r.a AND v.b = r.b"
                    for n, e, c in (
                        ("all", "1.0", 1.0),
                        ("exact_triple", f"CASE WHEN {_triple} THEN 1 ELSE 0 END", 1.0),
                        ("strong_key", f"CASE WHEN {_strong} THEN 1 ELSE 0 END", 1.0),
                        ("jaccard", f"coalesce(round(cast(len(list_intersect({_words('a')}, {_words('b')})) AS double) / nullif(len(list_distinct(list_concat({_words('a')}, {_words('b')}))), 0), 9), 0)", 0.5),
                        ("strong_or_three", f"CASE WHEN {_strong} OR " + " + ".join(f"cast({_same(c)} AS int)" for c in _A) + " >= 3 THEN 1 ELSE 0 END", 1.0),
                    )
                ),
            ]
        )
        + ") q GROUP BY system) z"
    ),
    "pair_evidence": _q(
        "SELECT a, b, verdict, match_weight, " + ", ".join("array_to_string(list_filter([" + ", ".join(f"CASE WHEN lvl_{c} = '{lv}' THEN '{c}' END" for c in _A) + f"], lambda x: x IS NOT NULL), ',') AS {n}" for n, lv in (("agree", "STRONG"), ("partly", "PARTIAL"), ("differ", "DISAGREE"), ("missing", "MISSING")))
        + ", round(greatest(" + ", ".join(f"w_{c}" for c in _A) + "), 9) AS most_for, round(least(" + ", ".join(f"w_{c}" for c in _A) + "), 9) AS most_against FROM dec WHERE verdict IN ('MATCH', 'GREY')"
    ),
    "equal_after_normalization": _q("SELECT v.a, v.b, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c}_a = {c}_b THEN '{c}' END" for c in _A) + "], lambda x: x IS NOT NULL), ',') AS equal FROM vals v JOIN lnk l ON v.a = l.a AND v.b = l.b"),
    "to_verify": _q(
        "SELECT entity_id, cast(sum(cast(ea = eb AS int)) AS bigint) AS n_inside, cast(sum(cast(ea <> eb AS int)) AS bigint) AS n_between, max(match_weight) AS heaviest FROM (SELECT unnest(list_distinct([x.entity_id, y.entity_id])) AS entity_id, x.entity_id AS ea, y.entity_id AS eb, d.match_weight FROM dec d JOIN ent x ON d.a = x.record_id JOIN ent y ON d.b = y.record_id WHERE d.verdict = 'GREY') q GROUP BY entity_id"
    ),
    "truth_check": _q("SELECT 812::bigint AS announced, count(*) AS counted, count(*) - 812 AS gap, count(*) = 812 AS agrees FROM tp"),
    "all_linker_rules": _q(
        "SELECT a, b, array_to_string(list_sort(list(DISTINCT r)), ',') AS rules FROM ("
        + " UNION ALL ".join(
            f"SELECT x.record_id AS a, y.record_id AS b, '{n}' AS r FROM norm x JOIN norm y ON {on} AND x.record_id < y.record_id"
            for n, on in (
                ("NAMES", "x.last_name = y.last_name AND x.first_name = y.first_name"),
                ("BIRTH", "x.birth_date = y.birth_date"),
                ("EMAIL", "x.email = y.email"),
                ("PHONE", "x.phone = y.phone"),
                ("CP", "x.postal_code = y.postal_code"),
                ("ADDRESS", "x.address = y.address"),
            )
        )
        + " UNION ALL SELECT x.record_id, y.record_id, 'PREF' FROM keys x JOIN keys y ON x.pass = 'PREF' AND y.pass = 'PREF' AND x.key = y.key AND x.record_id < y.record_id) q GROUP BY a, b"
    ),
}
