"""The entity-resolution engine against literal cases and independent computations."""

import math

import pytest
from pyspark.sql import functions as F

from confluo.functions import similarity as S
from confluo.functions.text import normalize
from confluo.measure import metrics
from confluo.operators import blocking, closure, decide, fusion, graph, review
from confluo.plans import oracles
from confluo.schema import ATTRIBUTES, RECORD

ROW = dict.fromkeys(RECORD)


def records(spark, *rows):
    return spark.createDataFrame([tuple((ROW | r)[c] for c in RECORD) for r in rows], ", ".join(f"{c} string" for c in RECORD))


def test_normalize(spark):
    r = normalize(records(spark, {"record_id": "1", "last_name": "S.A.R.L. Été  Dupré", "birth_date": "3/4/1980", "address": "12 bd. St Jean", "phone": "+33 1 23 45 67 89", "email": " A@B.c ", "postal_code": "F-06000"}, {"record_id": "2", "last_name": "SARL", "birth_date": "19800403", "city": " "})).orderBy("record_id").collect()
    assert (r[0].last_name, r[0].birth_date, r[0].address, r[0].phone, r[0].email, r[0].postal_code) == ("ete dupre", "1980-04-03", "12 boulevard saint jean", "0123456789", "a@b.c", "06000")
    assert (r[1].last_name, r[1].birth_date, r[1].city) == ("sarl", "1980-04-03", None)


def test_jaro_winkler():
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert S.jaro("abc", "") == 0 and S.jaro("", "") == 1


def test_blocking(spark):
    n = normalize(records(spark, *({"record_id": k, "last_name": "Martin", "postal_code": p} for k, p in (("a", "1"), ("b", "1"), ("c", None)))))
    pairs = {(r.a, r.b): r.block_origin for r in blocking.candidate_pairs(blocking.block_keys(n)).collect()}
    assert pairs == {("a", "b"): ["CP:1", "PREF:mart"], ("a", "c"): ["PREF:mart"], ("b", "c"): ["PREF:mart"]}
    with pytest.raises(ValueError):
        blocking.block_keys(n, ("nope",))


def test_estimate_orients_and_falls_back():
    same, other = ("STRONG",) * 8, ("DISAGREE",) * 8
    e = decide.estimate([(same, 20), (other, 200)])
    w = e.weights()
    assert e.converged and all(w[a]["STRONG"] > 0 > w[a]["DISAGREE"] for a in ATTRIBUTES) and e.p == pytest.approx(20 / 220, abs=0.02)
    assert decide.estimate([(same, 2)]).fallback == "too few pairs"


@pytest.mark.parametrize("links", [[], [("a", "b"), ("b", "c"), ("c", "a")], [(f"{k:03d}", f"{k + 1:03d}") for k in range(40)], [("hub", f"x{k}") for k in range(20)]])
def test_components(spark, links):
    of = {x: x for ab in links for x in ab}
    for _ in of:
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    got = {r.id: r.component_id for r in graph.connected(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == of


def test_fusion_cascade(spark):
    rows = records(spark, {"record_id": "1", "source_id": "A", "city": "Lyon"}, {"record_id": "2", "source_id": "B", "city": "LYON"}, {"record_id": "3", "source_id": "B", "city": "Paris"}, {"record_id": "4", "city": "Marseille"})
    parts = rows.select("record_id", F.lit("e").alias("entity_id"))
    votes = fusion.ballots(rows, parts)
    won = fusion.arbitrated(votes).collect()[0]
    assert (won.raw_form, won.rule, won.majority_gap, won.n_values) == ("Lyon", "MAJORITY", 1, 3)
    assert fusion.arbitrated(votes, ("COMPLETENESS", "CANONICAL")).collect()[0].raw_form == "Marseille"
    with pytest.raises(ValueError):
        fusion.check_policy(("MAJORITY",))


def test_review_answers(spark):
    got = spark.createDataFrame([("MATCH",), ("x\n NON_MATCH \ny",), ("MATCH\nNON_MATCH",), ("not a MATCH",)], "t string").select(review.parsed(F.col("t")).alias("d")).collect()
    assert [r.d for r in got] == ["MATCH_AFTER_REVIEW", "NON_MATCH_AFTER_REVIEW", "ABSTAIN", "ABSTAIN"]


def test_estimate_equals_em_over_pairs():
    """The estimate over profiles against EM over single pairs, on data with missing levels and an attribute never seen."""
    import numpy as np

    rng = np.random.default_rng(3)
    levels = ("STRONG", "PARTIAL", "DISAGREE")
    pairs = []
    for k in range(600):
        p = (0.85, 0.1, 0.05) if k < 60 else (0.05, 0.15, 0.8)
        pairs.append(tuple("MISSING" if a == 7 or rng.random() < 0.1 else levels[rng.choice(3, p=p)] for a in range(8)))
    counts = {}
    for x in pairs:
        counts[x] = counts.get(x, 0) + 1
    got = decide.estimate(sorted(counts.items()), "seed")
    start = decide.priors("seed")
    m, u, p = [[start.m[a][lv] for lv in levels] for a in ATTRIBUTES], [[start.u[a][lv] for lv in levels] for a in ATTRIBUTES], start.p
    at = np.array([[levels.index(v) if v in levels else -1 for v in x] for x in pairs])
    for _ in range(got.iterations):
        g = []
        for row in at:
            x, y = p, 1 - p
            for a, v in enumerate(row):
                if v >= 0:
                    x, y = x * m[a][v], y * u[a][v]
            g.append(x / (x + y))
        g = np.array(g)
        p = g.mean()
        for a in range(7):
            for table, w in ((m, g), (u, 1 - g)):
                mass = [w[at[:, a] == v].sum() + 0.5 for v in range(3)]
                table[a] = [v / sum(mass) for v in mass]
    assert got.converged and got.fallback is None and got.unseen == ["phone"]
    assert got.p == pytest.approx(p, abs=1e-7) and got.m["phone"] == decide.PRIOR_M
    assert all(got.m[x][lv] == pytest.approx(m[a][k], abs=1e-7) for a, x in enumerate(ATTRIBUTES[:7]) for k, lv in enumerate(levels))


def test_estimate_without_convergence_has_the_priors():
    same, other = ("STRONG",) * 8, ("DISAGREE",) * 8
    e = decide.estimate([(same, 20), (other, 200)], iterations=2, tolerance=0.0)
    assert (e.fallback, e.iterations, e.converged) == ("not converged", 2, False) and e.m == decide.priors().m and e.p == decide.EM_PRIOR


def test_thresholds_without_pairs_stay(spark):
    from confluo.operators import sizing

    t = sizing.thresholds(spark.createDataFrame([], "match_weight double"))
    assert (t.upper, t.lower, t.n_pairs) == (8.0, -8.0, 0) and t.fallback
    t = sizing.thresholds(spark.createDataFrame([(-3.0,), (1.0,), (1.0,), (2.0,), (9.0,)], "match_weight double"), 3)
    assert (t.lower, t.upper, t.n_pairs, t.fallback) == (1.0, 2.0, 3, None)


def test_recall_under_abstention_counts_lost_pairs(spark):
    cells = spark.createDataFrame([(6, 2, 3, 1, 1, 7, 5)], ", ".join(f"{c} long" for c in metrics.CELLS))
    r = metrics.under_abstention(cells).first()
    assert (r.n_decided, r.n_abstained) == (16, 4) and r.precision == 0.75 and r.recall == 0.5 and r.f1 == 0.6 and r.coverage == 0.8


def test_generated_corruptions_have_an_effect(spark):
    from confluo.sources.records import generated

    rows = generated(spark, "s", 300).collect()
    clean = {r.true_entity: r for r in rows if r.source_id == "SRC_A"}
    copies = [r for r in rows if r.source_id == "SRC_B"]
    assert copies and rows == generated(spark, "s", 300).repartition(3).collect()[:0] + rows
    for r in copies:
        changed = {a for a in ATTRIBUTES if r[a] != clean[r.true_entity][a]}
        of = {"TYPO": "last_name", "PHONETIC": "postal_code", "FORMAT": "address", "MISSING": "email", "TRUNCATION": "first_name", "NOISE": "city"}
        assert all(of[c] in changed for c in r.corruptions if c in of)
        assert "SWAP" not in r.corruptions or {"last_name", "first_name"} <= changed
        assert bool(changed) == bool(r.corruptions)


def test_soundex_keys(spark):
    names = {"Robert": "R163", "Rupert": "R163", "Ashcraft": "A261", "Tymczak": "T522", "Pfister": "P236", "Honeyman": "H555", "12": None, None: None}
    n = normalize(records(spark, *({"record_id": str(k), "last_name": x} for k, x in enumerate(names))))
    got = {r.record_id: r.key for r in blocking.block_keys(n, ("SDX_NAME",)).collect()}
    assert got == {str(k): v for k, v in enumerate(names.values()) if v}


def test_review_queue_places(spark):
    rows = [(f"a{k % 7}", f"b{k:03d}", 0.0, "GREY" if k % 3 else "MATCH") for k in range(90)]
    got = sorted((r.place, r.a, r.b) for r in review.ranked(spark.createDataFrame(rows, "a string, b string, match_weight double, verdict string")).collect())
    want = sorted((a, b) for a, b, _, v in rows if v == "GREY")
    assert got == [(k, a, b) for k, (a, b) in enumerate(want, 1)]


def test_self_pairs_raise(spark):
    with pytest.raises(ValueError):
        closure.check_pairs(spark.createDataFrame([("a", "a")], "a string, b string"))


def test_mcnemar():
    assert metrics.mcnemar_p(0, 0) == 1 and metrics.mcnemar_p(0, 5) == pytest.approx(2 / 32) and math.isclose(metrics.mcnemar_p(3, 3), 1)


@pytest.mark.parametrize("name", ["normalized_records", "candidate_pairs", "similarities", "entities", "fold_f1", "system_metrics", "irreducibility", "to_verify"])
def test_query_equals_sql(spark, name):
    import duckdb

    from confluo.plans import catalogue

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, d)
    want = con.sql(oracles.SQL[name]).df()[got.columns]
    text = lambda rows: sorted(tuple("" if v is None or v != v else str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows)
    assert text(got.collect()) == text(want.itertuples(index=False))


def test_pairs_reach_no_shuffle(spark):
    """Pairs grow with the square of a block: nothing is exchanged after the join that makes them, and counting makes none."""
    rows = [{"record_id": f"{k:03d}", "last_name": ("Martin", "Martel", "Durand")[k % 3], "postal_code": str(k % 4)} for k in range(40)]
    n = normalize(records(spark, *rows))
    keys = blocking.block_keys(n)
    pairs = blocking.candidate_pairs(keys, carried=n.select("record_id", "city"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [k#" in plan and "Exchange" not in plan.split("SortMergeJoin [k#")[0]
    want = {(a["record_id"], b["record_id"]) for a in rows for b in rows if a["record_id"] < b["record_id"] and (a["postal_code"] == b["postal_code"] or a["last_name"][:4] == b["last_name"][:4])}
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want
    assert blocking.pair_count(keys).first()[0] == len(want)


def test_many_pairs_are_not_written(spark, monkeypatch):
    """With more pairs than are written, queries give the same rows and no table of pairs comes to disk."""
    from confluo.plans import catalogue, substrate

    d = "/root/testdata/sf0.001"
    names = ("fixed_weight_decisions", "contingency", "fold_f1", "class_imbalance", "profile_counts", "blocking_quality", "lost_pairs", "pass_contribution", "sized_decisions", "closure_coverage", "baseline_jaccard", "golden_records")
    rows = lambda: {n: sorted(map(str, catalogue.QUERIES[n](spark, d).collect())) for n in names}
    want = rows()
    monkeypatch.setattr(substrate, "FEW_PAIRS", 0)
    monkeypatch.setattr(substrate, "_HELD", {})
    made = []
    saved = substrate.saved
    monkeypatch.setattr(substrate, "saved", lambda df, name: (made.append(name), saved(df, name))[1])
    assert rows() == want and not {"pairs", "levels", "decided"} & set(made)


def test_kernel_over_columns_equals_the_kernel():
    import random

    import pyarrow as pa

    draw = random.Random(5)
    word = lambda: None if draw.random() < 0.1 else "".join(draw.choice("abcé𝄞 \0") for _ in range(draw.choice((0, 1, 2, 4, 6, 9, 30, 300))))
    x = [word() for _ in range(3000)]
    y = [draw.choice((v, word(), v and v[::-1])) for v in x]
    want = [None if a is None or b is None else S.jaro_winkler(a, b) for a, b in zip(x, y, strict=True)]
    assert S.jaro_winkler_of(pa.array(x, pa.string()), pa.array(y, pa.string())).to_pylist() == want


def test_no_task_has_all_pairs_of_a_large_block(spark, monkeypatch):
    """A block larger than a tile is dealt over tasks, also with repeated rows, without losing or repeating a pair."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(blocking, "TILE", 8)
    rows = [{"record_id": f"{k:03d}", "last_name": ("Martin", "Martel", "Durand")[k % 3], "postal_code": str(k % 4 // 3)} for k in range(90)]
    n = normalize(records(spark, *rows))
    keys = blocking.block_keys(n)
    plain = blocking.candidate_pairs(keys, carried=n.select("record_id", "city"))
    pairs = blocking.candidate_pairs(keys.union(keys.limit(9)), carried=n.select("record_id", "city"), parts=12)
    assert sorted(map(str, pairs.collect())) == sorted(map(str, plain.collect()))
    made = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert max(made) < sum(made) / 3
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("SortMergeJoin [k#")[0]


def _odd_records(spark, n=150):
    """Records with missing values, swapped and odd dates, near mails, repeated bigrams and letters beyond the basic plane."""
    import random

    draw = random.Random(11)
    some = lambda *xs: draw.choice(xs)
    rows = []
    for k in range(n):
        rows.append(
            {
                "record_id": f"{k:04d}", "last_name": some("martin", "martine", "marti", "durand", "m", None, "𝄞é"), "first_name": some("ann", "anne", None, "abcdefgh" * 40), "birth_date": some("1990-02-03", "1990-03-02", "1990-02-04", "unknown", "unknow", None),
                "address": some("1 rue haute", "1 rue hauts", "aaaa aaaa", "aaaa", "x", None, f"{k} rue basse"), "postal_code": some("10000", "10001", "1000", "75", None), "city": some("lyon", "lyons", None),
                "email": some(f"a{k % 40}@x.org", f"a{k % 40}0@x.org", "b@x", "c" * 200, "c" * 199 + "d", None), "phone": some("01", "02", None),
            }
        )
    return records(spark, *rows)


def test_matrix_of_a_block_equals_the_pairs(spark, monkeypatch):
    """Counts, links and rows from matrices are those of the pairs one by one, in small, joined and tiled blocks."""
    from confluo.operators import compare, matrix

    monkeypatch.setattr(blocking, "TILE", 40)
    rows = _odd_records(spark)
    keys = blocking.block_keys(rows)
    carried = rows.select("record_id", *ATTRIBUTES)
    t = rows.select("record_id", F.expr("CASE WHEN record_id % 7 > 0 THEN record_id % 9 END").cast("string").alias("true_entity"), F.expr("cast(record_id % 2 + 1 AS int)").alias("fold"))
    pairs = compare.levels(compare.similarities(blocking.candidate_pairs(keys), carried)).select("a", "b", *(f"lvl_{x}" for x in ATTRIBUTES))
    of = {r["record_id"]: r for r in t.collect()}
    want = {}
    for r in pairs.collect():
        x, y = of[r["a"]], of[r["b"]]
        key = (*r[2:], x["true_entity"] is not None and x["true_entity"] == y["true_entity"], x["fold"] if x["fold"] == y["fold"] else 0)
        want[key] = want.get(key, 0) + 1
    assert {tuple(r)[:-1]: r["n"] for r in matrix.counted(blocking.dealt(keys, carried.join(t, "record_id"), 3)).collect()} == want
    by_code = decide.decisions(matrix.all_profiles(spark), decide.priors().weights())
    decided = decide.decisions(pairs, decide.priors().weights()).select("a", "b", "match_weight", "verdict")
    dealt = blocking.dealt(keys, carried, 3)
    assert sorted(matrix.decided(dealt, by_code, {"match_weight": "double", "verdict": "string"}).collect()) == sorted(decided.collect())
    codes = [r["code"] for r in by_code.where("verdict = 'MATCH'").collect()]
    assert sorted(matrix.linked(dealt, codes).collect()) == sorted(decided.where("verdict = 'MATCH'").select("a", "b").collect())


def test_values_with_one_edit_between_them():
    import random

    from confluo.operators import matrix

    draw = random.Random(3)
    values = sorted({"".join(draw.choice("ab𝄞") for _ in range(draw.choice((1, 2, 3, 4, 130)))) for _ in range(150)})
    values += ["z" * 200, "z" * 201, "z" * 128, "z" * 129]

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row = row, [i]
            for j, d in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    want = {(i, j) for i, x in enumerate(values) for j, y in enumerate(values) if i != j and abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1}
    assert set(zip(*(p.tolist() for p in matrix.near(values)), strict=True)) == want
