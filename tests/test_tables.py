"""Relational, aggregate, window, classifier, regression and planner operators on small tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import contracts as K
from corpusloom.operators import aggregates as A
from corpusloom.operators import classify as C
from corpusloom.operators import planner as P
from corpusloom.operators import regression as G
from corpusloom.operators import relational as R
from corpusloom.operators import windows as W


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_contracts(spark):
    df = frame(spark, "CIK string, b int", [("1", 2), ("1", 3)])
    assert K.resolve_column(df, ("cik", "x")) == "CIK" and K.resolve_column(df, ("z",)) is None
    assert K.with_synonyms(df, {"cik_code": ("cik",)}).columns == ["CIK", "b", "cik_code"]
    assert K.order_columns(K.with_defaults(df, {"c": 0}), ["c", "b", "q"]).columns == ["c", "b", "CIK"]
    with pytest.raises(K.ContractError):
        K.assert_unique(df, ["CIK"])
    with pytest.raises(K.ContractError):
        K.require_columns(df, ["nope"])


def test_joins(spark):
    a = frame(spark, "k int, x int, o int", [(1, 10, 0), (1, 11, 1), (2, 20, 0), (None, 5, 0)])
    b = frame(spark, "k int, x int, o int", [(1, 100, 0), (1, 101, 1)])
    out = {r.k: (r.x, r.x_ctrl) for r in R.join_keep_last(a, b, ["k"], ["o"]).collect()}
    assert out == {1: (11, 101), 2: (20, None), None: (5, None)}
    with pytest.raises(K.ContractError):
        R.join_one_to_one(a, b, ["k"])
    with pytest.raises(K.ContractError):
        R.join_many_to_one(a, frame(spark, "kk int, y int", [(1, 1)]), "k", "kk")
    gone = R.leakage_free(a, b, "k").select("k").collect()
    assert sorted(r.k is None or r.k for r in gone) == [True, 2]
    assert R.leaking(a, b, "k").count() == 2
    up = R.upsert(frame(spark, "k int, v string", [(1, "n"), (2, "n")]), frame(spark, "k int, v string", [(1, "old"), (2, None)]), "k", ["v"])
    assert {r.k: r.v for r in up.collect()} == {1: "old", 2: "n"}


def test_relationship(spark):
    make = lambda rows: frame(spark, "norm string, label string", rows)
    kind = lambda a, b: R.dataset_relationship(make(a), make(b)).first().relationship
    assert kind([("a", "A"), ("b", "S")], [("b", "S"), ("a", "A")]) == "historical_duplicate"
    assert kind([("a", "A"), ("b", "S")], [("b", "A"), ("a", "A")]) == "same_sentences"
    assert kind([("a", "A")], [("a", "A"), ("c", "A")]) == "overlapping"
    assert kind([("a", "A")], [("c", "A")]) == "disjoint"


def test_phrase_match(spark):
    orgs = frame(spark, "org string", [("Big Blue Inc",), ("Blueprint LLC",), ("Very Big  Blue",), (None,)])
    terms = frame(spark, "t string", [("big blue",), ("",), ("blue",), ("c++ (x)",)])
    got = {(r.org, r.t) for r in R.match_terms(orgs, "org", terms, "t").collect()}
    assert got == {("Big Blue Inc", "big blue"), ("Very Big  Blue", "big blue"), ("Big Blue Inc", "blue"), ("Very Big  Blue", "blue")}


def test_label_counts_with_empty_keys(spark):
    rows = frame(spark, "cik string, label string", [("1", "Actionable"), ("1", "Speculative"), ("1", "Irrelevant"), ("1", "ERROR")])
    out = {r.cik: r for r in A.label_counts(rows, ["cik"], "label", keep_empty=frame(spark, "cik string", [("1",), ("2",)])).collect()}
    assert (out["1"].A_count, out["1"].total_count, out["2"].total_count) == (1, 3, 0)
    assert out["1"].AI_frequency_total == pytest.approx(np.log1p(3)) and out["2"].AI_frequencyA == 0


def test_published_confusion_matrix(spark):
    cells = {("Actionable", "Actionable"): 58, ("Actionable", "Irrelevant"): 10, ("Speculative", "Actionable"): 4, ("Speculative", "Speculative"): 45, ("Speculative", "Irrelevant"): 2, ("Irrelevant", "Actionable"): 18, ("Irrelevant", "Speculative"): 65, ("Irrelevant", "Irrelevant"): 14}
    rows = frame(spark, "t string, p string", [k for k, n in cells.items() for _ in range(n)])
    m = A.overall_metrics(rows, "t", "p").first()
    assert (m.n, m.correct) == (216, 117) and round(m.macro_f1, 5) == 0.52348
    got = {r.true: (r.Actionable, r.Speculative, r.Irrelevant) for r in A.confusion(rows, "t", "p").collect()}
    assert got == {"Actionable": (58, 0, 10), "Speculative": (4, 45, 2), "Irrelevant": (18, 65, 14)}


def test_kappa_and_transitions(spark):
    rows = frame(spark, "a string, b string", [("Actionable", "Actionable"), ("Speculative", "Actionable"), ("Irrelevant", "Irrelevant"), ("Actionable", "Speculative")])
    assert A.kappa(rows, "a", "b").first().kappa == pytest.approx(0.2)
    moves = {r.transition: r.n for r in A.transitions(rows, "a", "b").collect()}
    assert len(moves) == 6 and moves["A->S"] == moves["S->A"] == 1 and sum(moves.values()) == 2
    assert A.kappa(rows.where("false"), "a", "b").first().kappa is None
    assert A.kappa(frame(spark, "a string, b string", [("Actionable", "Actionable")] * 3), "a", "b").first().kappa == 1.0


def test_pathologies_and_profiles(spark):
    rows = frame(spark, "f string, label string", [("x", "Irrelevant")] * 100 + [("y", x) for x in K.LABELS] + [("z", "ERROR")])
    got = {r.f: r for r in A.share_pathologies(rows, "f", "label").collect()}
    assert got["x"].pathology_reasons.count(";") == 1 and not got["y"].pathology_flag and got["z"].I_share == 0 and got["z"].error_rows == 1
    d = A.duplicate_summary(frame(spark, "k int", [(1,), (1,), (1,), (2,)]), ["k"]).first()
    assert (d.members, d.extras) == (3, 2)
    gate = A.qa_gate(rows, {"errors": F.col("label") == "ERROR", "nulls": F.col("label").isNull()}).first()
    assert gate.status == "fail" and gate.violations == ["errors"]


def test_centroids(spark):
    rows = frame(spark, "label string, v array<float>", [("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [1.0, 1.0]), ("b", [9.0]), ("b", None), ("b", [None, 1.0])])
    assert {r.label: r.centroid for r in A.centroids(rows, "label", "v", 2).collect()} == {"a": [2.0, 3.0], "b": [1.0, 1.0]}
    near = C.nearest_centroid(frame(spark, "i int, v array<float>", [(1, [1.0, 1.0]), (2, [2.0, 3.0]), (3, [0.0, 0.0])]), "v", A.centroids(rows, "label", "v", 2))
    assert {r.i: r.nearest for r in near.collect()} == {1: "b", 2: "a", 3: None}


def test_leads_lags_winsor(spark):
    panel = frame(spark, "cik string, year int, x double", [("a", 2020, 1.0), ("a", 2022, 3.0), ("a", 2023, None), ("b", 2020, 5.0)])
    rows = {(r.cik, r.year): r for r in W.leads(panel, "cik", "year", "x").collect()}
    assert rows["a", 2020].x_lead1 == 3.0 and rows["a", 2022].x_lead1 is None and rows["b", 2020].any_x_lead1 == 0 and rows["a", 2020].any_x_lead2 == 0
    lag = {(r.cik, r.year): r.x_growth for r in W.lag_growth(panel, "cik", "year", "x").collect()}
    assert lag["a", 2022] == 2.0 and lag["a", 2020] is None
    r = np.random.default_rng(1)
    data = [("g" if i % 3 else "h", float(v)) for i, v in enumerate(r.standard_normal(200))] + [("one", 1.0), ("nulls", None)]
    out = W.winsorize(frame(spark, "g string, x double", data), "x", "g").collect()
    for g in ("g", "h"):
        v = np.array([x for k, x in data if k == g])
        lo, hi = np.quantile(v, [0.01, 0.99])
        assert sorted(x.x_w for x in out if x.g == g) == pytest.approx(sorted(np.clip(v, lo, hi)))
    assert [x.x_w for x in out if x.g in ("one", "nulls")] in ([1.0, None], [None, 1.0])


def greedy_round_robin(rows, quota):
    """The loop: one of each known bucket in turn, then the rest."""
    left = {b: [r for r in rows if r["known"] and r["b"] == b] for b in sorted({r["b"] for r in rows if r["known"]})}
    out = []
    while len(out) < quota and any(left.values()):
        for b in left:
            if left[b] and len(out) < quota:
                out.append(left[b].pop(0))
    rest = sorted((r for r in rows if not r["known"]), key=lambda r: r["id"])
    return [r["id"] for r in out + rest[: quota - len(out)]]


def greedy_batch(rows, quota):
    taken, out, rest = {}, [], sorted(rows, key=lambda r: (r["f"], r["i"], r["id"]))
    while len(out) < quota and any(r["known"] for r in rest):
        for ff in sorted({r["ff"] for r in rest if r["known"]}):
            pool = [r for r in rest if r["known"] and r["ff"] == ff]
            if pool and len(out) < quota:
                best = min(pool, key=lambda r: (taken.get(r["f"], 0), r["f"], r["i"], r["id"]))
                out.append(best)
                rest.remove(best)
                taken[best["f"]] = taken.get(best["f"], 0) + 1
    while len(out) < quota and rest:
        best = min(rest, key=lambda r: (taken.get(r["f"], 0), not r["edge"], W.LENGTH_PRIORITY[r["lb"]], r["f"], r["i"], r["id"]))
        out.append(best)
        rest.remove(best)
        taken[best["f"]] = taken.get(best["f"], 0) + 1
    return [r["id"] for r in out]


def test_selection_closed_forms(spark):
    r = random.Random(11)
    robin, batch, rows_a, rows_b = {}, {}, [], []
    for s in range(40):
        quota = r.randrange(1, 9)
        a = [{"id": s * 100 + i, "b": r.choice([2, 10, 3]), "known": r.random() < 0.7} for i in range(r.randrange(1, 12))]
        robin[s] = greedy_round_robin(a, quota)
        rows_a += [(s, x["id"], x["b"], x["known"], quota) for x in a]
        files = {f"f{k}": (r.choice(["2", "10", "3"]), r.random() < 0.6) for k in range(4)}
        b = []
        for i in range(r.randrange(1, 14)):
            f = r.choice(list(files))
            b.append({"id": f"{s:02}-{i:02}", "f": f, "i": i, "ff": files[f][0], "known": files[f][1], "edge": r.random() < 0.5, "lb": r.choice(list(W.LENGTH_PRIORITY))})
        batch[s] = (greedy_batch(b, quota), quota)
        rows_b += [(s, x["ff"], x["known"], x["f"], x["i"], x["id"], x["edge"], x["lb"]) for x in b]
    df = frame(spark, "s int, id int, b int, known boolean, quota int", rows_a)
    got = W.round_robin(df, "s", "b", F.col("known"), 9, ["id"]).where("selection_order <= quota").orderBy("s", "selection_order").collect()
    assert {s: [x.id for x in g] for s, g in itertools.groupby(got, lambda x: x.s)} == robin
    df = frame(spark, "quarter int, ff12_code string, known boolean, source_file string, sentence_index int, sentence_id string, edge_case_flag boolean, length_bin string", rows_b)
    quotas = frame(spark, "quarter int, quota int", [(s, q) for s, (_, q) in batch.items()])
    got = W.select_batch(df, quotas).orderBy("quarter", "batch_order").collect()
    assert {s: [x.sentence_id for x in g] for s, g in itertools.groupby(got, lambda x: x.quarter)} == {s: ids for s, (ids, _) in batch.items()}


def test_quotas_and_samples():
    assert W.allocate({1: 1, 2: 5, 3: 2, 4: 2}, 8, 2) == {1: 1, 2: 3, 3: 2, 4: 2}
    assert W.allocate({1: 10, 2: 10}, 5) == {1: 3, 2: 2}
    with pytest.raises(ValueError):
        W.allocate({1: 1}, 3, 1)
    assert W.sample_entities([3, 1, 2, 3], 2) == W.sample_entities([1, 2, 3], 2)
    assert W.irr_size({"A": 30, "S": 20, "I": 3}, 0.1, 5) == 13
    assert W.allocate_years({2020: 10, 2021: 1, 2022: 10}, 8) == {2020: 4, 2021: 1, 2022: 3}
    assert W.allocate_years({2020: 1}, 5) == {2020: 1} and W.allocate_years({}, 3) == {}
    rows = [{"id": i, "year": 2020 + i % 2, "label": ("Actionable", None)[i % 2 and 1], "bucket": i % 3, "edge": i % 5 == 0, "length_bin": "medium"} for i in range(40)]
    picked = W.greedy_sample(rows, 12, bucket_floor=2)
    assert len(picked) == 12 and sum(r["year"] == 2020 for r in picked) == 6 and {r["bucket"] for r in picked} == {0, 1, 2}
    assert picked == W.greedy_sample(rows[::-1], 12, bucket_floor=2) and len(W.greedy_sample(rows, 100)) == 40


CASES = [
    ("We plan to add a new feature soon.", (0.9, 0.1, 0.1), "Speculative", "force"),
    ("Short AI text", (0.1, 0.2, 0.9), "Irrelevant", "short"),
    ("Our data leakage policy covers every single vendor contract.", (0.9, 0.1, 0.1), "Irrelevant", "gate"),
    ("Outages prevent us from delivering the service to customers.", (0.1, 0.1, 0.1), "Actionable", "ops"),
    ("The group sold many machines in all the regions.", (0.40, 0.46, 0.1), "Speculative", "fine"),
    ("The group sold many machines in all the regions.", (0.5, 0.4, 0.1), "Actionable", "fine"),
    ("The group sold many machines in all the regions.", (0.6, 0.3, 0.59), "Irrelevant", "fine"),
    ("The group provides services including machine learning to banks.", (0.3, 0.4, 0.1), "Actionable", "fine"),
    ("The group sold many machines in all the regions.", (None, 0.4, 0.1), "ERROR", "fine"),
]


def test_rule_cascade(spark):
    df = frame(spark, "i int, x string, a double, s double, c double", [(i, x, *s) for i, (x, s, _, _) in enumerate(CASES)])
    rows = C.classify(df, "x", ("a", "s", "c")).orderBy("i").collect()
    assert [(r.label_pred, r.rule) for r in rows] == [(label, rule) for _, _, label, rule in CASES]
    assert rows[7].p_actionable == pytest.approx(0.42) and rows[0].p_speculative == 1.0 and rows[8].p_actionable is None
    plain = C.classify(df, "x", ("a", "s", "c"), two_stage=False, boosts=False).orderBy("i").collect()
    assert plain[2].rule == "fine" and plain[7].p_actionable == pytest.approx(0.3)


def test_boost_floors_fold_in_order(spark):
    x = "Applying these learnings, our future services based on AI may come."
    df = frame(spark, "x string, a double, s double, c double", [(x, 0.05, 0.2, 0.1)])
    new = C.boosted(F.col("x"), F.col("a"), F.col("s"), F.col("c"))
    r = df.select(*[v.alias(k) for k, v in new.items()]).first()
    assert (r.a, round(r.s, 9), round(r.i, 9)) == (0.0, 0.25, 0.32)


def test_regression_against_numpy(spark):
    r = np.random.default_rng(3)
    rows = []
    for firm in range(12):
        for year in range(2015, 2015 + (1 if firm == 0 else 4 + firm % 3)):
            x1, x2 = r.standard_normal(2)
            rows.append((f"f{firm:02}", year, float(1.5 * x1 - 0.5 * x2 + firm * 0.3 + (year - 2015) * 0.1 + r.standard_normal() * 0.2), float(x1), float(x2)))
    df = frame(spark, "firm string, year int, y double, x1 double, x2 double", rows + [("f01", 2030, None, 1.0, 1.0), ("f01", 2031, 1.0, float("inf"), 1.0)])
    fit = G.fe_ols(df, "y", ["x1", "x2"], "firm", "year")
    firms, years = sorted({x[0] for x in rows}), sorted({x[1] for x in rows})
    X = np.array([[1, x[3], x[4], *[x[0] == f for f in firms[1:]], *[x[1] == t for t in years[1:]]] for x in rows], float)
    y = np.array([x[2] for x in rows])
    inv = np.linalg.pinv(X.T @ X)
    beta = inv @ X.T @ y
    u = y - X @ beta
    groups = np.array([x[0] for x in rows])
    meat = sum(np.outer(s, s) for s in (X[groups == g].T @ u[groups == g] for g in firms))
    n, k, g = len(y), np.linalg.matrix_rank(X), len(firms)
    cov = g / (g - 1) * (n - 1) / (n - k) * inv @ meat @ inv
    assert fit.n == n and fit.coef == pytest.approx(beta[:3]) and fit.se == pytest.approx(np.sqrt(np.diag(cov)[:3]))
    slopes = G.within_ols(df, "y", ["x1", "x2"], "firm", "year")
    assert slopes.coef == pytest.approx(beta[1:3])
    table = G.run_models(df, {"a": ("y", ["x1"]), "gone": ("y", ["nope"])}, "firm", "year")
    assert {x.model for x in table.collect()} == {"a"} and G.journal_table(table).count() == 2


def test_models_of_many_entities_use_the_within_estimator(spark):
    r = np.random.default_rng(5)
    rows = [(f, t, float(f % 7), float(x), float(2 * x + f % 5 + 0.3 * t + r.standard_normal() * 0.1)) for f in range(30) for t in range(3) for x in r.standard_normal(1)]
    df = frame(spark, "firm int, year int, size double, x double, y double", rows)
    few = {(x.model, x.term): x for x in G.run_models(df, {"a": ("y", ["x"])}, "firm", "year").collect()}
    many = {(x.model, x.term): x for x in G.run_models(df, {"a": ("y", ["x"]), "b": ("y", ["x", "size"])}, "firm", "year", max_effects=20).collect()}
    assert set(many) == {("a", "x"), ("b", "x")}  # a constant of the entity is absorbed
    assert many["a", "x"].coef == pytest.approx(few["a", "x"].coef) and many["a", "x"].n == 90


def test_graphs(spark):
    nodes, edges = ["a", "b", "c", "d"], [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
    assert P.topological_order(nodes, edges) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        P.topological_order(["a", "b"], [("a", "b"), ("b", "a")])
    got = {r.id: (r.downstream, r.depth) for r in P.graph_metrics(spark, frame(spark, "parent string, child string", edges), frame(spark, "id string", [(n,) for n in nodes])).collect()}
    assert got == {"a": (3, 3), "b": (1, 2), "c": (1, 2), "d": (0, 1)}


def test_planner_columns(spark):
    cols = "deferred boolean, missing_dependencies int, policy_blocks int, failed_preconditions int, outputs_present boolean, failed_quality int, manual boolean"
    rows = [(True, 1, 0, 0, False, 0, False), (False, 1, 0, 0, False, 0, False), (False, 0, 1, 0, True, 0, False), (False, 0, 0, 0, True, 0, True), (False, 0, 0, 0, True, 1, True), (False, 0, 0, 0, False, 0, True), (False, 0, 0, 0, False, 0, False)]
    got = [r.status for r in P.readiness(frame(spark, cols, rows)).collect()]
    assert got == ["deferred", "waiting_on_deps", "blocked_precondition", "satisfied", "blocked_quality", "blocked_manual", "ready"]
    df = frame(spark, "a string, b string", [("2024-01-01T00:00:10", "2024-01-01T00:00:40"), ("2024-01-02T00:00:00", "2024-01-01T00:00:00"), ("bad", None)])
    assert [r[0] for r in df.select(P.duration_seconds(F.col("a"), F.col("b"))).collect()] == [30.0, 0.0, 0.0]
    docs = frame(spark, "doc_id int, text string", [(1, "# Head\nplain\nrisk one\n\nplain\n# Next\ngate two")])
    lines = {r.line: (r.section, r.is_risk) for r in P.document_lines(docs).collect()}
    assert lines["risk one"] == ("Head", True) and lines["gate two"] == ("Next", True) and lines["plain"] == ("Head", False)


def test_sensors(spark):
    df = frame(spark, "id int, year int, s string, j string", [(1, 2020, "A whole sentence stands here now.", '{"a": {"b": 3}}'), (2, 2021, "broken", None)])
    check = lambda kind, **k: P.sensor(df, kind, **k).first().passed
    assert check("row_count", operator=">=", value=2) and check("unique", columns=["id"]) and not check("column_values", column="year", allowed=[2020])
    assert check("fragment_rate", column="s", operator="<=", value=0.5) and check("json_field", column="j", field="a.b", value=3)
    assert check("required_columns", columns=["id", "s"]) and not check("years_present", column="year", years=[2020, 2022])


def test_profiles_shares_and_vectors(spark):
    df = frame(spark, "k string, x double, hit boolean", [("a", 1.0, True), ("a", 3.0, False), ("b", None, None)])
    p = {r.column: r for r in A.profile(df).collect()}
    assert (p["x"].n, p["x"].missing, p["x"].mean, p["x"].kind) == (2, 1, 2.0, "double") and p["k"].mean is None and p["k"].distinct == 2
    c = {r.k: (r.total, r.hits, r.share) for r in A.conditional_counts(df, ["k"], F.col("hit")).collect()}
    assert c == {"a": (2, 1, 0.5), "b": (1, 0, 0.0)}
    v = frame(spark, "s string", [("Deep learning, deep",), ("",), (None,)]).select(C.hashed_vector(F.col("s"), 16).alias("v")).collect()
    assert sum(v[0].v) == 3 and max(v[0].v) >= 2 and len(v[1].v) == 16 and sum(v[1].v) == 0 and sum(v[2].v) == 0
    e = C.embed(frame(spark, "s string", [("ab",), (None,)]), "s", lambda texts: [[float(len(t))] for t in texts])
    assert [r.embedding for r in e.collect()] == [[2.0], [0.0]]
    s = frame(spark, "d int", [(20,)]).select(P.phase_score(F.col("d"), F.lit(2), F.lit(1), F.lit("blocked_quality")).alias("s")).first().s
    assert s == 5 * 10 + 4 * 2 - 4 * 1 - 5
