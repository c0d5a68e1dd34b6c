"""Labelling operators and the evaluator's cascade."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import classify as C
from corpusloom.operators import labeling as L
from corpusloom.operators import sentences as S
from corpusloom.operators import windows as W


def test_suggestions_by_position_then_text(spark):
    s = spark.createDataFrame([("f", 1, "Alpha beta."), ("f", 2, "Gamma delta!"), ("f", 3, "ALPHA, beta"), ("f", 4, "none")], "file string, position int, sentence string")
    c = spark.createDataFrame([("f", 1, "other", "Actionable", 0), ("f", 2, "x", "ERROR", 0), ("f", None, "gamma delta", "Irrelevant", 1), ("f", 9, "alpha beta", "Speculative", 0), ("f", None, "alpha beta", "Irrelevant", 1)], "file string, position int, sentence string, label string, source_rank int")
    got = {r.position: r.label_suggested for r in L.suggest_labels(s, c).collect()}
    assert got == {1: "Actionable", 2: "Irrelevant", 3: "Speculative", 4: None}


def labelled(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, sentence_norm string, label string")


def test_exact_dedupe(spark):
    rows = [("1", "a", "Actionable"), ("2", "a", "Actionable"), ("3", "a", "Irrelevant"), ("4", "", "Actionable"), ("5", None, "Actionable"), ("6", "b", None), ("7", "b", "bad")]
    assert sorted(r.sample_id for r in L.dedupe_exact(labelled(spark, rows), ["sample_id"]).collect()) == ["1", "3"]


@pytest.mark.parametrize("second,kept,conflicts", [("Actionable", ["1"], 0), ("Irrelevant", [], 1)])
def test_near_dedupe(spark, second, kept, conflicts):
    rows = [("1", "the ai system for billing operations runs well", "Actionable"), ("2", "the ai systems for billing operations runs well", second)]
    out, bad = L.dedupe_near(labelled(spark, rows))
    assert sorted(r.sample_id for r in out.collect()) == kept and bad.count() == conflicts


def test_irr_subset():
    rows = [{"sample_id": f"{x}{y}{b}{k}", "label": x, "stratum": f"{y}|{b}"} for x in ("Actionable", "Speculative", "Irrelevant") for y in (2023, 2024) for b in (1, 2, 3) for k in range(3)]
    out = L.irr_subset(rows, 0.1, 5)
    assert len(out) == 15 and all(sum(r["label"] == x for r in out) == 5 for x in ("Actionable", "Speculative", "Irrelevant"))
    assert len({r["stratum"] for r in out}) == 6 and out == L.irr_subset(rows[::-1], 0.1, 5)
    assert L.irr_subset([]) == [] and len(L.irr_subset(rows, 0.5, 2)) == 27


def test_blinded_and_pending(spark):
    rows = spark.createDataFrame([("s1", "t1", "text", 2024, "10-K"), ("s2", "t2", "more", 2024, "10-K")], "sample_id string, sentence_id string, sentence string, source_year int, source_form string")
    sheet = L.blinded(rows)
    assert sheet.columns == ["irr_item_id", "sentence", "rater2_label", "rater2_note"] and len(L.blinded(rows, "partial").columns) == 6
    first = sheet.orderBy("sentence").first().irr_item_id
    filled = sheet.withColumn("rater2_label", F.when(F.col("irr_item_id") == first, "Actionable").otherwise(""))
    assert L.pending(sheet.select("irr_item_id"), filled).count() == 1


def test_first_eligible(spark):
    df = spark.createDataFrame([(2, 1), (1, 0), (3, None)], "k int, ok int")
    assert tuple(L.first_eligible(df, F.col("ok") == 1, ["k"]).select("k", "selection_fallback").first()) == (2, False)
    assert tuple(L.first_eligible(df, F.col("ok") == 9, ["k"]).select("k", "selection_fallback").first()) == (1, True)


def test_scores_and_replies(spark):
    rows = ['{"A": 0.1, "speculative": 0.2, "P_Irrelevant": 0.3}', '{"probs": {"a": 1, "S": 2}, "i": 3}', "not json", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    got = [tuple(r)[1:] for r in df.select("i", *[c.alias(n) for n, c in L.unpack_scores(F.col("x")).items()]).orderBy("i").collect()]
    assert got == [(0.1, 0.2, 0.3), (1.0, 2.0, 3.0), (None, None, None), (None, None, None)]
    good = '{"label": "Actionable", "confidence": "HIGH", "rationale": "r", "assistive_only": true}'
    replies = [good, f"```json\n{good}\n```", good.replace("true", "false"), good.replace("Actionable", "Other"), "nonsense", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(replies)], "i int, x string")
    assert [r.v for r in df.orderBy("i").select(L.parse_reply(F.col("x"))["valid"].alias("v")).collect()] == [True, True, False, False, False, False]


def test_evaluator_differs_from_the_cascade(spark):
    rows = [("Too short here", "gate"), ("Our heading ends with a colon and it is long:", "gate"), ("We will continue to grow the firm next year.", "force"), ("Outages prevent us from delivering the service to partners.", "ops"), ("The group sold many machines in all the regions.", "fine"), ("The laws cover privacy, taxes, cloud and many other topics among other things.", "gate")]
    df = spark.createDataFrame([(i, x, 0.1, 0.2, 0.9) for i, (x, _) in enumerate(rows)], "i int, x string, a double, s double, c double")
    out = C.classify_evaluator(df, "x", ("a", "s", "c"), boosts=True).orderBy("i").collect()
    assert [r.rule for r in out] == [rule for _, rule in rows]
    assert out[4].label_pred == "Speculative" and C.classify(df, "x", ("a", "s", "c")).where("i = 4").first().label_pred == "Irrelevant"


def test_panel_features(spark):
    p = spark.createDataFrame([(2, 1, 4, 0), (0, 3, 3, None), (None, None, 0, 2)], "n_A int, n_S int, n_total int, patents_ai int")
    r = W.panel_features(p).collect()
    assert [x.ActShare for x in r] == [0.5, 0.0, None] and [x.has_actionable for x in r] == [1, 0, 0] and [x.has_spec_only for x in r] == [0, 1, 0]
    only = W.panel_features(spark.createDataFrame([(0.1, 0.3)], "share_A double, share_S double")).first()
    assert only.SpecMinusAct == pytest.approx(0.2) and only.has_actionable is None


def test_checks_on_sentences(spark):
    df = spark.createDataFrame([("Fine.",), ("not fine.",), ("No end",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(S.incomplete(F.col("x"))).collect()] == [False, True, True, True, True]
    acc = S.merge_accounting(spark.createDataFrame([(10, 8, 9)], "segmented int, after_page int, after_sentence int")).first()
    assert (acc.page_merges, acc.sentence_merges) == (2, 0)


def test_paths_and_redaction_take_all_rows(spark):
    from types import SimpleNamespace

    from corpusloom.plans import label_queries as Q

    orders = spark.createDataFrame([(123456, 7), (9, 8), (10001, 7)], "o_orderkey long, o_custkey long")
    docs = spark.createDataFrame([(1, "a risk-free task"), (2, "key sk-" + "ab" * 12 + " here")], "doc_id long, text string")
    s8, s12 = (getattr(q, "__wrapped__", q) for q in (Q.s8_prefer_paths, Q.s12_redact))
    t = SimpleNamespace(spark=spark, orders=orders, documents=docs)
    assert {r.path for r in s8(t).collect()} == {"/r123456/2024/f7.txt", "/r00009/2024/f8.txt"}
    assert {r.doc_id: r.text for r in s12(t).collect()} == {1: "a risk-free task [REDACTED_SECRET] end", 2: "key [REDACTED_SECRET] here [REDACTED_SECRET] end"}
