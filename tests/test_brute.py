"""Queries that SQL can't express, compared with plain Python on the same tables."""

import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from oracle import DATA

from corpusloom.functions import text as T
from corpusloom.operators import classify as C
from corpusloom.operators import labeling as L
from corpusloom.operators import planner as P
from corpusloom.operators import sentences as S
from corpusloom.operators import windows as W
from corpusloom.operators.neardup import Bounds, _meetings, _posts, _segment_marks, candidate_pairs, near_text_pairs, passes, ratio
from corpusloom.plans import QUERIES
from pyspark.sql import functions as F


def table(name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM read_parquet('{DATA}/{name}.parquet')").fetchall()


def sentences(text):
    flat = re.sub(" {2,}", " ", re.sub("[ \t]", " ", text or ""))
    return [s for s in (p.strip() for p in re.split(r"(?<=[.?!])\s+(?=[A-Z(])", flat)) if s]


def norm(s):
    return " ".join(re.sub(r"[^\w\s]+", " ", s.lower()).split())


def test_f1_against_all_pairs(spark):
    rows = {(d, k): norm(s) for d, t in table("documents", "doc_id, text") for k, s in enumerate(sentences(t), 1)}
    rows = {i: s for i, s in rows.items() if s}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    texts = sorted(first, key=first.get)
    size = np.array([len(s) for s in texts])
    letters = sorted({c for s in texts for c in s})
    bag = np.array([[s.count(c) for c in letters] for s in texts])
    links = Counter()
    for i in range(len(texts)):
        edits = 0.05 * (size[i] + size[i + 1 :]) + 1e-9
        near = np.flatnonzero(np.abs(size[i] - size[i + 1 :]) <= edits) + i + 1
        near = near[np.abs(bag[near] - bag[i]).sum(1) <= 0.05 * (size[i] + size[near]) + 1e-9]
        for j in near.tolist():
            if ratio(texts[i], texts[j]) >= 0.95:
                links[texts[i]] += 1
                links[texts[j]] += 1
    want = {(*i, *first[s], links[s]) for i, s in rows.items()}
    got = {tuple(r) for r in QUERIES["f1_near_duplicate_pairs"](spark, DATA).select("doc_id", "sentence_index", "class_doc_id", "class_sentence_index", "links").collect()}
    assert got == want and sum(links.values()) > 0


def test_segments_at_every_length(spark):
    """One edit more than a text has disjoint segments is needed to break them all."""
    b = Bounds(0.95)
    for n in range(10, 3000):
        band = int(b.band(np.array([n]))[0])
        assert n // b.segment(band) >= int(b.edits(np.array([n]))[0]) + 1
    base = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(400))
    texts = [base[:n] for n in (10, 19, 20, 21, 60, 61, 64, 200, 399, 400)] + [base[:60].replace("a", "", 1), base[1:200], base[:100] + "x" + base[100:200], "aaaa" * 20, "aaaa" * 20 + "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    got = {(r.id_a, r.id_b) for r in near_text_pairs(df).collect()}
    assert got == {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if ratio(texts[i], texts[j]) >= 0.95}


def test_texts_with_a_common_phrase_do_not_all_meet(spark):
    """1,000 different texts share a phrase, at all places: half a million pairs would meet by it, and only near ones may leave the join."""
    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))
    texts = [words(k % 8) + " in accordance with the terms of " + words(12 - k % 8) for k in range(1000)]
    texts += [t[:40] + "xy" + t[41:] for t in texts[:30]] + ["qz" + t[:-3] for t in texts[30:60]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    assert _meetings(df, Bounds(0.95), 0.95).count() < 5000
    near = {(k, 1000 + k) for k in range(60)}
    got = {(x.id_a, x.id_b) for x in near_text_pairs(df).collect()}
    assert got == {(i, j) for i, j in near if ratio(texts[i], texts[j]) >= 0.95} and len(got) == 60


def test_bands_in_passes_lose_no_pair(spark):
    """Edits gathered at the start, at the end or anywhere, at many lengths, joined a band or two at a time."""
    r = random.Random(11)
    letters = lambda n: "".join(r.choice("abcdef ") for _ in range(n))
    texts = []
    for n in (10, 19, 28, 40, 57, 80, 113, 160, 240, 420):
        for kind in range(6):
            base = letters(n)
            d = int(0.1 * n)
            cut = r.randint(0, d)
            spots = sorted(r.sample(range(n), cut), reverse=True) if kind > 3 else []
            near = {0: letters(d) + base, 1: base + letters(d), 2: base[d:], 3: letters(d // 2) + base[: n - (d - d // 2)]}.get(kind, base)
            for k in spots:
                near = near[:k] + (near[k + 1 :] if kind == 4 else "zz" + near[k + 1 :])
            texts += [base, near]
    texts = list(dict.fromkeys(texts))
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if max(ratio(texts[i], texts[j]), ratio(texts[j], texts[i])) >= 0.95}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    rows = candidate_pairs(df, 0.95, parts=6, least=100).collect()
    assert len(want) >= 20 and want <= {(x.id_a, x.id_b) for x in rows} and len(rows) == len({(x.id_a, x.id_b) for x in rows})


def test_posts_of_a_pass_are_bounded(spark):
    """Substrings that are nobody's segment aren't posted, and no pass has more than its share if more than a band."""
    r = random.Random(12)
    df = spark.createDataFrame([(k, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100 + k % 60))) for k in range(400)], "id long, s string")
    b = Bounds(0.95)
    marks = spark.sparkContext.broadcast(_segment_marks(df, b, None, 400 * 17))
    of = lambda *a: df.mapInArrow(_posts(b, *a), "key long, id long, size int, rough long").count()
    assert of(False, None, marks) < of(False) / 3  # own segments at least
    texts_of = {k: 1000 for k in range(20, 60)}
    cut = passes(b, texts_of, 10, 1)
    assert [k for low, high in cut for k in range(low, high + 1)] == list(range(20, 61))
    work = [sum(b.posts(k) * (texts_of.get(k, 0) + texts_of.get(k - 1, 0)) for k in range(low, high + 1)) for low, high in cut]
    assert all(w <= sum(work) / 10 for w, (low, high) in zip(work, cut, strict=True) if high > low)


def test_e7_against_plain_vectors(spark):
    pattern = re.compile(S.keyword_pattern(list(S.AI_KEYWORDS)))
    vectors = []
    for lang, text in table("documents", "lang, text"):
        for s in sentences(text):
            if len(s) >= 4 and pattern.search(s):
                v = np.zeros(64)
                for w in norm(s).split():
                    h = xxhash.xxh64_intdigest(w.encode(), 42)
                    v[(h - (1 << 64) if h >> 63 else h) % 64] += 1
                vectors.append((lang, v))
    centroid = {x: np.mean([v for k, v in vectors if k == x], 0) for x in sorted({k for k, _ in vectors})}
    cosine = lambda a, b: a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)
    want = Counter((k, max(centroid, key=lambda c: (round(cosine(v, centroid[c]), 12), [-ord(z) for z in c]))) for k, v in vectors if v.any())
    got = {(r.label, r.nearest): r.n for r in QUERIES["e7_hashed_centroids"](spark, DATA).where("nearest is not null").collect()}
    assert got == dict(want)


def test_f2_against_dense_dummies(spark):
    sums = {}
    for c, y, price in table("orders", "o_custkey, year(o_orderdate), o_totalprice"):
        a = sums.setdefault((c, y), [0.0, 0])
        a[0] += price
        a[1] += 1
    keys = sorted(sums)
    firms, years = sorted({k for k, _ in keys}), sorted({y for _, y in keys})
    y = np.array([math.log(round(sums[k][0], 2)) for k in keys])
    x = np.array([[1, sums[k][1], *(k[0] == f for f in firms[1:]), *(k[1] == z for z in years[1:])] for k in keys], float)
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    u = y - x @ beta
    meat = np.zeros_like(inverse)
    for f in firms:
        own = np.array([k[0] == f for k in keys])
        g = x[own].T @ u[own]
        meat += np.outer(g, g)
    n, rank, many = len(y), np.linalg.matrix_rank(x), len(firms)
    se = np.sqrt(np.diag(inverse @ meat @ inverse) * many / (many - 1) * (n - 1) / (n - rank))
    got = {(r.model, r.term): r for r in QUERIES["f2_fe_ols"](spark, DATA).collect()}
    r = got["m1", "orders"]
    assert (r.coef, r.se, r.n) == (pytest.approx(beta[1], abs=2e-6), pytest.approx(se[1], abs=2e-6), n)


def test_f3_against_plain_repair(spark):
    want = {}
    for d, t in table("documents", "doc_id, text"):
        t = re.sub(r"^([^\n]{20,60}) ", r"\1 — 4 — ", t or "", count=1)
        want[d] = len(S.repair_page_breaks(sentences(t), t)) if re.search(T.PAGE_MARKER, t) else len(sentences(t))
    assert {r.doc_id: r.n for r in QUERIES["f3_page_breaks"](spark, DATA).collect()} == want


def test_q4_sees_what_all_rows_would_show(spark):
    draw = {r.id: r.d for r in spark.read.parquet(f"{DATA}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.xxhash64(F.col("o_orderkey").cast("string"), F.lit(13)).alias("d")).collect()}
    label = {"F": "Actionable", "O": "Speculative"}
    rows = [{"id": k, "year": y, "label": label.get(s), "bucket": p[0], "edge": k % 9 == 0, "length_bin": "short" if k % 5 == 0 else "long", "draw": draw[k]} for k, y, s, p in table("orders", "o_orderkey, year(o_orderdate), o_orderstatus, o_orderpriority")]
    want = {r["id"]: k for k, r in enumerate(W.greedy_sample(rows, 200, 40), 1)}
    assert {r.id: r.pick_order for r in QUERIES["q4_priority_sample"](spark, DATA).collect()} == want and len(want) == 200


def test_q5_sees_what_all_rows_would_show(spark):
    draw = {r.id: r.d for r in spark.read.parquet(f"{DATA}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.xxhash64(F.col("o_orderkey").cast("string"), F.lit(13)).alias("d")).collect()}
    label = {"F": "Actionable", "O": "Speculative"}
    rows = [{"sample_id": k, "label": label.get(s, "Irrelevant"), "stratum": f"{y}|{p}", "draw": draw[k]} for k, y, s, p in table("orders", "o_orderkey, year(o_orderdate), o_orderstatus, o_orderpriority")]
    assert {r.sample_id for r in QUERIES["q5_irr_sample"](spark, DATA).collect()} == {r["sample_id"] for r in L.irr_subset(rows, 0.01, 20)}


def test_irr_sample_of_many_picks_and_cells(spark):
    """40 cells of very unequal size and 30,000 picks: more than a million rows if each cell gave as many as are picked."""
    k = F.col("id")
    label = F.when(k % 50 == 0, "Irrelevant").when(k % 3 == 0, "Actionable").otherwise("Speculative")
    stratum = F.when(k % 7 < 4, F.lit("s0")).otherwise(F.concat(F.lit("s"), (k % 20).cast("string")))
    df = spark.range(60_000).select(k.alias("sample_id"), label.alias("label"), stratum.alias("stratum"))
    rows = [r.asDict() for r in df.withColumn("draw", F.xxhash64(F.col("sample_id").cast("string"), F.lit(13))).collect()]
    want = {r["sample_id"] for r in L.irr_subset(rows, 0.5, 20)}
    got = [r.sample_id for r in L.irr_sample(df, 0.5, 20).collect()]
    assert set(got) == want and len(got) == len(want) == 30_000


@pytest.mark.parametrize("name", ["concreteness", "hashed_vector"])
def test_work_on_a_sentence_is_in_proportion_to_its_words(spark, name):
    """20,000 words in one sentence: their tokens are made once, not once for each word or bucket."""
    words = ["of", "AI", "may", "is", "x1"]
    text = " ".join(words * 4000)
    use = {"concreteness": lambda x: S.concreteness(x, ["of", "ai may"], ["is"]), "hashed_vector": lambda x: C.hashed_vector(x)}[name]
    one = spark.createDataFrame([(text,)], "sentence string").repartition(2)
    begin = time.monotonic()
    got = one.select(use(F.col("sentence")).alias("x")).first()["x"]
    assert time.monotonic() - begin < 20
    if name == "concreteness":
        assert got["concrete"] == 8000 and got["vague"] == 4000 + got["fuzzy"] and got["score"] == got["concrete"] / (got["concrete"] + got["vague"])
    else:
        assert sum(got) == 20_000 and len(got) == 64 and sum(x > 0 for x in got) <= 5


def test_many_paths_cost_nothing(spark):
    edges = [e for k in range(40) for e in ((f"n{k:02d}", f"a{k:02d}"), (f"n{k:02d}", f"b{k:02d}"), (f"a{k:02d}", f"n{k + 1:02d}"), (f"b{k:02d}", f"n{k + 1:02d}"))]
    nodes = sorted({x for e in edges for x in e})
    frame = lambda schema, rows: spark.createDataFrame(rows, schema)
    got = {r.id: (r.downstream, r.depth) for r in P.graph_metrics(spark, frame("parent string, child string", edges), frame("id string", [(n,) for n in nodes])).collect()}
    assert got["n00"] == (120, 81) and got["n40"] == (0, 1) and got["a39"] == (1, 2)
    with pytest.raises(ValueError, match="cycle"):
        P.graph_metrics(spark, frame("parent string, child string", [*edges, ("n40", "n00")]), frame("id string", [(n,) for n in nodes]))
    with pytest.raises(ValueError, match="at most"):
        P.graph_metrics(spark, frame("parent string, child string", edges), frame("id string", [(n,) for n in nodes]), limit=10)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 133, 20_001])
def test_percentiles_are_exact(spark, n):
    values = [((k * 7919) % 5003) / 7 - 100 if k % 3 else 1.5 for k in range(n)] + [None]
    df = spark.createDataFrame([(k % 2, v) for k, v in enumerate(values)], "g int, x double")
    shares = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    for group in (None, "g"):
        got = {r[0] if group else 0: r["_q"] for r in W.interpolated_percentiles(df, "x", shares, group).collect()}
        for g in got:
            own = [v for k, v in enumerate(values) if v is not None and (group is None or k % 2 == g)]
            if not own:
                assert group is None and got[g] == [None] * len(shares)
                continue
            assert got[g] == pytest.approx(np.percentile(own, [100 * p for p in shares]).tolist(), abs=1e-9)
        assert len(got) == (len({k % 2 for k, v in enumerate(values) if v is not None}) if group else 1)
