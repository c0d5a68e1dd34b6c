"""Operators 6 and 7."""

import math

import numpy as np
import pytest
from oracle import DATA, compare

from corpusloom.llm import op6_topk as K
from corpusloom.llm import op7_licenses as L
from corpusloom.llm.queries import QUERIES, SQL


def vectors(spark, rows, extra=True):
    schema = "vec_id long, embedding array<float>" + (", slot string, score string, ids string" if extra else "")
    return spark.createDataFrame([(i, v, *(["x"] * 3 if extra else [])) for i, v in rows], schema).repartition(3)


def brute(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in ok if i % 50 == 0}:
        best = {}
        for i, v in ok:
            if i == q:
                continue
            for a in (v2 for j, v2 in ok if j == q and len(v2) == len(v)):
                s = int(a @ v)
                best[i] = max(best.get(i, s), s)
        for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, r, i, s))
    return out


@pytest.mark.parametrize("seed,ties", [(1, False), (2, True)])
def test_top_k_is_exact(spark, seed, ties):
    r = np.random.default_rng(seed)
    data = r.integers(-2, 3, (400, 8)).astype(float) / 4 if ties else r.standard_normal((400, 8))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]
    assert {tuple(x) for x in K.top_k_of_table(vectors(spark, rows)).collect()} == brute(rows)


def test_messy_vectors(spark):
    rows = [(0, [1.0, 0.5]), (50, [0.0, 0.0]), (1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [1.0]), (7, [-1.0, 2.0]), (7, [3.0, 1.0]), (8, [1.0, 0.5]), (8, [1.0, 0.5]), (None, [1.0, 1.0]), (100, [2.0])]
    assert {tuple(x) for x in K.top_k_of_table(vectors(spark, rows)).collect()} == brute(rows)
    assert K.top_k_of_table(vectors(spark, rows).where("false")).count() == 0


def test_threshold_algorithm_stops_early():
    n = 4000
    rows = np.zeros((n, 4), int)
    rows[:, 0] = np.arange(n)
    shard = K.Shard(np.arange(n), rows)
    best, read = shard.top(np.array([[1, 0, 0, 0], [2, 0, 0, 0]]), np.array([-1, n - 1]))
    assert [b.tolist() for b in best] == [[n - 1 - i for i in range(5)], [n - 2 - i for i in range(5)]]
    assert read < 100


def test_op6_over_many_cells(spark):
    """Several groups of shards and of queries, vectors of two lengths and repeated ids give what one cell gives."""
    r = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in r.normal(0, 0.3, 8 if i % 7 else 5)]) for i in range(600)] + [(50, [0.1] * 8), (51, [0.9] * 8)]
    df = vectors(spark, rows).repartition(9)
    got = K.exact_top_k(df, df.where("vec_id % 50 = 0"), group=100, many=3)
    assert {tuple(x) for x in got.collect()} == brute(rows)


def test_op6_matches_sql(spark):
    assert compare(QUERIES["op6_topk_ta"](spark, DATA), SQL["op6_topk_ta"]) is None


PROSE = "The meeting began at nine and ended at noon. Nobody mentioned a licence agreement of any kind."


def files(spark, rows):
    return spark.createDataFrame([(k, p, t, "x", "y") for k, (p, t) in enumerate(rows)], "key long, path string, text string, licence string, fid string").repartition(3)


ROWS = [
    ("a/LICENSE", "MIT\n\nReleased under the MIT License.\n"),
    ("a/x.txt", PROSE),
    ("a/b/c/y.txt", "no notice"),
    ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."),
    ("a/b/z.txt", "Released under the MIT License.\n" + PROSE),
    ("d/e.txt", "This work is licensed under the GNU General Public License, version 3."),
    ("d/f.txt", None),
    ("top.txt", ""),
    (None, "Licensed under CC BY-NC 4.0."),
    (None, "nothing"),
    ("a/x.txt", PROSE),
    ("ab/x.txt", PROSE),
    ("m/LICENSE.txt", "Copyright 2020 The Authors\n\n" + dict(L.TEXTS)["MIT"].replace(". ", ".\n")),
    ("m/y.txt", "plain"),
    ("v.txt", "Licensed under the Apache License, Version 1.1"),
    ("two.txt", "under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."),
]


def plain(rows):
    """Whole scan by plain loops."""
    import re

    terms = lambda s: re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", s.lower())
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def best(headers, table):
        n, df, out = len(table), {}, []
        for _, t in table:
            for w in set(terms(t)):
                df[w] = df.get(w, 0) + 1
        vec = lambda s: {w: terms(s).count(w) * (math.log((1 + n) / (1 + df.get(w, 0))) + 1) for w in terms(s)}
        for v in map(vec, headers):
            for name, t in table:
                u = vec(t)
                score = round(sum(v[w] * u.get(w, 0) for w in v) / (norm(v) or 1) / norm(u), 6)
                if score >= L.COSINE and len(v.keys() & u.keys()) > 1:
                    out.append((-score, name))
        return out

    own = []
    for path, text in rows:
        pieces = [p for p in re.sub(L._SENTENCE_END, "\\1\n", text or "").split("\n") if re.search("[A-Za-z0-9]", p)]
        spans = {(a, b) for i, p in enumerate(pieces) if re.search(L.ANCHOR, p) for a in range(max(0, i - 3), i + 1) for b in range(i + 1, min(len(pieces), a + 4) + 1)}
        hits = best([" ".join(pieces[a:b]) for a, b in spans], L.NOTICES)
        if path and re.search(L._NAME, path.rpartition("/")[2]):
            hits += best([text or ""], L.TEXTS)
        own.append((min(hits)[1], -min(hits)[0]) if hits else None)
    folder = lambda p: p.rpartition("/")[0]
    declared = {}
    for (p, _), b in zip(rows, own, strict=True):
        if b and p and p.rpartition("/")[2].split(".")[0] in L.LICENCE_FILES:
            declared[folder(p)] = min(declared.get(folder(p), b), b, key=lambda x: (-x[1], x[0]))
    out = []
    for k, ((p, _), b) in enumerate(zip(rows, own, strict=True)):
        if b:
            out.append((k, p, *b, "own", None))
            continue
        d = folder(p) if p else None
        while d and d not in declared:
            d = folder(d)
        out.append((k, p, *declared[d], "inherited", d) if p and d in declared else (k, p, None, None, "none", None))
    return out


def test_licences_and_inheritance(spark):
    got = sorted(tuple(r) for r in L.license_scan(files(spark, ROWS)).collect())
    assert got == sorted(plain(ROWS))
    by = {r[0]: r for r in got}
    assert by[1][2:3] == ("MIT",) and by[2][2] == "Apache-2.0" and by[4][4] == "own" and by[11][4] == "none"
    assert by[13][2:5] == ("MIT", by[12][3], "inherited") and by[12][3] > 0.9 and by[14][2] == "Apache-1.1" and by[15][2] == "GPL-2.0"


def test_licences_without_files(spark):
    assert L.license_scan(files(spark, ROWS).where("false")).count() == 0


def test_licences_over_several_lines(spark):
    rows = [
        ("m.c", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this file */"),
        ("g.c", "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
        ("s.c", "// SPDX-License-Identifier: MIT"),
        ("l.txt", PROSE + " It is released under the MIT License. " + PROSE),
        ("p/LICENSE", "\n   Apache License\n   Version 2.0, January 2004\n   http://www.apache.org/licenses/\n"),
        ("p/q.txt", PROSE),
        ("i.c", "SPDX-License-Identifier: (ISC OR nothing)"),
        ("u.c", "SPDX-License-Identifier: Unknown-9"),
    ]
    got = {r["path"]: (r["licence"], r["found"]) for r in L.license_scan(files(spark, rows)).collect()}
    assert got == {"m.c": ("MPL-2.0", "own"), "g.c": ("GPL-3.0", "own"), "s.c": ("MIT", "own"), "l.txt": ("MIT", "own"), "p/LICENSE": ("Apache-2.0", "own"), "p/q.txt": ("Apache-2.0", "inherited"), "i.c": ("ISC", "own"), "u.c": (None, "none")}


def test_licences_of_the_root_and_other_names(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("LICENSE.txt", mit), ("src/x.py", PROSE), ("src/lib/COPYING.LESSER", gpl), ("src/lib/a/y.py", PROSE), ("/src/x.py", PROSE), ("/abs/license", gpl), ("/abs/b/x.py", PROSE), (None, PROSE)]
    got = {r["key"]: (r["licence"], r["found"], r["origin"]) for r in L.license_scan(files(spark, rows)).collect()}
    assert got[1] == ("MIT", "inherited", "") and got[3] == ("GPL-3.0", "inherited", "src/lib")
    assert got[4] == (None, "none", None) and got[6] == ("GPL-3.0", "inherited", "/abs") and got[7] == (None, "none", None)


def test_op7_matches_sql(spark):
    assert compare(QUERIES["op7_licenses_tfidf"](spark, DATA), SQL["op7_licenses_tfidf"]) is None
