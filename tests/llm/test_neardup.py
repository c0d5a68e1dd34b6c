"""Operator 3 against all pairs, with hot groups, chains and messy rows."""

import random
from collections import Counter

import numpy as np
import pytest
from helpers import MESSY, WORD, documents
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch
from corpusloom.llm.components import components
from corpusloom.llm.op3_neardup import agree, keep_one_of_each, linked_groups, near_duplicates, shingle_sets, survivors


def shingles(text, width=2):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def brute(rows, width=2):
    """{doc_id: component} by comparing all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}


def near_copies(n, seed, words=120, edits=4):
    r = random.Random(seed)
    base = [f"w{r.randrange(900)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        x = list(base)
        for _ in range(r.randrange(1, edits + 1)):
            x[r.randrange(words)] = f"v{r.randrange(10**6)}"
        out.append(" ".join(x))
    return out


def check(spark, rows, width=2):
    got = near_duplicates(spark, documents(spark, rows), width).collect()
    want = brute(rows, width)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], r.doc_id == want[r.doc_id]), r
    return got


def test_messy_rows(spark):
    got = check(spark, MESSY)
    n = {r.doc_id: r.n_shingles for r in got if r.doc_id not in (None, 14)}
    assert n == {i: len(shingles(t)) for i, t in MESSY if i not in (None, 14)}


def test_groups_of_copies_and_near_copies(spark):
    texts = near_copies(150, 1, edits=14) + near_copies(5, 2) + near_copies(2, 3) + [f"single text number {i} stands alone here {i * 7}" for i in range(40)]
    texts += [texts[0]] * 60 + ["", None, "same"] + ["same"] * 20
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    check(spark, rows)


def test_common_passage_does_not_link(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"own{i}x{k}" for k in range(60))) for i in range(300)]
    check(spark, rows)


def test_chain(spark):
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(12):
        rows.append((20 - i, " ".join(words)))
        for k in range(4):
            words[(i * 4 + k) * 2 % 100] = f"n{i}x{k}"
    check(spark, rows)


def test_five_word_shingles(spark):
    check(spark, list(enumerate(near_copies(20, 9, words=300, edits=12))), width=5)


def test_empty_table(spark):
    assert near_duplicates(spark, documents(spark).where("false")).count() == 0


def test_keep_one_of_each(spark):
    docs = documents(spark)
    kept = keep_one_of_each(spark, docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect())
    first = {i for i, c in brute(MESSY).items() if i == c}
    # of a kept doc_id all texts stay, equal rows once; rows without one all stay
    assert got == Counter({(i, t) for i, t in MESSY if i in first}) + Counter((i, t) for i, t in MESSY if i is None)


def test_large_families_against_all_pairs(spark):
    """Families of hundreds of different near copies: dense ones, ones on both sides of the threshold, chains, and a passage
    that unlinked texts share."""
    r = random.Random(21)
    texts = near_copies(700, 31, 120, 5)
    texts += near_copies(500, 32, 120, 14)  # about half of their pairs fall short of 0.8
    chain = near_copies(1, 33, 150)[0].split()
    for _ in range(200):
        chain[r.randrange(150)] = f"c{r.randrange(10**6)}"
        texts.append(" ".join(chain))
    shared = near_copies(1, 34, 100)[0]
    texts += [shared + " " + near_copies(1, 100 + k, 45)[0] for k in range(300)]  # similar by 0.5 only
    texts += [near_copies(1, 1000 + k, r.randrange(1, 60))[0] for k in range(800)]
    texts += r.choices(texts, k=500)
    r.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components(Scratch(spark, "t"), df, "x").collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}}
    assert components(Scratch(spark, "t"), df.where(F.lit(False)), "x").count() == 0


def test_kernels():
    sets = shingle_sets([" ".join(near_copies(1, s)[0].split()) for s in (1, 1, 2)])
    assert linked_groups(sets).tolist() == [0, 0, 2]
    r = np.random.default_rng(1)
    sig = r.integers(0, 60000, (6, 128)).astype(np.uint16)
    sig[3] = sig[0]
    assert survivors(sig[:3], sig[3:], np.array([0, 1, 2]), np.array([3, 4, 5])) == [(0, 0)]


def test_collisions_are_counted():
    """A pair needs AGREE equal coordinates and MATCHES equal minima."""
    a = np.arange(128, dtype=np.uint16)
    broken = a.copy()
    broken[::4] += 1000  # 96 minima agree, no coordinate of four does
    one, two = broken.copy(), broken.copy()
    one[0], two[[0, 4]] = a[0], a[[0, 4]]
    far = np.full(128, 9999, np.uint16)
    far[:40] = a[:40]
    assert [bool(agree(a, x)) for x in (a, broken, one, two, far)] == [True, False, False, True, False]


@pytest.mark.parametrize("inter,union,linked", [(4, 5, True), (79, 100, False), (80, 100, True)])
def test_threshold_is_exact(inter, union, linked):
    a, b = np.arange(inter + (union - inter) // 2, dtype=np.uint64), np.concatenate((np.arange(inter), np.arange(1000, 1000 + union - inter - (union - inter) // 2))).astype(np.uint64)
    assert (linked_groups([a, np.sort(b)])[1] == 0) == linked
