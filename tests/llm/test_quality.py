"""Operators 4 and 10: gradients, base rules, decoding and held-out accuracy."""

import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from helpers import MESSY, OTHER, PROSE, WORD, documents, labelled_documents, labels

from corpusloom.llm import op4_quality as Q
from corpusloom.llm import op10_rules as R
from corpusloom.llm.training import Sample, labelled_sample


def test_network_gradients_match_differences():
    r = np.random.default_rng(1)
    texts = [bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 3, 4, 127, 128, 300, 1000)]
    w = {k: v.astype(np.float64) for k, v in Q.initial().items()}
    z, y, weight = Q._Layout(texts), np.array([0, 1] * 4), np.ones(8)

    def loss():
        p = Q._forward(w, z)["p"]
        return float(-(np.log(np.where(y == 1, p, 1 - p)) * weight / weight.sum()).sum())

    g = Q._grads(w, z, y, weight)
    for k in w:
        at = tuple(r.integers(0, n) for n in w[k].shape)
        if k == "embed":
            at = (int(z.cells[40, 1]), 2)
        keep, step = w[k][at], 1e-5
        w[k][at] = keep + step
        up = loss()
        w[k][at] = keep - step
        down = loss()
        w[k][at] = keep
        assert abs((up - down) / (2 * step) - g[k][at]) < 2e-4, k


def plain_score(w, text):
    """The network by loops: every filter at every fourth byte, chunks of 64 positions that overlap by half."""
    padded = text + bytes(max(2 * Q.STEP, -(-(len(text) + Q.STEP) // Q.STEP) * Q.STEP) - len(text))
    kernel = np.concatenate((w["near"], w["far"])).reshape(2 * Q.STEP, Q.EMBED, Q.FILTERS)
    values = []
    for at in range(0, len(padded) - 2 * Q.STEP + 1, Q.STEP):
        window = [w["embed"][b].astype(float) for b in padded[at : at + 2 * Q.STEP]]
        values.append([max(0.0, sum(float(window[j] @ kernel[j, :, f]) for j in range(2 * Q.STEP)) + float(w["lift"][f])) for f in range(Q.FILTERS)])
    starts = range(0, max(1, len(values) - Q.HALF), Q.HALF)
    pooled = np.array([np.max(values[s : s + 2 * Q.HALF], axis=0) for s in starts])
    logit = np.concatenate((pooled.max(0), pooled.mean(0))) @ w["out"] + float(w["bias"][0])
    return 1 / (1 + np.exp(-logit))


def test_scores_are_those_of_a_plain_convolution():
    r = np.random.default_rng(3)
    w = {k: v + r.normal(0, 0.1, v.shape).astype(np.float32) for k, v in Q.initial().items()}
    texts = [b"", b"a", b"abcd", b"abcde", bytes(r.integers(0, 256, 126).tolist()), *(bytes(r.integers(32, 127, n).tolist()) for n in (127, 128, 129, 131, 132, 133, 255, 256, 257, 260, 261, 383, 384, 385, 700, 1111))]
    want = [plain_score(w, t) for t in texts]
    assert np.allclose(Q.score(w, texts), want, atol=1e-5)
    assert np.allclose(Q.score(w, texts, block=2), want, atol=1e-5)
    assert np.allclose([Q.score_long(w, t, 1) for t in texts[3:]], want[3:], atol=1e-5)


def test_scores_do_not_depend_on_the_batch():
    w = Q.initial()
    texts = [(PROSE * k).encode() for k in range(6)]
    whole = Q.score(w, texts)
    assert np.allclose(whole, [Q.score(w, [t])[0] for t in texts], atol=1e-5)
    # a change at the very end of a long text is seen
    long = b"plain words here " * 5000
    assert Q.score(w, [long])[0] != Q.score(w, [long + b"\x00\xff$$$!!"])[0]


def _train_rows():
    return MESSY + labelled_documents()


def test_op4(spark):
    rows = Q.quality_scores(documents(spark, _train_rows()), labels(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in _train_rows())
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    ho = [r for r in rows if r.held_out and r.doc_id and 100 <= r.doc_id < 300]
    assert np.mean([r.predicted == (r.doc_id < 200) for r in ho]) >= 0.9


def test_sample_leaves_out_held_out_rows(spark):
    sample = labelled_sample(documents(spark, _train_rows()), labels(spark))
    held = {t for i, t in labelled_documents() if zlib.crc32(str(i).encode()) % 5 == 0}
    assert held and not held & {t for t, _ in sample.rows} and len(sample.rows) > 30 and 0.4 < sample.share < 0.6
    assert len(labelled_sample(documents(spark, _train_rows()), labels(spark), rows_per_label=5).rows) == 10


def test_without_labels(spark):
    none = labels(spark).where("false")
    rows = Q.quality_scores(documents(spark), none).collect()
    assert {r.score for r in rows} == {1.0}
    kept = {r.doc_id for r in R.quality_rules(documents(spark), none).collect() if r.kept}
    assert 13 in kept and 5 not in kept


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_op10_base_rules(spark):
    rows = _train_rows() + [(900, "x\ny\nx\nx \n\n\nx\r\n| # * $ % & < >"), (901, " ".join(["a b c d e f g h"] * 5) + " z" * 3)]
    got = R.quality_rules(documents(spark, rows), labels(spark)).collect()
    fields = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert Counter((r.doc_id, *fields(r)) for r in got) == Counter((i, *base(t)) for i, t in rows)
    assert not any(r.kept and r.base_failed for r in got)
    clean = [r.kept for r in got if r.doc_id and 100 <= r.doc_id < 130]
    bad = [r.kept for r in got if r.doc_id and 200 <= r.doc_id < 230]
    assert all(clean) and not any(bad)


def _tiny():
    z = R.Lines(["a b\nC!\n|", "x", "", "p\nq\nr\ns"])
    r = np.random.default_rng(2)
    model = {"emit": r.standard_normal((R.N_FEATURES, 2)), "start": r.standard_normal(2), "move": r.standard_normal((2, 2))}
    return z, model


def _chain_score(z, model, doc, states):
    lines = range(z.first[doc], z.first[doc] + z.count[doc])
    s = model["start"][states[0]] + sum(z.features[i] @ model["emit"][:, k] for i, k in zip(lines, states, strict=True))
    return s + sum(model["move"][a, b] for a, b in zip(states[:-1], states[1:], strict=True))


def test_viterbi_is_the_best_path():
    z, model = _tiny()
    path = R.viterbi(z, model)
    for d in range(4):
        best = max(product((0, 1), repeat=int(z.count[d])), key=lambda s: _chain_score(z, model, d, s))
        assert tuple(path[z.first[d] : z.first[d] + z.count[d]]) == best


def test_lines_of_both_states_in_a_text():
    """Chains with boilerplate inside good text: the decoded path is the best of all, and the share of words decides."""
    import itertools

    rows = [(t, int(i < 200)) for i, t in labelled_documents()]
    good, bad = [t for t, q in rows if q], [t for t, q in rows if not q]
    mixed = [(good[k] + "\n" + "\n".join(bad[(k + j) % len(bad)] for j in range(2)), 0) for k in range(20)]
    model = R.fit([(a + "\n" + b, 1) for a, b in zip(good, good[1:], strict=False)] + mixed + [(b, 0) for b in bad])
    cases = [[good[0], good[1], bad[2], good[3], good[4]], [bad[0], bad[1], good[2]], [good[5], bad[5], bad[6], bad[7]], [good[8]], [bad[9], bad[10]]]
    for lines in cases:
        text = "\n".join(lines)
        z = R.Lines([text])
        unary = z.features @ model["emit"]
        value = lambda p: model["start"][p[0]] + sum(unary[i, x] for i, x in enumerate(p)) + sum(model["move"][a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(lines)), key=value)
        assert R.viterbi(z, model).tolist() == list(best) == [int(x in good) for x in lines]
        words = [len(x.split()) for x in lines]
        share = sum(w for w, s in zip(words, best, strict=True) if s) / sum(words)
        out = R.verdicts([text], model)
        assert out["content_share"][0] == pytest.approx(share) and out["kept"][0] == (not out["base_failed"][0] and share >= 0.5)


def test_crf_gradient_matches_enumeration():
    z, model = _tiny()
    y, weight = np.array([0, 1, 1, 0, 1, 0, 0, 1, 1]), np.ones(4)

    def loss():
        total = 0.0
        for d in range(4):
            gold = tuple(y[z.first[d] : z.first[d] + z.count[d]])
            every = [_chain_score(z, model, d, s) for s in product((0, 1), repeat=int(z.count[d]))]
            total += np.logaddexp.reduce(every) - _chain_score(z, model, d, gold)
        return total / 4 + 0.5e-3 * sum((v**2).sum() for v in model.values())

    g = R._likelihood_grads(z, y, model, weight)
    for k in model:
        for at in list(np.ndindex(*model[k].shape))[:6]:
            keep, step = model[k][at], 1e-6
            model[k][at] = keep + step
            up = loss()
            model[k][at] = keep - step
            down = loss()
            model[k][at] = keep
            assert abs((up - down) / (2 * step) - g[k][at]) < 1e-5


def test_lines_do_not_depend_on_the_batch():
    texts = [t or "" for _, t in MESSY] + [PROSE + "\n" + OTHER]
    model = R.fit([(t, int(i < 200)) for i, t in labelled_documents()])
    whole = R.verdicts(texts, model)
    for k, t in enumerate(texts):
        one = R.verdicts([t], model)
        assert all(whole[c][k] == one[c][0] for c in whole)


@pytest.mark.parametrize("run", [Q.quality_scores, R.quality_rules])
def test_empty_tables(spark, run):
    assert run(documents(spark).where("false"), labels(spark).where("false")).count() == 0
    assert run(documents(spark).where("false"), labels(spark)).count() == 0


def test_keep_functions_return_the_columns(spark):
    docs = documents(spark, _train_rows())
    sample = Sample([(t, int(i < 200)) for i, t in labelled_documents()], 0.5)
    for keep in (Q.keep_quality, R.keep_by_rules):
        out = keep(docs, sample)
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} >= set(range(100, 130))
