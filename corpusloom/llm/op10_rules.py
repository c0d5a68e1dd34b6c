"""Operator 10: quality rules, with content lines marked by a linear-chain conditional random field.

Base counts follow fixed rules (words, symbols, repeated lines, words inside repeated 8-word windows). Then each
line of the whole text becomes a feature vector, a two-state linear-chain CRF is decoded by Viterbi, and the share
of words that stand in content lines decides: a document is kept if it passes the base rules and at least half of
its words are content.

The CRF's weights are fitted by gradient on the conditional likelihood, on the bounded sample of training.py. That sample
labels documents, so the lines' labels are latent: all lines of a good document are content, a bad one has one line of
boilerplate at least, and which of its lines are content is found by hard expectation and maximisation with a line
classifier (rounds of fitting it and marking the bad documents' lines by it). So chains hold lines of both states and the
transition weights learn how often they follow each other.

Cases: very long texts are held whole in one task, with about 25 bytes for each of their own; null or empty text has no words, fails the base rules and isn't kept; null doc_ids stay null; rows with the
same doc_id get a row each; without labels of both kinds every line is content; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import Words, field, mix64, slices
from corpusloom.llm.training import Adam, Sample, labelled_sample

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Least share of words in content lines.
CONTENT_SHARE = 0.5
#: Weight of label 1 in the fit: a clean line lost costs more than a bad one kept.
KEEP = 0.7
#: Scale of the shares of marks, which are small even in lines full of them.
RARE = 8.0
#: Log-odds from which a line of a bad document counts as content in the fit.
CONFIDENT = 2.0

LOWER, UPPER, DIGIT, MARK, PIPE, BANG, POINT, SPACE, TAIL, WIDE, OTHER = range(11)


def _classes() -> np.ndarray:
    k = np.full(256, OTHER, np.int8)
    k[ord("a") : ord("z") + 1] = LOWER
    k[ord("A") : ord("Z") + 1] = UPPER
    k[ord("0") : ord("9") + 1] = DIGIT
    for c in "\"'(),-./:;?@[\\]^_`{}~+=":
        k[ord(c)] = POINT
    for c in "#*$%&<>":
        k[ord(c)] = MARK
    k[ord("|")] = PIPE
    k[ord("!")] = BANG
    k[[0x20, *range(0x09, 0x0E)]] = SPACE
    k[0x80:0xC0] = TAIL
    k[0xC0:] = WIDE
    return k


_CLASS = _classes()
N_CLASS = 11
N_FEATURES = 12


class Lines:
    """Rule counts and line features of some texts."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "replace") for t in texts]
        words = Words(raw)
        self.words, n = words, len(texts)
        data = words.data
        line_end = np.flatnonzero(data == 0x0A)  # each text ends with a newline of its own
        lines = len(line_end)
        table = np.zeros((lines, N_CLASS), np.int64)
        if lines:
            start, kinds = np.concatenate(([0], line_end[:-1] + 1)), _CLASS[data]
            for k in range(N_CLASS):  # a class at a time: no array of eight bytes for each byte of text
                table[:, k] = np.add.reduceat((kinds == k).view(np.int8), start, dtype=np.int64)
        self.first = np.searchsorted(line_end, words.base)[:-1]
        self.count = np.diff(np.append(self.first, lines))
        self.doc = np.repeat(np.arange(n), self.count)
        line_word = np.searchsorted(line_end, words.start)
        self.line_words = np.bincount(line_word, minlength=lines)
        per_doc = np.add.reduceat(table, self.first) if n else table
        self.n_words = np.diff(words.bounds)
        self.word_chars = per_doc.sum(1) - per_doc[:, SPACE] - per_doc[:, TAIL]
        self.n_symbols = per_doc[:, MARK] + per_doc[:, PIPE]
        self.repeated = self._repeated_lines(texts)
        self.n_dup_lines = np.bincount(self.doc, self.repeated & (self.line_words > 0), n).astype(np.int64)
        self.n_repeat_words = self._repeated_windows(n)
        visible = np.maximum(table.sum(1) - table[:, SPACE] - table[:, TAIL], 1)
        last = np.full(lines, OTHER)
        if len(words.start):
            end = words.start + words.size - 1
            last[line_word] = _CLASS[data[end]]  # the last word of each line is written last
        share = lambda *k: table[:, list(k)].sum(1) / visible
        long = np.log1p(self.line_words)
        self.features = np.column_stack((np.ones(lines), share(UPPER), RARE * share(MARK), RARE * share(PIPE), share(DIGIT), RARE * share(BANG), share(POINT), np.minimum(visible / np.maximum(self.line_words, 1), 30) / 10, long / 4, (last == POINT) | (last == BANG), self.repeated, self.line_words == 0)).astype(np.float64)

    def _repeated_lines(self, texts: list[str]) -> np.ndarray:
        """Whether a line equals an earlier one of its text."""
        out: list[bool] = []
        for t in texts:
            seen: set[str] = set()
            for line in t.split("\n"):
                out.append(line in seen)
                seen.add(line)
        return np.array(out, bool)

    def _repeated_windows(self, n: int) -> np.ndarray:
        """Words covered by windows of WINDOW words that occur at least twice in their text."""
        w = self.words
        m = len(w.hash) - WINDOW + 1
        if m <= 0:
            return np.zeros(n, np.int64)
        key = np.zeros(m, np.uint64)
        for j in range(WINDOW):
            key = mix64(key * np.uint64(3) + w.hash[j : j + m])
        ok = w.text[:m] == w.text[WINDOW - 1 :]
        at = np.flatnonzero(ok)
        key = mix64(key[at] + w.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(step, at[twice], 1)
        np.add.at(step, at[twice] + WINDOW, -1)
        return np.bincount(w.text, np.cumsum(step)[:-1] > 0, n).astype(np.int64)


def _steps(z: Lines) -> Iterator[np.ndarray]:
    """The lines at step 0, 1, ... of all texts that have one."""
    order = np.argsort(-z.count, kind="stable")
    first, count = z.first[order], z.count[order]
    for t in range(int(count.max(initial=0))):
        yield order[: np.searchsorted(-count, -t)], first[: np.searchsorted(-count, -t)] + t


def viterbi(z: Lines, model: dict) -> np.ndarray:
    """The likeliest state of each line: 1 content, 0 boilerplate."""
    unary = z.features @ model["emit"]
    path = np.ones(len(unary), np.int8)
    n = len(z.count)
    best, back, steps = np.zeros((n, 2)), np.zeros((len(unary), 2), np.int8), []
    for docs, lines in _steps(z):
        if not steps:
            best[docs] = model["start"] + unary[lines]
        else:
            through = best[docs][:, :, None] + model["move"]
            back[lines] = through.argmax(1)
            best[docs] = through.max(1) + unary[lines]
        steps.append((docs, lines))
    state = best.argmax(1).astype(np.int8)
    last = z.first + z.count - 1
    for docs, lines in reversed(steps):
        ends = lines == last[docs]
        now = np.where(ends, best[docs].argmax(1), state[docs]).astype(np.int8)
        path[lines] = now
        state[docs] = back[lines, now]
    return path


def _likelihood_grads(z: Lines, y: np.ndarray, model: dict, weight: np.ndarray) -> dict:
    """Gradient of the weighted negative conditional log-likelihood, by forward and backward sums over all chains at once."""
    unary = z.features @ model["emit"]
    n = len(z.count)
    alpha, beta, steps = np.zeros((len(unary), 2)), np.zeros((len(unary), 2)), list(_steps(z))
    lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for t, (_, lines) in enumerate(steps):
        alpha[lines] = unary[lines] + (model["start"] if t == 0 else lse(alpha[lines - 1][:, :, None] + model["move"], 1))
    last = z.first + z.count - 1
    for docs, lines in reversed(steps):
        go = lines[lines != last[docs]]
        if len(go):
            beta[go] = lse(model["move"] + (unary[go + 1] + beta[go + 1])[:, None, :], 2)
    total = lse(alpha[last], 1)
    p = np.exp(alpha + beta - total[z.doc][:, None])
    gold = np.eye(2)[y]
    w = weight[z.doc][:, None]
    g = {"emit": z.features.T @ ((p - gold) * w), "start": ((p - gold) * w)[z.first].sum(0)}
    inner = np.setdiff1d(np.arange(len(unary)), last)
    pair = np.exp(alpha[inner][:, :, None] + model["move"] + (unary[inner + 1] + beta[inner + 1])[:, None, :] - total[z.doc[inner]][:, None, None])
    true = gold[inner][:, :, None] * gold[inner + 1][:, None, :]
    g["move"] = ((pair - true) * w[inner][:, :, None]).sum(0)
    return {k: v / n + 1e-3 * model[k] for k, v in g.items()}


class _Chains:
    """The line features of a sample, gathered a few texts at a time."""

    def __init__(self, texts: list[str], at_once: int = 100):
        parts = [Lines(texts[a : a + at_once]) for a in range(0, len(texts), at_once)]
        self.features = np.concatenate([p.features for p in parts])
        self.count = np.concatenate([p.count for p in parts])
        self.first = np.concatenate(([0], np.cumsum(self.count)))[:-1]
        self.doc = np.repeat(np.arange(len(texts)), self.count)


def line_labels(z: _Chains, label: np.ndarray, weight: np.ndarray, rounds: int = 3, steps: int = 80, rate: float = 0.2) -> np.ndarray:
    """1 (content) or 0 of each line: 1 throughout the documents of label 1, a mixture with at least one 0 in the others."""
    y = label[z.doc].copy()
    bad = label[z.doc] == 0
    own = weight[z.doc]
    spread = z.features.std(0) + 1e-6
    x = (z.features - z.features.mean(0)) / spread
    x[:, 0] = 1.0
    w = {"line": np.zeros(x.shape[1])}
    for _ in range(rounds):
        adam = Adam(w, rate)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w["line"], -30, 30)))
            adam.step({"line": x.T @ ((p - y) * own) / own.sum() + 1e-3 * w["line"]})
        odds = x @ w["line"]
        y = np.where(bad, (odds > CONFIDENT).astype(y.dtype), 1)
        worst = np.minimum.reduceat(odds, z.first)[z.doc]
        y[bad & (odds == worst)] = 0
    return y


def fit(rows: list[tuple[str, int]], rounds: int = 60, rate: float = 0.1) -> dict:
    """CRF weights from (text, label) rows; the constant model (all content) without both labels."""
    model = {"emit": np.zeros((N_FEATURES, 2)), "start": np.zeros(2), "move": np.zeros((2, 2))}
    if len({q for _, q in rows}) < 2:
        model["start"][1] = 1.0
        return model
    z = _Chains([t for t, _ in rows])
    label = np.array([q for _, q in rows])
    weight = np.where(label == 1, KEEP * len(label) / (label == 1).sum(), (1 - KEEP) * len(label) / (label == 0).sum()) / np.sqrt(z.count)
    y = line_labels(z, label, weight)
    adam = Adam(model, rate)
    for _ in range(rounds):
        adam.step(_likelihood_grads(z, y, model, weight))
    return model


def verdicts(texts: list[str], model: dict) -> dict[str, np.ndarray]:
    """Rule counts, share of content words and verdict of each text."""
    z = Lines(texts)
    content = np.bincount(z.doc, z.line_words * viterbi(z, model), len(texts))
    share = np.where(z.n_words > 0, content / np.maximum(z.n_words, 1), 0.0)
    failed = (z.n_words < MIN_WORDS) | (100 * z.n_repeat_words > MAX_REPEAT_PERCENT * z.n_words)
    return {"n_words": z.n_words, "word_chars": z.word_chars, "n_symbols": z.n_symbols, "n_dup_lines": z.n_dup_lines, "n_repeat_words": z.n_repeat_words, "base_failed": failed, "kept": ~failed & (share >= CONTENT_SHARE), "content_share": share}


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(labelled_sample(docs, labels).rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            out = verdicts(texts, model)
            yield pa.RecordBatch.from_arrays([field(batch, "doc_id"), *map(pa.array, out.values())], names=["doc_id", *out])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, RESULT)


def keep_by_rules(docs: DataFrame, sample: Sample) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules and the content share keep, by a chain fitted on ``sample``."""
    return keep_content(docs, fit(sample.rows))


def keep_content(docs: DataFrame, model: dict) -> DataFrame:
    """The same by a fitted chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield batch.filter(pa.array(verdicts(texts, model)["kept"]))

    return docs.mapInArrow(run, docs.schema)
