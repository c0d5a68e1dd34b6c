"""Operator 4: quality classifier, a byte-level convolutional network in numpy.

Bytes are embedded, 24 filters of 8 bytes run over the whole text at every fourth byte, a rectifier follows, and
each filter is max-pooled over chunks of 256 bytes that overlap by half. The chunks' pooled values are combined
by their maximum and their mean, and a logistic unit makes one probability of them. Scoring covers every byte of
every text. Memory is bounded by the slices of text held at a time; a text longer than a slice is scored in blocks of
half chunks, of which only the pooled values are kept (0.75 bytes for each byte of text).

Fitted on at most 2 x ROWS_PER_LABEL labelled rows (see training.py) that aren't held out; inputs are the text's
bytes alone.

Cases: null or empty texts are scored as one empty chunk; null doc_ids aren't held out; rows with the same doc_id
get a row each; without labels of both kinds the score is the share of label 1 (1.0 with none at all); an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import field, slices
from corpusloom.llm.training import Adam, Sample, held_out, labelled_sample

THRESHOLD = 0.3
EMBED, STEP, FILTERS = 6, 4, 24
#: Weight of label 1 in the fit: a clean document lost costs more than a bad one kept.
KEEP = 0.65
#: Filter positions in half a chunk: 32 x 4 = 128 bytes; half chunks of a very long text that are held at a time.
HALF, BLOCK = 32, 4096


class _Layout:
    """Filter positions, half chunks and chunks of some texts laid end to end."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([max(2, -(-(len(t) + STEP) // STEP)) for t in texts])  # cells of STEP bytes, zero-padded by a cell
        first = np.concatenate(([0], np.cumsum(sizes)))
        data = np.zeros(int(first[-1]) * STEP, np.uint8)
        for t, a in zip(texts, first[:-1].tolist(), strict=True):
            data[a * STEP : a * STEP + len(t)] = np.frombuffer(t, np.uint8)
        self.cells = data.reshape(-1, STEP)
        spots = sizes - 1
        self.spot = np.arange(int(first[-1]))
        self.spot = np.delete(self.spot, first[1:] - 1)
        halves = -(-spots // HALF)
        self.half_first = np.concatenate(([0], np.cumsum(halves)))
        self.doc_of_half = doc_of_half = np.repeat(np.arange(len(texts)), halves)
        spot_first = np.concatenate(([0], np.cumsum(spots)))
        self.half_spot = spot_first[doc_of_half] + HALF * (np.arange(len(doc_of_half)) - self.half_first[doc_of_half])
        last = np.zeros(len(doc_of_half), bool)
        last[self.half_first[1:] - 1] = True
        alone = np.repeat(halves == 1, halves)
        self.chunk_half = np.flatnonzero(~last | alone)
        self.chunk_next = np.where(alone[self.chunk_half], self.chunk_half, self.chunk_half + 1)
        chunks = np.maximum(halves - 1, 1)
        self.chunk_first = np.concatenate(([0], np.cumsum(chunks)))[:-1]
        self.chunks = chunks[:, None].astype(np.float32)
        self.half_sizes = np.diff(np.append(self.half_spot, spot_first[-1]))
        self.doc_of_chunk = np.repeat(np.arange(len(texts)), chunks)


def initial(seed: int = 20_004) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    return {"embed": f(256, EMBED, scale=0.5), "near": f(STEP * EMBED, FILTERS, scale=0.25), "far": f(STEP * EMBED, FILTERS, scale=0.25), "lift": np.zeros(FILTERS, np.float32), "out": f(2 * FILTERS, scale=0.1), "bias": np.zeros(1, np.float32)}


def _forward(w: dict, z: _Layout) -> dict:
    cells = w["embed"][z.cells].reshape(len(z.cells), -1)
    act = (cells @ w["near"])[z.spot] + (cells @ w["far"])[z.spot + 1] + w["lift"]
    np.maximum(act, 0, out=act)
    half = np.maximum.reduceat(act, z.half_spot)
    chunk = np.maximum(half[z.chunk_half], half[z.chunk_next])
    top = np.maximum.reduceat(chunk, z.chunk_first)
    mean = np.add.reduceat(chunk, z.chunk_first) / z.chunks
    logit = np.hstack((top, mean)) @ w["out"] + w["bias"]
    return {"cells": cells, "act": act, "half": half, "chunk": chunk, "top": top, "mean": mean, "p": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}


def score(w: dict, texts: list[bytes], block: int = BLOCK) -> np.ndarray:
    """Probability of label 1 for each text."""
    long = [len(t) > block * HALF * STEP for t in texts]
    out = np.empty(len(texts), np.float32)
    short = [t for t, x in zip(texts, long, strict=True) if not x]
    if short:
        out[~np.array(long)] = _forward(w, _Layout(short))["p"]
    for i in np.flatnonzero(long):
        out[i] = score_long(w, texts[i], block)
    return out


def score_long(w: dict, text: bytes, block: int = BLOCK) -> float:
    """The same for one text, ``block`` half chunks at a time."""
    spots = -(-(len(text) + STEP) // STEP) - 1
    halves = []
    for a in range(0, -(-spots // HALF), block):
        first, last = a * HALF, min((a + block) * HALF, spots)
        data = np.zeros((last - first + 1) * STEP, np.uint8)
        part = np.frombuffer(text, np.uint8)[first * STEP : (last + 1) * STEP]
        data[: len(part)] = part
        cells = w["embed"][data.reshape(-1, STEP)].reshape(last - first + 1, -1)
        act = np.maximum((cells @ w["near"])[:-1] + (cells @ w["far"])[1:] + w["lift"], 0)
        halves.append(np.maximum.reduceat(act, np.arange(0, last - first, HALF)))
    half = np.concatenate(halves)
    chunk = np.maximum(half[:-1], half[1:]) if len(half) > 1 else half
    logit = np.concatenate((chunk.max(0), chunk.mean(0, dtype=np.float64).astype(np.float32))) @ w["out"] + w["bias"][0]
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def _grads(w: dict, z: _Layout, y: np.ndarray, weight: np.ndarray) -> dict:
    f = _forward(w, z)
    d = ((f["p"] - y) * weight / weight.sum()).astype(np.float32)
    g = {"bias": d.sum(keepdims=True), "out": np.hstack((f["top"], f["mean"])).T @ d}
    d_top, d_mean = d[:, None] * w["out"][:FILTERS], d[:, None] * w["out"][FILTERS:] / z.chunks
    d_chunk = d_mean[z.doc_of_chunk]
    # the largest chunk's value is that of its larger half, which two chunks share: it counts once
    d_half = np.where(f["half"] == f["top"][z.doc_of_half], d_top[z.doc_of_half], 0)
    here = f["half"][z.chunk_half] >= f["half"][z.chunk_next]
    np.add.at(d_half, z.chunk_half, np.where(here, d_chunk, 0))
    np.add.at(d_half, z.chunk_next, np.where(here, 0, d_chunk))
    half = np.repeat(np.arange(len(z.half_spot)), z.half_sizes)
    d_act = np.where((f["act"] == f["half"][half]) & (f["act"] > 0), d_half[half], 0).astype(np.float32)
    g["lift"] = d_act.sum(0)
    g["near"], g["far"] = f["cells"][z.spot].T @ d_act, f["cells"][z.spot + 1].T @ d_act
    d_cells = np.zeros_like(f["cells"])
    d_cells[z.spot] += d_act @ w["near"].T
    d_cells[z.spot + 1] += d_act @ w["far"].T
    g["embed"] = np.stack([np.bincount(z.cells.ravel(), d_cells.reshape(-1, EMBED)[:, k], 256) for k in range(EMBED)], 1).astype(np.float32)
    return g


def fit(rows: list[tuple[str, int]], share: float | None = None, steps: int | None = None, batch: int = 48, rate: float = 0.02, seed: int = 20_004) -> dict:
    """Weights fitted on (text, label) rows; label 1 has the share KEEP of the weight.

    With ``share`` (of label 1 among all labels) the bias is corrected from the fit's weights to that share, so that the
    score is a probability for the table's documents.
    """
    y = np.array([q for _, q in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 1.0}
    texts = [t.encode("utf-8", "replace") for t, _ in rows]
    weight = np.where(y == 1, KEEP / (y == 1).sum(), (1 - KEEP) / (y == 0).sum())
    w, r = initial(seed), np.random.default_rng(seed)
    adam = Adam(w, rate)
    batches = -(-len(texts) // batch)
    epochs = -(-(steps or min(840, max(240, 30 * batches))) // batches)
    mean, n = {k: np.zeros(v.shape) for k, v in w.items()}, 0
    for e in range(epochs):
        adam.rate = rate * (1 - 0.9 * e / epochs)
        order = r.permutation(len(texts))
        for a in range(0, len(order), batch):
            k = order[a : a + batch]
            adam.step(_grads(w, _Layout([texts[i] for i in k]), y[k], weight[k]))
            if e >= epochs // 2:  # the mean of the second half's weights is steadier than the last ones
                n += 1
                for name in mean:
                    mean[name] += (w[name] - mean[name]) / n
    if share is not None and 0 < share < 1:
        mean["bias"] += np.log(share / (1 - share)) - np.log(KEEP / (1 - KEEP))
    return {name: v.astype(np.float32) for name, v in mean.items()}


def classify(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, limit=1 << 20):
            raw = [t.encode("utf-8", "replace") for t in texts]
            p = np.full(len(raw), model["constant"]) if "constant" in model else score(model, raw).astype(np.float64)
            yield pa.RecordBatch.from_arrays([field(batch, "doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the labelled sample, score every document."""
    scored = classify(docs, fit(*labelled_sample(docs, labels)), threshold)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, sample: Sample, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold`` by a network fitted on ``sample``."""
    return keep_scored(docs, fit(*sample), threshold)


def keep_scored(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The same by a fitted network. No join: the text is scored in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, limit=1 << 20):
            raw = [t.encode("utf-8", "replace") for t in texts]
            p = np.full(len(raw), model["constant"]) if "constant" in model else score(model, raw)
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
