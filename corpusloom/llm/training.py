"""Bounded, documented samples of labelled rows for the classifiers that are fitted here."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fit's bounds: rows of each label at most, and bytes of a text at most (longer ones are scored, not fitted on).
ROWS_PER_LABEL, TEXT_CHARS = 2000, 20_000


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text is a multiple of 5; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Sample(NamedTuple):
    """(text, label) rows, and the share of label 1 among all labels (None without labels)."""

    rows: list[tuple[str, int]]
    share: float | None


def _chosen(docs: DataFrame, labels: DataFrame, rows_per_label: int, text_chars: int) -> tuple[list[DataFrame], float | None]:
    """(at, doc_id, text) of label 0 and of label 1, in order, and the share of label 1."""
    known = labels.selectExpr("cast(doc_id as long) doc_id", "cast(quality as int) quality").where("doc_id is not null and quality in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(17))
    chosen = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(3 * rows_per_label) for q in (0, 1)]
    some = chosen[0].unionByName(chosen[1])  # at most 6 * rows_per_label rows of two numbers
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where(F.length("text") <= text_chars)
    rows = texts.join(F.broadcast(some), "doc_id").where("text is not null").withColumn("at", order)
    parts = [rows.where(F.col("quality") == q).orderBy("at", "doc_id", "text").limit(rows_per_label).select("at", "doc_id", "text") for q in (0, 1)]
    return parts, known.agg(F.avg("quality")).first()[0]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL, text_chars: int = TEXT_CHARS) -> Sample:
    """(text, quality) of at most ``2 * rows_per_label`` rows that aren't held out, chosen by a hash of doc_id.

    A doc_id labelled twice counts with its lowest label; null labels don't count.
    """
    parts, share = _chosen(docs, labels, rows_per_label, text_chars)
    return Sample([(r["text"], q) for q, part in enumerate(parts) for r in part.select("text").collect()], share)


def fit_on_sample(docs: DataFrame, labels: DataFrame, fit: Callable[[Sample], dict], rows_per_label: int = ROWS_PER_LABEL, text_chars: int = TEXT_CHARS) -> dict:
    """``fit`` of :func:`labelled_sample`'s rows, in one task: the driver gets the weights and never the texts."""
    parts, share = _chosen(docs, labels, rows_per_label, text_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(Sample([(text, q) for q, _, _, text in rows], share)))], pa.binary())], names=["model"])

    both = parts[0].select(F.lit(0).alias("q"), "*").unionByName(parts[1].select(F.lit(1).alias("q"), "*"))
    found = both.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit(Sample([], share))  # an empty plan has no task


class Adam:
    """Plain Adam over a dict of arrays."""

    def __init__(self, weights: dict, rate: float):
        import numpy as np

        self.w, self.rate, self.t, self.np = weights, rate, 0, np
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (self.np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
