"""Shared plumbing of the training-data operators: shared scratch tables, batches, exact word hashing.

Intermediate tables are written below ``spark.checkpoint.dir`` (see corpusloom.sources.scratch).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.scratch import Scratch, shared_root, spread

#: Bytes of text that a Python kernel holds expanded at a time, and bytes of words hashed at a time.
SLICE_BYTES = 4 << 20
HASH_BLOCK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; documents that come as one small file are dealt out to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into runs of rows with at most ``limit`` bytes of text (one row at least); null text is empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if not len(col):
            continue
        import pyarrow.compute as pc

        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < len(size):
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            part = batch.slice(at, end - at)
            yield part, [x or "" for x in col.slice(at, end - at).to_pylist()]
            at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a public 64-bit hash (fixed constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = np.random.default_rng(20_001).integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = np.random.default_rng(20_002).integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    """An odd multiplier for each place in a word, the same ones whatever the longest word is."""
    global _PLACE
    if n > len(_PLACE):
        _PLACE = np.random.default_rng(20_002).integers(0, 2**64, max(n, 2 * len(_PLACE)), dtype=np.uint64) | np.uint64(1)
    return _PLACE


#: The white space that separates words: 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """All words of some UTF-8 texts: 64-bit hash, text index, first byte and length of each word.

    ``bounds[k]`` to ``bounds[k + 1]`` are the words of text k. Words are ``[^\\x20\\x09-\\x0D]+``.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        data = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
        self.data = data
        inside = ~_SPACE[data]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        self.start = np.flatnonzero(edge == 1)
        self.size = np.flatnonzero(edge == -1) - self.start
        self.bounds = np.searchsorted(self.start, self.base)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        if not len(self.start):
            self.hash = np.empty(0, np.uint64)
            return
        self.hash = np.empty(len(self.start), np.uint64)
        filled = np.concatenate(([0], np.cumsum(self.size)))
        at = 0
        while at < len(self.start):  # a block of words at a time: this step takes 25 bytes for each byte of text
            end = max(at + 1, int(np.searchsorted(filled, filled[at] + HASH_BLOCK, side="right")) - 1)
            lo, hi = int(self.start[at]), int(self.start[end - 1] + self.size[end - 1])
            size, first = self.size[at:end], filled[at:end] - filled[at]
            place = np.arange(int(filled[end] - filled[at])) - np.repeat(first, size)
            part = _BYTE[data[lo:hi][inside[lo:hi]]]
            part *= _places(int(size.max()))[place]
            self.hash[at:end] = mix64(np.add.reduceat(part, first) + size.astype(np.uint64))
            at = end


__all__ = ["Covered", "Scratch", "Words", "arrow", "field", "mix64", "shared_root", "slices", "table"]


def arrow(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch with the columns in the schema's order."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Covered:
    """Whether a stretch overlaps one of some spans (start, end), by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a
