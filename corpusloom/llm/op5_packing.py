"""Operator 5: packing along a space-filling curve.

Each text becomes a hashed word-count vector, a fixed Gaussian matrix projects it to four dimensions, each
dimension is cut into 1,024 steps and the cell's position on a Hilbert curve is the document's key. One pass over the
texts writes the keys and the ids (of tokens.py) to the shared folder; from here on only ids move.

The curve is cut into ranges of about equal numbers of ids: a histogram of the ids over the key's leading bits gives
the cuts, and a key that alone holds more than a range (a group of copies) gets several ranges, dealt by a hash of the
row. Documents are sent to their range, sorted by (key, doc_id), and the stream of ids over all ranges is cut every
``capacity`` ids, so neighbours on the curve share sequences; a range's place in the stream is the prefix sum of the
ranges before it. What remains at the end of the stream is cut into powers of two, which need no padding: no
sequence is padded at all.

The driver sees the histogram (65,536 numbers), the heavy keys (fewer than ranges) and one number per range.

Cases: null or empty text is one end id; null doc_ids stay null and sort first within a key; rows with the same
doc_id are separate documents (equal rows in any order: their pieces are the same); a document longer than a sequence is
cut into several pieces; a very long text is held whole in one task, with about 15 bytes for each of its own; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, Words, field, mix64, slices
from corpusloom.llm.tokens import default_vocabulary, vocabulary

CAPACITY, END_ID = 1024, 0
BUCKETS, DIMS, BITS = 256, 4, 10
#: Ids of a range (one task) that more ranges are made for, and leading bits of the key in the histogram.
RANGE_IDS, LEADING = 4 << 20, 16
SHIFT = BITS * DIMS - LEADING
#: Rows whose vectors are held at a time.
VECTORS = 2048
_PROJECT = np.random.default_rng(20_005).standard_normal((BUCKETS, DIMS))
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``cells`` (n x dims, 0 to 2**bits - 1).

    The published transposed-axes construction: undo excess work from the top bit down, Gray-encode, interleave.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: list[str]) -> np.ndarray:
    """Hilbert key of each text's projected, normalised word-count vector."""
    out = []
    for a in range(0, len(texts), VECTORS):
        part = texts[a : a + VECTORS]
        words = Words([t.encode("utf-8", "replace") for t in part])
        cell = words.text * BUCKETS + (words.hash & np.uint64(BUCKETS - 1)).astype(np.int64)
        counts = np.log1p(np.bincount(cell, minlength=len(part) * BUCKETS).reshape(len(part), BUCKETS))
        counts -= counts.mean(1, keepdims=True)  # else all long texts lie in one direction, and in one range of the curve
        counts /= np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1e-9)
        spread = np.clip((counts @ _PROJECT) / 3 + 0.5, 0, 1 - 1e-9)
        out.append(hilbert_index((spread * (1 << BITS)).astype(np.int64)))
    return np.concatenate(out) if out else np.empty(0, np.int64)


ENCODED = "doc_id long, curve_key long, n_ids long, ids binary"


def encoded(docs: DataFrame, vocab: str, end_id: int) -> DataFrame:
    """doc_id, curve_key, and the ids with the end id as little-endian unsigned integers of 16 bits, or 32 if the vocabulary needs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocabulary(vocab)
        kind = np.dtype(id_kind(enc.size, end_id))
        tail = np.array([end_id], kind).tobytes()
        for batch, texts in slices(batches, limit=1 << 20):
            ids = [enc.encode(t).astype(kind).tobytes() + tail for t in texts]
            yield pa.RecordBatch.from_arrays([field(batch, "doc_id"), pa.array(curve_keys(texts)), pa.array([len(x) // kind.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "curve_key", "n_ids", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ENCODED)


def id_kind(size: int, end_id: int) -> str:
    return "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"


class Ranges:
    """Cuts of the curve: ``starts[i]`` is the first key of the ranges numbered from ``numbers[i]``; heavy keys have several."""

    def __init__(self, per_bucket: dict[int, int], heavy: dict[int, int], size: int):
        self.starts, self.numbers, self.several = [0], [0], {}
        held, number = 0, 0
        for b in sorted(per_bucket):
            own = sorted(k for k in heavy if k >> SHIFT == b)
            for k in own:
                number += 1 if held else 0
                parts = -(-heavy[k] // size)
                self.several[k] = (number, parts)
                number += parts
                self._cut(k + 1, number)
                held = 0
            held += per_bucket[b] - sum(heavy[k] for k in own)
            if held >= size:
                number += 1
                self._cut((b + 1) << SHIFT, number)
                held = 0
        self.count = number + 1

    def _cut(self, key: int, number: int) -> None:
        self.starts.append(key)
        self.numbers.append(number)

    def assign(self, keys: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Range of each key; ``salt`` deals out the rows of heavy keys."""
        out = np.array(self.numbers, np.int64)[np.searchsorted(np.array(self.starts), keys, side="right") - 1]
        for k, (first, parts) in self.several.items():
            at = keys == k
            if at.any():
                out[at] = first + (mix64(salt[at].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        return out


def ranges(rows: DataFrame, at_least: int, range_ids: int = RANGE_IDS) -> Ranges:
    """Cuts of the rows (curve_key, n_ids) into ranges of about ``range_ids`` ids, ``at_least`` of them where there are ids enough."""
    bucket = F.shiftright("curve_key", SHIFT)
    per_bucket = {r[0]: r[1] for r in rows.groupBy(bucket.alias("b")).agg(F.sum("n_ids").alias("n")).collect()}
    size = max(1, min(range_ids, -(-sum(per_bucket.values()) // max(1, at_least))))
    crowded = [b for b, n in per_bucket.items() if n > size]  # only these can hold a key of more than a range
    keys = rows.where(bucket.isin(crowded)).groupBy("curve_key").agg(F.sum("n_ids").alias("n")).where(F.col("n") > size)
    return Ranges(per_bucket, {r[0]: r[1] for r in keys.collect()} if crowded else {}, size)


def sequence_bounds(total: int, capacity: int = CAPACITY) -> np.ndarray:
    """Where the sequences of the tail begin: the ids after the last full sequence in falling powers of two."""
    at, rest = total - total % capacity, total % capacity
    bounds = [at]
    while rest:
        bounds.append(bounds[-1] + (1 << (rest.bit_length() - 1)))
        rest = total - bounds[-1]
    return np.array(bounds, np.int64)


def pack(spark: SparkSession, docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences; ``with_ids`` adds each piece's ids as an array."""
    vocab = vocab or default_vocabulary()
    kind = id_kind(vocabulary(vocab).size, end_id)
    rows = Scratch(spark, "op5").write(encoded(docs, vocab, end_id), "encoded")
    cuts = ranges(rows.select("curve_key", "n_ids"), 2 * spark.sparkContext.defaultParallelism)

    @F.pandas_udf("int")
    def number(keys: pd.Series, ids: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(cuts.assign(keys.to_numpy(), ids.fillna(-1).to_numpy().astype(np.int64) * 31 + n.to_numpy()).astype(np.int32))

    placed = rows.withColumn("part", number("curve_key", "doc_id", "n_ids"))
    sums = {r[0]: r[1] for r in placed.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    bases = np.concatenate(([0], np.cumsum([sums.get(k, 0) for k in range(cuts.count)]))).astype(np.int64)
    tail = sequence_bounds(int(bases[-1]), capacity)
    fields = PIECES + (", ids array<int>" if with_ids else "")
    names = [f.split()[0] for f in fields.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base = None, 0
        for batch in batches:
            # a batch of rows of a few ranges; each range's stream goes on from batch to batch
            parts = field(batch, "part").to_numpy()
            for a, b in _runs(parts):
                if parts[a] != part:
                    part, base = int(parts[a]), int(bases[parts[a]])
                for piece in _bounded(batch.slice(a, b - a)):
                    out, base = _pieces(piece, base, tail, capacity, kind, with_ids)
                    yield pa.RecordBatch.from_arrays(out, names=names)

    dealt = placed.repartitionById(cuts.count, "part").sortWithinPartitions("part", "curve_key", F.col("doc_id").asc_nulls_first(), "n_ids", F.xxhash64("ids"))
    return dealt.select("part", "doc_id", "n_ids", "ids").mapInArrow(cut, fields)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if not len(values):
        return []
    edge = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *edge.tolist()], [*edge.tolist(), len(values)], strict=True))


def _bounded(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` ids (one row at least)."""
    n = np.cumsum(field(batch, "n_ids").to_numpy())
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(n, (n[a - 1] if a else 0) + limit, side="right")))
        yield batch.slice(a, b - a)
        a = b


def _pieces(batch: pa.RecordBatch, base: int, tail: np.ndarray, capacity: int, kind: str, with_ids: bool) -> tuple[list, int]:
    """Columns of the pieces of some documents whose ids begin at ``base`` in the stream, and where they end."""
    size = field(batch, "n_ids").to_numpy()
    at = base + np.concatenate(([0], np.cumsum(size)))
    end = int(at[-1])
    full = np.arange(-(-base // capacity) * capacity, min(end, int(tail[0])) + 1, capacity)
    first = np.unique(np.concatenate((at[:-1], full[full < end], tail[(tail >= base) & (tail < end)])))
    length = np.diff(np.append(first, end))
    doc = np.searchsorted(at, first, side="right") - 1
    in_tail = np.maximum(np.searchsorted(tail, first, side="right") - 1, 0)
    late = first >= tail[0]
    sequence = np.where(late, tail[0] // capacity + in_tail, first // capacity)
    offset = np.where(late, first - tail[in_tail], first % capacity)
    ids = [np.frombuffer(x, kind).astype("<u4") for x in field(batch, "ids").to_pylist()]
    parts = [ids[d][s : s + n] for d, s, n in zip(doc.tolist(), (first - at[doc]).tolist(), length.tolist(), strict=True)]
    crc = [zlib.crc32(p.tobytes()) for p in parts]
    out = [field(batch, "doc_id").take(pa.array(doc)), *map(pa.array, (first - at[doc], length)), pa.array(crc, pa.int64()), *map(pa.array, (size[doc], sequence, offset))]
    if with_ids:
        out.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
    return out, end
