"""Flat token files: unsigned integer ids, 64-bit document offsets, memory-mapped.

A shard is three files that one task writes: ``.ids`` (little-endian unsigned ids, 16 bits if the vocabulary
allows, else 32), ``.idx`` (n + 1 unsigned 64-bit offsets, in ids) and ``.key`` (what the writer wants to find
again for each document: one Arrow stream). Shards follow one global order; the base of a shard is the prefix
sum of the ids in the shards before it. A task writes under a name of its own attempt and only names that
successful tasks report are read, so retries and lost executors leave no trace in the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, arrow, slices
from corpusloom.llm.tokens import vocabulary

META = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def _filesystem(uri: str):
    from pyarrow import fs

    at = urlparse(uri)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(at.path)
    return fs.FileSystem.from_uri(uri)


def read_flat(uri: str, kind: str) -> np.ndarray:
    """Memory-map a flat file; a store that can't be mapped is read whole (a shard is one task's output)."""
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        import os

        path = unquote(at.path)
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.empty(0, kind)
    files, path = _filesystem(uri)
    with files.open_input_stream(path) as f:
        return np.frombuffer(f.read(), dtype=kind)


def write_shards(ordered: DataFrame, keys: list[str], folder: str, vocab: str, end_id: int) -> list[dict]:
    """Encode ``ordered`` (columns ``text`` and ``keys``, rows in global order over partitions) into shards.

    Returns the shards' rows of META in order, with ``base``: one row per partition, never one per document.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = vocabulary(vocab)
        kind = np.dtype("<u2") if max(enc.size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        part = TaskContext.get().partitionId()
        uri, files, sizes, sink = f"{folder}/{part:07d}-{uuid.uuid4().hex}", None, [], None
        for batch, texts in slices(batches):
            if files is None:
                files, path = _filesystem(uri)
                files.create_dir(path.rpartition("/")[0], recursive=True)
                out = files.open_output_stream(f"{path}.ids")
                key_schema = pa.schema([batch.schema.field(k) for k in keys])
                key_out = files.open_output_stream(f"{path}.key")
                sink = pa.ipc.new_stream(key_out, key_schema)
            tail = np.array([end_id], kind)
            ids = [np.concatenate((enc.encode(t).astype(kind), tail)) for t in texts]
            out.write(np.concatenate(ids).tobytes())
            sizes += [len(x) for x in ids]
            sink.write_batch(batch.select(keys).cast(key_schema))
        if files is None:
            return
        sink.close()
        key_out.close()
        out.close()
        with files.open_output_stream(f"{path}.idx") as f:
            f.write(np.concatenate(([0], np.cumsum(sizes, dtype=np.uint64))).astype("<u8").tobytes())
        yield arrow(META, shard=[part], path=[f"{uri}|{kind.str}"], n_docs=[len(sizes)], n_ids=[int(sum(sizes))])

    rows = ordered.select(*keys, "text").mapInArrow(write, "shard long, path string, n_docs long, n_ids long").collect()
    meta, base = [], 0
    for r in sorted(rows, key=lambda r: r["shard"]):
        meta.append(r.asDict() | {"base": base})
        base += r["n_ids"]
    return meta


def shard_table(spark: SparkSession, meta: list[dict]) -> DataFrame:
    """The shards as rows, one to a partition."""
    rows = [(m["path"], m["base"], m["n_ids"]) for m in meta]
    df = spark.createDataFrame(rows, "path string, base long, n_ids long")
    return df.repartition(max(1, len(rows)))


def open_shard(path: str) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """The ids, offsets and keys of a shard."""
    uri, _, kind = path.rpartition("|")
    files, at = _filesystem(uri)
    with files.open_input_stream(f"{at}.key") as f:
        keys = pa.ipc.open_stream(f).read_all()
    return read_flat(f"{uri}.ids", kind), read_flat(f"{uri}.idx", "<u8").astype(np.int64), keys


def global_order(docs: DataFrame, *keys: str) -> DataFrame:
    """Range-partition and sort by the keys; ties (repeated rows) keep the order of the input."""
    return docs.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row")


__all__ = ["Scratch", "global_order", "open_shard", "read_flat", "shard_table", "write_shards"]
