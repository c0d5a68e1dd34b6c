"""Operator 8: token ids as flat binary files with 64-bit offsets, memory-mapped on reading.

One range shuffle of the texts by doc_id, one pass that encodes and writes shards, prefix sums over the shards'
id counts (one number per partition on the driver), one pass that maps the files and reads them back.

Cases: null text is an empty text (its only id is the end id); null doc_ids come first and stay null; rows with
the same doc_id are separate documents in input order; an empty table gives no files and no rows; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import Scratch, arrow
from corpusloom.llm.store import global_order, open_shard, shard_table, write_shards
from corpusloom.llm.tokens import default_vocabulary

END_ID = 2
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, vocab: str | None = None, end_id: int = END_ID) -> list[dict]:
    """Write the documents' ids to ``folder`` in ascending doc_id order; the shards with their bases."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return write_shards(global_order(rows, "doc_id"), ["doc_id"], folder, vocab or default_vocabulary(), end_id)


def read_token_files(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, at, keys = open_shard(row["path"])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                out = pa.Table.from_arrays([keys.column("doc_id"), pa.array(at[:-1] + row["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], schema=READ)
                yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    return shard_table(spark, shards).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_binary_tokens(spark: SparkSession, docs: DataFrame, vocab: str | None = None, end_id: int = END_ID) -> DataFrame:
    scratch = Scratch(spark, "op8")
    return read_token_files(spark, write_token_files(docs, scratch.path("tokens"), vocab, end_id))


__all__ = ["arrow", "op8_binary_tokens", "read_token_files", "write_token_files"]
