"""Operator 6: exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are turned into integers floor(256 x). Each task packs its rows into shards of at most SHARD vectors and its
queries into blocks of at most BLOCK. Shards are dealt to groups of about GROUP vectors and blocks to groups of about
QUERIES queries (their numbers follow two counts), and every group of shards meets every group of blocks in one cell: an
equi-join on the cell's numbers over packed rows, a stated query set against all rows. A cell's shards arrive first and have
their lists built once; the blocks stream past them. So a vector is moved once for each QUERIES queries and a query once
for each GROUP vectors. In a shard each dimension has its list of rows by
value. A block's queries read the lists together, from the top where a component is positive and from the bottom
where it is negative; rows seen are scored in full for all queries still reading, and a query stops once its bound
(the query times the values at the lists' heads) is below its k-th score. Each cell gives a query k rows at most,
and a ranking with a limit before the shuffle merges them.

Cases: vectors that are null, empty or hold null or non-finite components take no part, nor do null vec_ids; vectors
of different lengths aren't compared; a vec_id that occurs in several rows counts once, with its best score, and is
never its own candidate; score ties go to the smaller vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import field

TOP, EVERY, SCALE = 5, 50, 256.0
SHARD, BLOCK, STEP = 4096, 256, 48
#: Vectors and queries of a cell, about.
GROUP, QUERIES = 16 * SHARD, 16 * SHARD
_PACK = "ids binary, rows binary, dims int"


def _pack(limit: int):
    """Pack valid vectors into rows of (ids, integer matrix), ``limit`` vectors of one length each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dims: int) -> pa.RecordBatch:
            ids, rows = held.pop(dims)
            return pa.RecordBatch.from_arrays([pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.array(rows, "<i4").tobytes()], pa.binary()), pa.array([dims], pa.int32())], names=["ids", "rows", "dims"])

        for batch in batches:
            lists = field(batch, "embedding")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(lists)
            good = (pc.fill_null(pc.is_finite(flat.cast(pa.float64())), False)).to_numpy(zero_copy_only=False)
            x = np.floor(SCALE * np.nan_to_num(pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), posinf=0, neginf=0))
            first = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
            bad = np.concatenate(([0], np.cumsum(~good)))
            ok = (size > 0) & (bad[first[1:]] == bad[first[:-1]])
            for k, i in enumerate(field(batch, "vec_id").to_pylist()):
                if i is None or not ok[k]:
                    continue
                ids, rows = held.setdefault(int(size[k]), ([], []))
                ids.append(i)
                rows.append(x[first[k] : first[k + 1]])
                if len(ids) >= limit:
                    yield out(int(size[k]))
        for dims in list(held):
            yield out(dims)

    return run


class Shard:
    """Vectors with a list per dimension, sorted by value. Rows of the same vec_id are taken as different ones."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows.astype(np.int64)
        self.exact = self.rows.astype(np.float64)  # sums below 2**53 are exact
        self.order = np.argsort(self.rows, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.exact, self.order, 0)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int = TOP) -> tuple[list[np.ndarray], int]:
        """For each query the row numbers of its k best rows (own id apart, ties to the smaller vec_id); rows read."""
        n, dims = self.rows.shape
        m = len(queries)
        q = queries.astype(np.float64)
        best: list[np.ndarray] = [np.empty(0, np.int64)] * m
        score: list[np.ndarray] = [np.empty(0)] * m
        kth = np.full(m, -np.inf)
        fresh = np.ones(n, bool)
        active, at, step = np.arange(m), 0, STEP
        while len(active) and at < n:
            end = min(n, at + step)
            ranks = np.arange(at, end)
            up, down = (q[active] > 0).any(0), (q[active] < 0).any(0)
            seen = np.concatenate((self.order[n - 1 - ranks][:, up].ravel(), self.order[ranks][:, down].ravel()))
            if end == n or not len(seen):
                seen, end = np.arange(n), n  # a zero query's bound is 0 throughout: every row counts
            new = np.unique(seen[fresh[seen]])
            fresh[new] = False
            found = q[active] @ self.exact[new].T
            found[self.ids[new][None, :] == own[active][:, None]] = -np.inf
            if len(new) > k:
                floor = np.maximum(kth[active], np.partition(found, len(new) - k, axis=1)[:, len(new) - k])
            else:
                floor = kth[active]
            hit = (found >= floor[:, None]) & (found > -np.inf)
            for x in np.flatnonzero(hit.any(1)):
                a = active[x]
                rows, s = np.concatenate((best[a], new[hit[x]])), np.concatenate((score[a], found[x, hit[x]]))
                keep = np.lexsort((self.ids[rows], -s))[:k]
                best[a], score[a] = rows[keep], s[keep]
                if len(keep) == k:
                    kth[a] = s[keep][-1]
            at, step = end, 2 * step
            if at < n:
                high, low = self.sorted[n - 1 - at], self.sorted[at]
                bound = np.maximum(q[active], 0) @ high + np.minimum(q[active], 0) @ low
                active = active[bound >= kth[active]]
        return best, int(n - fresh.sum())


def distinct_ids(ids: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Parts of a shard in which no vec_id occurs twice (one part where none does)."""
    order = np.argsort(ids, kind="stable")
    first = np.concatenate(([True], ids[order][1:] != ids[order][:-1]))
    run = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    return [(ids[order][run == r], rows[order][run == r]) for r in range(int(run.max(initial=0)) + 1)]


def best_of_shards(shards: list[Shard], own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) rows: each query's k best over some shards, ties to the smaller vec_id, a vec_id in several shards once."""
    parts = []
    for shard in shards:
        best, _ = shard.top(queries, own, k)
        who = np.repeat(np.arange(len(own)), [len(b) for b in best])
        rows = np.concatenate(best) if best else np.empty(0, np.int64)
        parts.append((who, shard.ids[rows], (queries[who] * shard.rows[rows]).sum(1)))
    who, ids, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((-score, ids, who))  # of a repeated vec_id the best score counts
    who, ids, score = who[order], ids[order], score[order]
    once = np.concatenate(([True], (who[1:] != who[:-1]) | (ids[1:] != ids[:-1]))) if len(who) else np.empty(0, bool)
    who, ids, score = who[once], ids[once], score[once]
    order = np.lexsort((ids, -score, who))
    who, ids, score = who[order], ids[order], score[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    return own[who[place < k]], ids[place < k], score[place < k]


def _search(k: int):
    """Stream cells: rows sorted by cell, shards (kind 0) before blocks of queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, shards = None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                i, j, kind, dims = (batch.column(c)[r].as_py() for c in range(4))
                ids, rows = np.frombuffer(batch.column(4)[r].as_buffer(), "<i8"), np.frombuffer(batch.column(5)[r].as_buffer(), "<i4").reshape(-1, dims)
                if (i, j) != cell:
                    cell, shards = (i, j), {}
                if kind == 0:
                    shards.setdefault(dims, []).extend(Shard(*x) for x in distinct_ids(ids, rows))
                elif shards.get(dims):
                    found = best_of_shards(shards[dims], ids, rows.astype(np.int64), k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, group: int = GROUP, many: int = QUERIES) -> DataFrame:
    """The k best of ``vectors`` for each of ``queries`` (columns vec_id, embedding)."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n, m = vectors.count(), queries.count()
    # as many groups as the rows need; more, down to one shard each, to keep all cores busy on small tables
    high, wide = max(1, -(-n // group), min(-(-n // SHARD), 2 * cores)), max(1, -(-m // many))
    every = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
    cols = ["i", "j", "kind", "dims", "ids", "rows"]
    shards = vectors.selectExpr("cast(vec_id as long) vec_id", "embedding").mapInArrow(_pack(SHARD), _PACK)
    shards = shards.withColumns({"i": F.pmod(F.xxhash64("ids"), F.lit(high)).cast("int"), "kind": F.lit(0)}).withColumn("j", every(wide)).select(*cols)
    blocks = queries.selectExpr("cast(vec_id as long) vec_id", "embedding").mapInArrow(_pack(BLOCK), _PACK)
    blocks = blocks.withColumns({"j": F.pmod(F.xxhash64("ids"), F.lit(wide)).cast("int"), "kind": F.lit(1)}).withColumn("i", every(high)).select(*cols)
    cells = shards.unionByName(blocks).repartitionById(high * wide, F.col("i") * wide + F.col("j")).sortWithinPartitions("i", "j", "kind")
    found = cells.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_of_table(embeddings: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by ``every``; candidates: all rows."""
    return exact_top_k(embeddings, embeddings.where(F.col("vec_id") % every == 0), k)


SQL = """
WITH flat AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM flat q JOIN flat c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
