"""Operator 3: near-duplicates by a signature-coordinate inverted join.

1. A document's set is its distinct word shingles (64-bit hashes of ASCII-lower-cased words). 128 minima make its
   signature; four of them hashed together make one of its 32 coordinates.
2. Documents with equal sets form a class; from here on only classes count (a third of all rows may be copies).
3. Each class is posted under its coordinate-value pairs. Two texts of similarity 0.8 agree in a coordinate with
   probability 0.41; AGREE = 2 collisions are asked for, so by the prefix rule the first 31 of 32 coordinates suffice
   (a pair of similarity 0.8 has fewer collisions with probability 1e-6). Lists with the same members are merged into one.
4. Collisions are counted pair by pair: a list is scanned for the pairs of its least member and the others, all lists are
   joined into one row per pair, and the lists that weren't scanned for a pair are skipped and probed instead, by comparing
   the two signatures' coordinates. A pair survives with AGREE collisions and, as a tighter threshold, MATCHES equal
   minima of 128 (0.8 falls short with probability 1e-6). Components of surviving pairs tie most of a list together, and
   members so tied are skipped: of a list with several groups left, only members outside its largest group are compared
   with the others, block against block (blocks by a hash of the member). No surviving pair between two groups of a list
   goes unseen, and a list of n members of which s are left costs n + s * n / 512 rows; what leaves a block is a
   spanning set of pairs, never all.
5. Components of surviving pairs are families. The texts of families of two classes or more are read again and their
   full sets written. First every member meets the 64 of its block and some PIVOTS members of its family, by integer
   intersection counts: pairs with 100 * intersection >= 80 * union are links, exactly. Only members that aren't yet
   tied to their family's largest group are then compared with all its members, block against block: a family of n
   members of which s are left costs n + s * n / 64 sets. Components of links give the answer.

Work is in proportion to the input except inside a family of different near copies that don't link through pivots: there
the last comparison covers pairs of blocks.

A very long text is held whole in one task, with about 30 bytes for each of its own.

Cases: null or empty text, and texts of white space, have an empty set and are linked with nothing; a text shorter
than a shingle is one shingle; rows with the same doc_id are one document with several texts (linked); rows with a
null doc_id take no part: component_id null, kept true; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, Words, field, mix64, slices
from corpusloom.llm.components import components

WIDTH, PERCENT = 2, 80
MINIMA, ROWS = 128, 4
COORDINATES = MINIMA // ROWS
#: Coordinates that must agree, and so the number posted; minima that must agree.
AGREE = 2
POSTED = COORDINATES - AGREE + 1
MATCHES = 80
LIST_BLOCK, FAMILY_BLOCK, FAMILY_SHINGLES = 512, 64, 200_000
#: Members of a family, about, that all its members are compared with first.
PIVOTS = 8
_R = np.random.default_rng(20_003)
_A = _R.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)[:, None] | np.uint32(1)
_B = _R.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)[:, None]


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words([t.encode("utf-8", "replace").lower() for t in texts])  # bytes.lower() is A-Z only
    h = np.zeros(max(0, len(words.hash) - width + 1), np.uint64)
    for j in range(width):
        h = mix64(h * np.uint64(5) + words.hash[j : j + len(h)])
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for k in range(a, b):
                one = mix64(one * np.uint64(7) + words.hash[k : k + 1])
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The signature of a non-empty set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    return np.minimum.reduce([(low[k : k + 1024] * _A + _B).min(1) for k in range(0, len(low), 1024)])


def coordinates(signature: np.ndarray) -> np.ndarray:
    """The posted coordinate-value pairs of some signatures as 64-bit keys."""
    s = signature.astype(np.uint64).reshape(len(signature), COORDINATES, ROWS)[:, :POSTED]
    key = np.broadcast_to(np.arange(POSTED, dtype=np.uint64) + np.uint64(1), s.shape[:2])
    for j in range(ROWS):
        key = mix64(key * np.uint64(11) + s[:, :, j])
    return key.view(np.int64)


def _sign(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sets = shingle_sets(texts, width)
            full = [s for s in sets if len(s)]
            sig = np.array([minima(s) for s in full], np.uint32).reshape(-1, MINIMA)
            keys = iter(coordinates(sig).tolist())
            short = iter(sig.astype("<u2"))
            cols = [
                field(batch, "doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                pa.array([next(short).tobytes() if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "set_key", "posts", "signature"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, posts array<long>, signature binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the groups' bounds, from rows sorted by ``keys`` (long columns)."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        k = np.column_stack([t.column(c).to_numpy() for c in keys])
        cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if len(cut):
            yield t.slice(0, int(cut[-1])), np.concatenate(([0], cut))
            rest = t.slice(int(cut[-1]))
        else:
            rest = t
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def agree(a: np.ndarray, b: np.ndarray, need: int = MATCHES) -> np.ndarray:
    """Whether signatures, row by row, collide in AGREE coordinates and agree in ``need`` minima."""
    same = a == b
    return (same.sum(-1) >= need) & (same.reshape(*same.shape[:-1], COORDINATES, ROWS).all(-1).sum(-1) >= AGREE)


def survivors(pivots: np.ndarray, others: np.ndarray, pivot_group: np.ndarray, other_group: np.ndarray, need: int = MATCHES) -> list[tuple[int, int]]:
    """Of the pairs (pivot, other) of different groups that :func:`agree`, enough to join the same groups."""
    root: dict[int, int] = {}

    def find(g: int) -> int:
        while root.get(g, g) != g:
            g = root[g]
        return g

    out = []
    for p in range(len(pivots)):
        for r in np.flatnonzero(agree(others, pivots[p], need)):
            a, b = find(int(pivot_group[p])), find(int(other_group[r]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((p, int(r)))
    return out


def linked_groups(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set the first set of its component under 100 * intersection >= percent * union."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    codes, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    common = np.zeros((m, m), np.int64)
    step = 8192
    for a in range(0, len(codes), step):
        i, j = np.searchsorted(code, (a, a + step))
        dense = np.zeros((m, min(step, len(codes) - a)), np.float32)
        dense[row[i:j], code[i:j] - a] = 1
        common += (dense @ dense.T).astype(np.int64)  # at most 8192, exact in float32
    link = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    group = np.arange(m)
    while True:
        least = np.where(link, group[None, :], m).min(1)
        least = least[least]
        if (least == group).all():
            return group
        group = np.minimum(group, least)


_EDGES = "u long, v long"


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["u", "v"])


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, MINIMA)


def _count_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.select(["u", "v"]).filter(pa.array(agree(_signatures(field(batch, "su")), _signatures(field(batch, "sv")))))


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, bounds in _groups(batches, ["post", "i", "j"]):
        sig, rep, group = _signatures(t.column("signature")), t.column("rep").to_numpy(), t.column("grp").to_numpy()
        pivot = t.column("pivot").to_numpy().astype(bool)
        ends = np.append(bounds[1:], t.num_rows) if bounds[-1] != t.num_rows else bounds[1:]
        pairs = []
        for a, b in zip(bounds[: len(ends)].tolist(), ends.tolist(), strict=True):
            p, o = a + np.flatnonzero(pivot[a:b]), a + np.flatnonzero(~pivot[a:b])
            pairs += [(rep[p[x]], rep[o[y]]) for x, y in survivors(sig[p], sig[o], group[p], group[o])]
        if pairs:
            yield _edges(pairs)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _groups(batches, ["family", "i", "j"]):
            rep = t.column("rep").to_numpy()  # a member may occur twice in a cell: equal sets, one group
            sets = [np.frombuffer(x, "<u8") for x in t.column("shingles").to_pylist()]
            ends = np.append(bounds[1:], t.num_rows) if bounds[-1] != t.num_rows else bounds[1:]
            pairs = []
            for a, b in zip(bounds[: len(ends)].tolist(), ends.tolist(), strict=True):
                if b - a > 1:
                    first = linked_groups(sets[a:b], percent)
                    pairs += [(rep[a + i], rep[a + f]) for i, f in enumerate(first.tolist()) if i != f]
            if pairs:
                yield _edges(pairs)

    return run


def _count_rest(scratch: Scratch, members: DataFrame, tied: DataFrame, signatures: DataFrame) -> DataFrame | None:
    """Surviving pairs between the groups that are left in each list: members outside the list's largest group against all; None without any."""
    grouped = members.join(tied.select(F.col("node").alias("rep"), F.col("component").alias("grp")), "rep", "left").select("post", "rep", F.coalesce("grp", "rep").alias("grp"))
    rest = scratch.write(_unfinished(grouped, "post"), "list-rest")
    if rest.limit(1).count() == 0:
        return None
    left = scratch.write(rest.join(signatures, "rep"), "left")
    both = _rest_against_all(left, "post", F.ceil(F.col("n") / LIST_BLOCK), F.ceil(F.col("s") / LIST_BLOCK), ["grp", "pivot", "signature"])
    return both.repartition("post", "i", "j").sortWithinPartitions("post", "i", "j").mapInArrow(_count_blocks, _EDGES)


def _unfinished(grouped: DataFrame, key: str) -> DataFrame:
    """Members (key, rep, grp) of the keys with several groups, with the members' number n, the largest group ``main`` and the number s outside it."""
    sizes = grouped.groupBy(key, "grp").agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("n"), F.max_by("grp", F.struct("n", "grp")).alias("main"), F.max("n").alias("top")).where("n > top")
    return grouped.join(sizes.select(key, "n", "main", (F.col("n") - F.col("top")).alias("s")), key)


def _at(blocks: F.Column) -> F.Column:
    return F.pmod(F.xxhash64("rep"), blocks)


def _every(blocks: F.Column) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1))


def _rest_against_all(left: DataFrame, key: str, blocks: F.Column, rest_blocks: F.Column, carry: list[str]) -> DataFrame:
    """A cell (key, i, j) for each block i of the members outside the main group and each block j of all members."""
    cols = [key, "i", "j", "rep", *carry]
    pivots = left.where("grp <> main").withColumns({"i": _at(rest_blocks), "pivot": F.lit(1)}).withColumn("j", _every(blocks)).select(*cols)
    others = left.withColumns({"j": _at(blocks), "pivot": F.lit(0)}).withColumn("i", _every(rest_blocks)).select(*cols)
    return pivots.unionByName(others)


def _with_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(texts, width)]
            yield pa.RecordBatch.from_arrays([*(field(batch, c) for c in ("rep", "family", "blocks", "one_in")), pa.array(sets, pa.binary())], names=["rep", "family", "blocks", "one_in", "shingles"])

    return docs.mapInArrow(run, "rep long, family long, blocks long, one_in long, shingles binary")


def _linked(scratch: Scratch, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) by the links between the members of each family."""
    cols = ["family", "i", "j", "rep", "shingles"]
    pivot = (F.col("rep") == F.col("family")) | (F.pmod(F.xxhash64("rep", F.lit(7)), F.col("one_in")) == 0)
    own = sets.withColumns({"i": _at(F.col("blocks")), "j": F.lit(0).cast("long")}).select(*cols)
    pivots = sets.where(pivot).withColumn("own", _at(F.col("blocks"))).withColumn("i", _every(F.col("blocks"))).where("i <> own").withColumn("j", F.lit(0).cast("long")).select(*cols)
    first = own.unionByName(pivots).repartition("family", "i").sortWithinPartitions("family", "i").mapInArrow(_confirm(percent), _EDGES)
    first = scratch.write(first, "first-links")
    tied = components(scratch, first, "first").select(F.col("node").alias("rep"), "component")
    grouped = sets.select("family", "rep").distinct().join(tied, "rep", "left").select("family", "rep", F.coalesce("component", "rep").alias("grp"))
    rest = scratch.write(_unfinished(grouped, "family"), "family-rest")
    if rest.limit(1).count() == 0:
        return tied.withColumnRenamed("rep", "node")
    left = scratch.write(sets.select("rep", "blocks", "shingles").join(rest, "rep"), "family-left")
    cells = _rest_against_all(left, "family", F.col("blocks"), F.ceil(F.col("s") * F.col("blocks") / F.col("n")), ["shingles"])
    second = cells.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(_confirm(percent), _EDGES)
    # the ties found before stand for their links
    return components(scratch, tied.select(F.col("rep").alias("u"), F.col("component").alias("v")).unionByName(second), "linked")


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(spark, "op3")
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    signed = scratch.write(_sign(texts, width), "signed")
    some = signed.where("doc_id is not null and set_key is not null")
    classes = scratch.write(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("posts").alias("posts"), F.first("signature").alias("signature")), "classes")
    posts = classes.select("rep", F.explode("posts").alias("post"))
    lists = posts.groupBy("post").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bit_xor(F.xxhash64("rep")).alias("who")).where("n > 1")
    lists = scratch.write(lists.groupBy("n", "lo", "hi", "who").agg(F.min("post").alias("post"), F.count("*").alias("times")), "lists")
    more = scratch.write(posts.join(lists.where("n > 2").select("post", "lo", "times"), "post").select("post", "lo", "times", "rep"), "members")
    scanned = lists.where("n = 2").select(F.col("hi").alias("u"), F.col("lo").alias("v"), "times").unionByName(more.where("rep <> lo").select(F.col("rep").alias("u"), F.col("lo").alias("v"), "times"))
    stars = scanned.groupBy("u", "v").agg(F.sum("times").alias("seen"))  # collisions in scanned lists; the rest are probed
    of = classes.select("rep", "signature")
    stars = stars.join(of.select(F.col("rep").alias("u"), F.col("signature").alias("su")), "u").join(of.select(F.col("rep").alias("v"), F.col("signature").alias("sv")), "v")
    pairs = scratch.write(stars.select("u", "v", "su", "sv").mapInArrow(_count_stars, _EDGES), "stars")
    tied = components(scratch, pairs, "tied")
    rest = _count_rest(scratch, more.select("post", "rep"), tied, of)
    family = tied if rest is None else components(scratch, tied.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(rest), "families")
    family = scratch.write(family.withColumnRenamed("node", "rep").withColumnRenamed("component", "family").join(classes.groupBy("rep").agg(F.sum("n_shingles").alias("n_shingles")), "rep"), "family")
    blocks = F.greatest(F.ceil(F.count("*") / FAMILY_BLOCK), F.ceil(F.sum("n_shingles") / FAMILY_SHINGLES))
    blocks = scratch.write(family.groupBy("family").agg(blocks.alias("blocks"), F.greatest(F.floor(F.count("*") / PIVOTS), F.lit(1)).alias("one_in")), "blocks")
    wanted = family.select("rep", "family").join(blocks, "family")
    sets = _with_sets(texts.withColumnRenamed("doc_id", "rep").join(wanted.hint("shuffle_hash"), "rep"), width)
    sets = scratch.write(sets, "sets")
    found = scratch.write(_linked(scratch, sets, percent).select(F.col("node").alias("rep"), "component"), "found")
    scratch.keep_only("signed", "classes", "found")  # the result reads these again
    of_class = classes.select("set_key", "rep").join(found, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    of_row = signed.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return of_row.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, with one document of each group of near-duplicates: the least doc_id's.

    Several rows of a kept doc_id all stay, as they are one document with several texts, but rows equal in all columns become one;
    rows without a doc_id all stay.
    """
    kept = near_duplicates(spark, docs, width, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    some = docs.where("doc_id is not null")
    one = some.join(kept, some["doc_id"] == kept["_kept"], "left_semi")
    twice = some.groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_n")).where("_n > 1").select("_kept")
    alone = one.join(twice, one["doc_id"] == twice["_kept"], "left_anti")
    several = one.join(twice, one["doc_id"] == twice["_kept"], "left_semi").dropDuplicates()
    return alone.unionByName(several).unionByName(docs.where("doc_id is null"))
