"""Joins, set operations and de-duplication with explicit contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.contracts import ContractError, assert_unique


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; the order should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ascending order (nulls last among equals, as stable sorts keep them)."""
    return first_per_key(df, keys, [F.col(c).desc_nulls_first() for c in order])


def dedupe(df: DataFrame, keys: list[str], rank: Column, fields: list[str]) -> DataFrame:
    """One row per key, that of least ``rank``, by a partial aggregation: a hot key never meets in one task."""
    best = F.min_by(F.struct(*fields), rank)
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{f}").alias(f) for f in fields])


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails if a key occurs twice on either side."""
    assert_unique(left, keys, "left side")
    assert_unique(right, keys, "right side")
    return left.join(right, keys, "left")


def join_keep_last(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], suffix: str = "_ctrl") -> DataFrame:
    """Left join after keep-last on both sides; columns of both sides but the keys get ``suffix`` on the right."""
    a, b = last_per_key(left, keys, order), last_per_key(right, keys, order)
    for c in set(b.columns) & set(a.columns) - set(keys):
        b = b.withColumnRenamed(c, f"{c}{suffix}")
    return a.join(b, keys, "left")


def join_many_to_one(left: DataFrame, right: DataFrame, left_key: str, right_key: str, required: bool = True) -> DataFrame:
    """Left join on keys of different names; the right key must be unique, and matched if ``required``."""
    assert_unique(right, [right_key], "right side")
    if required and left.join(right, left[left_key] == right[right_key], "left_anti").limit(1).collect():
        raise ContractError(f"rows without a match for {left_key}")
    return left.join(right, left[left_key] == right[right_key], "left")


def lookup_with_fallback(rows: DataFrame, exact: DataFrame, general: DataFrame, exact_keys: list[str], general_keys: list[str], value: str, default: str = "") -> DataFrame:
    """``value`` from the exact lookup, else the general one, else the default, and where it came from."""
    a = exact.groupBy(*exact_keys).agg(F.min(value).alias("_exact"))
    b = general.groupBy(*general_keys).agg(F.min(value).alias("_general"))
    out = rows.join(a, exact_keys, "left").join(b, general_keys, "left")
    source = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_general").isNotNull(), "fallback").otherwise("unknown")
    return out.withColumn(value, F.coalesce("_exact", "_general", F.lit(default))).withColumn(f"{value}_source", source).drop("_exact", "_general")


def priority_match(rows: DataFrame, id_col: str, candidates: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """Matches of the first candidate table, then of the next for rows not yet covered, and so on; with ``matched_by``."""
    left, parts = rows, []
    for name, table, keys in candidates:
        hit = left.join(table, keys, "inner").withColumn("matched_by", F.lit(name))
        parts.append(hit)
        left = left.join(hit.select(id_col).distinct(), id_col, "left_anti")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def leakage_free(rows: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Rows whose key doesn't occur in the held-out table; null keys stay."""
    return rows.join(held_out.select(key).distinct(), key, "left_anti")


def leaking(rows: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    return rows.join(held_out.select(key).distinct(), key, "left_semi")


def update_by_map(rows: DataFrame, updates: DataFrame, key: str, column: str, order: str | None = None) -> DataFrame:
    """``column`` replaced where ``updates`` has a non-null value for the key, all else kept.

    Of several values for a key the one of least ``order`` counts, without an order the least value.
    """
    known = updates.where(F.col(column).isNotNull())
    new = known.groupBy(key).agg((F.min_by(column, F.struct(order, column)) if order else F.min(column)).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def upsert(rows: DataFrame, existing: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Existing non-null values win over those of the rows."""
    old = existing.select(key, *[F.col(c).alias(f"{c}_existing") for c in columns])
    return rows.join(old, key, "left").withColumns({c: F.coalesce(f"{c}_existing", c) for c in columns}).drop(*[f"{c}_existing" for c in columns])


def spine(a: DataFrame, b: DataFrame, limit: int = 100_000) -> DataFrame:
    """All pairs of the distinct rows of two dimensions. The smaller is exploded from an array of ``limit`` rows at most
    (counted first; more raise an error), so no join without a key is planned.
    """
    small = b.distinct()
    rows = small.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ContractError(f"a spine's smaller side has {limit} rows at most")
    if not rows:
        return a.distinct().join(small, F.lit(False))
    made = a.sparkSession.createDataFrame([(0, [tuple(r) for r in rows])], f"_k int, _b array<struct<{','.join(f'`{n}`:{t}' for n, t in small.dtypes)}>>")
    return a.distinct().withColumn("_k", F.lit(0)).join(F.broadcast(made), "_k").select(*a.columns, F.explode("_b").alias("_b")).select(*a.columns, *[F.col(f"_b.{c}").alias(c) for c in b.columns])


def missing_combinations(spine_a: DataFrame, spine_b: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of the two key spines (the second a small dimension, see :func:`spine`) that ``present`` lacks."""
    return spine(spine_a, spine_b).join(present.select(*keys).distinct(), keys, "left_anti")


def lookup_files(wanted: DataFrame, index: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(found: every wanted key with its files' paths, missing: wanted keys without a file)."""
    want = wanted.select(*keys).distinct()
    return want.join(index, keys), want.join(index.select(*keys).distinct(), keys, "left_anti")


def split_complete(eligible: DataFrame, mapping: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(complete, gaps) of a left join that may fan out: rows whose mapped value is known, and the others."""
    joined = eligible.join(mapping, key, "left")
    known = F.col(value).isNotNull() & (F.col(value).cast("string") != "")
    return joined.where(known), joined.where(~F.coalesce(known, F.lit(False)))


def enrich_name(rows: DataFrame, by_id: DataFrame, by_ticker: DataFrame, id_col: str, ticker: str, name: str, own: str) -> DataFrame:
    """``name`` from the lookup by id, else the one by ticker, else the row's own column; distinct rows.

    Each lookup counts with its least name per key.
    """
    a = by_id.groupBy(id_col).agg(F.min(name).alias("_by_id"))
    b = by_ticker.groupBy(ticker).agg(F.min(name).alias("_by_ticker"))
    out = rows.join(a, id_col, "left").join(b, ticker, "left").withColumn(name, F.coalesce("_by_id", "_by_ticker", own))
    return out.drop("_by_id", "_by_ticker").distinct()


def set_difference_both_ways(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): expected but missing, or found but unexpected."""
    a = expected.select(key).distinct()
    b = found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))


def dataset_relationship(a: DataFrame, b: DataFrame, norm: str = "norm", label: str = "label") -> DataFrame:
    """One row: how two labelled sets relate (historical_duplicate, same_sentences, overlapping, disjoint)."""
    count = lambda df, n: df.groupBy(norm, label).agg(F.count("*").alias(n))
    both = count(a, "na").join(count(b, "nb"), [norm, label], "full_outer")
    per = both.groupBy(norm).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.count_if(~F.col("na").eqNullSafe(F.col("nb"))).alias("uneven"))
    one = per.agg(F.sum("uneven").alias("uneven"), F.count_if(F.expr("na is not null")).alias("left_distinct"), F.count_if(F.expr("nb is not null")).alias("right_distinct"), F.count_if(F.expr("na is not null and nb is not null")).alias("overlap"))
    one = one.withColumn("uneven", F.coalesce("uneven", F.lit(0)))
    kind = (
        F.when((F.col("uneven") == 0) & (F.col("left_distinct") > 0), "historical_duplicate")
        .when((F.col("overlap") == F.col("left_distinct")) & (F.col("overlap") == F.col("right_distinct")) & (F.col("overlap") > 0), "same_sentences")
        .when(F.col("overlap") > 0, "overlapping")
        .otherwise("disjoint")
    )
    return one.select("left_distinct", "right_distinct", "overlap", F.coalesce(F.try_divide(F.col("overlap").cast("double"), F.least("left_distinct", "right_distinct")), F.lit(0.0)).alias("overlap_ratio"), kind.alias("relationship"))


def match_terms(orgs: DataFrame, org: str, terms: DataFrame, term: str) -> DataFrame:
    """Word-boundary phrase match of terms in organisation names without a nested loop.

    Names are exploded to words and met with each term's first word in an equi-join; the whole phrase is then verified on
    the survivors. Empty terms match nothing.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    t = terms.withColumn("_t", words(F.col(term))).where(F.size("_t") > 0).withColumn("_first", F.col("_t")[0])
    o = orgs.withColumn("_o", words(F.col(org)))
    hit = o.select("*", F.explode(F.array_distinct("_o")).alias("_first")).join(t, "_first")
    phrase = F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" "))
    return hit.where(F.contains(F.concat(F.lit(" "), F.array_join("_o", " "), F.lit(" ")), phrase)).drop("_o", "_t", "_first")


def match_phrases(patents: DataFrame, org: str, terms: DataFrame, term: str, firm: str, patent: str) -> DataFrame:
    """(patent, firm) pairs by :func:`match_terms`, each once however many of the firm's terms match; the least term is kept."""
    hit = match_terms(patents.select(patent, org), org, terms.select(firm, term), term)
    return hit.groupBy(patent, firm).agg(F.min(term).alias(term))


def match_substrings(rows: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """(row, term) for each term of a fixed list that a text contains, as plain text; one pass, no join."""
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(F.col(text)), F.lower(t)))
    return rows.select("*", F.explode(found).alias("term"))
