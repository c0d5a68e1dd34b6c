"""Ordered-group operators: leads and lags, winsorising, round-robin selection, stratified top-n, sampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.numbers import clip, growth


def lag_growth(panel: DataFrame, entity: str, time: str, x: str) -> DataFrame:
    """Previous row's value (not the previous year's: gaps are passed over) and growth over its absolute value."""
    before = F.lag(x).over(Window.partitionBy(entity).orderBy(time))
    return panel.withColumn(f"{x}_lag", before).withColumn(f"{x}_growth", growth(F.col(x), F.col(f"{x}_lag")))


def leads(panel: DataFrame, entity: str, time: str, x: str, steps: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Following rows' values, their log1p, and whether they are positive (a missing lead counts as not)."""
    w = Window.partitionBy(entity).orderBy(time)
    for k in steps:
        panel = panel.withColumn(f"{x}_lead{k}", F.lead(x, k).over(w) if k else F.col(x))
    return panel.withColumns({f"log1p_{x}_lead{k}": F.log1p(F.col(f"{x}_lead{k}").cast("double")) for k in steps} | {f"any_{x}_lead{k}": F.coalesce(F.col(f"{x}_lead{k}") > 0, F.lit(False)).cast("int") for k in steps})


#: Accuracy of the sketch that brackets a percentile: the exact step then sorts some 4 / ACCURACY of the distinct values.
ACCURACY = 10_000


def interpolated_percentiles(rows: DataFrame, x: str, shares: tuple[float, ...], group: str | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """(group, ``_q``: exact interpolated percentiles of ``x``), nulls apart; an array of nulls without values.

    No buffer holds all values of a group: a mergeable sketch brackets each percentile, values are counted before they
    meet, and only the distinct values inside a bracket are sorted; those below it count as a sum.
    """
    keys = [group] if group else []
    known = rows.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"))
    slack = 2.0 / accuracy
    ends = [min(1.0, max(0.0, p + d)) for p in shares for d in (-slack, slack)]
    sketch = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_x", ends, accuracy).alias("_e"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    counted = known.groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    if group:
        joined = counted.join(sketch.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    else:
        joined = counted.crossJoin(F.broadcast(sketch))
    low = lambda k: F.when(F.lit(ends[2 * k] <= 0), F.col("_lo")).otherwise(F.col("_e")[2 * k])
    high = lambda k: F.when(F.lit(ends[2 * k + 1] >= 1), F.col("_hi")).otherwise(F.col("_e")[2 * k + 1])
    parts = [F.max("_n").alias("_n")]
    for k in range(len(shares)):
        under, over, pair = F.col("_x") < low(k), F.col("_x") > high(k), F.struct(F.col("_x").alias("x"), F.col("_c").alias("c"))
        parts += [F.sum(F.when(under, F.col("_c")).otherwise(0)).alias(f"_u{k}"), F.max(F.when(under, pair)).alias(f"_p{k}"), F.min(F.when(over, pair)).alias(f"_o{k}"), F.array_sort(F.collect_list(F.when(~under & ~over, pair))).alias(f"_m{k}")]
    found = joined.groupBy(*keys).agg(*parts)
    # in few values the sketch's rank may be off by one, so a bracket's neighbours belong to it
    found = found.withColumns({f"_v{k}": F.array_compact(F.concat(F.array(f"_p{k}"), f"_m{k}", F.array(f"_o{k}"))) for k in range(len(shares))} | {f"_b{k}": F.col(f"_u{k}") - F.coalesce(F.col(f"_p{k}.c"), F.lit(0)) for k in range(len(shares))})

    def at(k: int, rank) -> Column:
        """The value of 0-based ``rank`` among all: runs of equal values are passed until their counts reach it."""
        start = F.struct(F.col(f"_b{k}").alias("seen"), F.lit(None).cast("double").alias("x"))
        return F.aggregate(f"_v{k}", start, lambda s, v: F.when(s["seen"] > rank, s).otherwise(F.struct((s["seen"] + v["c"]).alias("seen"), v["x"].alias("x"))))["x"]

    def interpolated(k: int, p: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(float(p))
        below, above = F.floor(place), F.ceil(place)
        return F.when(below == above, at(k, below)).otherwise((above - place) * at(k, below) + (place - below) * at(k, above))

    return found.select(*keys, F.array(*[interpolated(k, p) for k, p in enumerate(shares)]).alias("_q"))


def winsorize(rows: DataFrame, x: str, group: str | None = None, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``x`` clipped to its interpolated percentiles, in all or per group, as ``<x>_w``; the bounds are joined back."""
    bounds = interpolated_percentiles(rows, x, (low, high), group)
    if group is None:
        out = rows.crossJoin(F.broadcast(bounds.agg(F.first("_q").alias("_q"))))  # one row, also where there are no values
    else:
        out = rows.join(bounds, group, "left")
    return out.withColumn(f"{x}_w", clip(F.col(x), F.col("_q")[0], F.col("_q")[1])).drop("_q")


def align_fiscal_year(fyear: Column, fiscal_end_month: Column) -> Column:
    """Calendar year that a fiscal year belongs to: years that end by May count for the one before."""
    return F.when(fiscal_end_month <= 5, fyear - 1).otherwise(fyear)


def round_robin(rows: DataFrame, stratum: str, bucket: str, known: Column, quota: int, keys: list[str]) -> DataFrame:
    """``quota`` rows per stratum: known buckets in turn, then a fill, known rows first.

    Closed form of the greedy loop: the k-th row of each bucket comes in round k, rounds before buckets; adds
    ``selection_reason`` and ``selection_order``.
    """
    inside = Window.partitionBy(stratum, bucket, known).orderBy(*keys)
    ranked = rows.withColumn("_known", known).withColumn("_round", F.row_number().over(inside))
    turn = F.when(F.col("_known"), F.struct(F.lit(0).alias("s"), F.col("_round").cast("long").alias("a"), F.col(bucket).cast("long").alias("b"))).otherwise(F.struct(F.lit(1).alias("s"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    out = ranked.withColumn("selection_order", F.row_number().over(Window.partitionBy(stratum).orderBy(turn, *keys)))
    reason = F.when(F.col("_known"), "round_robin").otherwise("fill")
    return out.where(F.col("selection_order") <= quota).withColumn("selection_reason", reason).drop("_known", "_round")


#: Preference of length bins when filling a batch.
LENGTH_PRIORITY = {"medium": 0, "long": 1, "short": 2}


def select_batch(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """Labelling batch: per quarter, industries in turn with spread over files, then a fill by diversity.

    ``rows``: quarter, ff12_code, known, source_file, sentence_index, sentence_id, edge_case_flag, length_bin.
    ``quotas``: quarter, quota (a handful of rows). A file belongs to one quarter and one industry, so the count of
    rows already taken from a file is its row's number there and the greedy loop becomes two rankings. Industry codes
    are taken in text order ("10" before "2").
    """
    tie = ["source_file", "sentence_index", "sentence_id"]
    a = rows.where("known").withColumn("_f", F.row_number().over(Window.partitionBy("quarter", "source_file").orderBy("sentence_index", "sentence_id")))
    a = a.withColumn("_r", F.row_number().over(Window.partitionBy("quarter", "ff12_code").orderBy("_f", *tie)))
    length = F.coalesce(F.create_map(*[F.lit(x) for kv in LENGTH_PRIORITY.items() for x in kv])[F.col("length_bin")], F.lit(99))
    edge = F.when(F.col("edge_case_flag"), 0).otherwise(1)
    b = rows.where("not known").withColumn("_f", F.row_number().over(Window.partitionBy("quarter", "source_file").orderBy(edge, length, "sentence_index", "sentence_id")))
    first = a.select(*rows.columns, F.lit(0).alias("_s"), F.struct(F.col("_r").alias("x"), F.col("ff12_code").cast("string").alias("y"), F.lit(0).alias("z")).alias("_o"))
    then = b.select(*rows.columns, F.lit(1).alias("_s"), F.struct((F.col("_f") * 2 + edge).alias("x"), F.lit("").alias("y"), length.alias("z")).alias("_o"))
    order = Window.partitionBy("quarter").orderBy("_s", "_o", *tie)
    # a literal limit is applied before the shuffle, so a quarter's task gets as many rows from each task as the largest quota at most
    most = quotas.agg(F.coalesce(F.max("quota"), F.lit(0))).first()[0]
    ranked = first.unionByName(then).withColumn("batch_order", F.row_number().over(order)).where(F.col("batch_order") <= F.lit(int(most)))
    out = ranked.join(F.broadcast(quotas), "quarter").where("batch_order <= quota")
    reason = F.when(F.col("_s") == 0, "quarter_ff12_round_robin").otherwise("quarter_diversity_fill")
    return out.withColumn("selection_reason", reason).drop("_s", "_o", "quota")


#: Token counts of sentences that may be labelled.
ELIGIBLE_TOKENS = (6, 120)


def eligible_sentences(rows: DataFrame, low: int = ELIGIBLE_TOKENS[0], high: int = ELIGIBLE_TOKENS[1], max_fragment: float = 0.0) -> DataFrame:
    """Sentences that may be labelled: ``low`` to ``high`` tokens (both included) and a fragment score of ``max_fragment`` at most."""
    return rows.where(F.col("token_count").between(low, high) & (F.col("fragment_score") <= max_fragment))


def spot_check(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows drawn at random without a seed (a sampling operator: each run draws others)."""
    return rows.orderBy(F.rand()).limit(n)


def top_per_class(rows: DataFrame, label: str, n: int, order: list) -> DataFrame:
    w = Window.partitionBy(label).orderBy(*order)
    return rows.withColumn("class_rank", F.row_number().over(w)).where(F.col("class_rank") <= n)


def distinct_in_order(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First occurrence of each key, as positions in the input order."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def sample_entities(ids: list, k: int, seed: int = 42) -> list:
    """Seeded simple random sample by Python's generator over sorted ids; for entity lists that fit a dimension."""
    ordered = sorted(set(ids))
    return random.Random(seed).sample(ordered, min(k, len(ordered)))


def allocate(available: dict, target: int, base: int | None = None) -> dict:
    """Quotas that add up to ``target``: a base each (even shares if None), then one by one to the smallest quota with rows left."""
    keys = sorted(available)
    share = base if base is not None else target // max(1, len(keys))
    quota = {k: min(share, int(available[k])) for k in keys}
    if sum(quota.values()) > target:
        raise ValueError("base quotas exceed the target")
    left = target - sum(quota.values())
    while left:
        turn = [k for k in sorted(keys, key=lambda k: (quota[k], k)) if quota[k] < available[k]][:left]
        if not turn:
            raise ValueError(f"only {target - left} rows for a target of {target}")
        for k in turn:
            quota[k] += 1
        left -= len(turn)
    return quota


def allocate_years(available: dict, target: int) -> dict:
    """Year quotas: even shares, the remainder to the first years, what a year lacks to those with most rows left."""
    years = sorted(available)
    if not years or target <= 0:
        return dict.fromkeys(years, 0)
    quota = {y: min(target // len(years) + (k < target % len(years)), available[y]) for k, y in enumerate(years)}
    while sum(quota.values()) < min(target, sum(available.values())):
        spare = sorted((y for y in years if quota[y] < available[y]), key=lambda y: (available[y] - quota[y], y), reverse=True)
        for y in spare[: target - sum(quota.values())]:
            quota[y] += 1
    return quota


#: What a row's place in a greedy sample depends on, its draw apart.
CELL = ("year", "label", "bucket", "edge", "length_bin")


def greedy_sample(rows: list[dict], target: int, min_class: int = 0, base_counts: dict | None = None, bucket_floor: int = 12, seed: int = 13, totals: dict[tuple, int] | None = None) -> list[dict]:
    """Priority sample of candidates: first a floor per industry bucket, then year by year by what each still lacks.

    ``rows``: id, year, label (suggested, or None), bucket, edge, length_bin. A row is preferred by its year's open
    quota, a suggested label, an edge case, its class' shortfall, a rare length bin, then its ``draw`` (a seeded one
    where absent). Rows of a cell (equal in CELL) differ by their draws alone, so each pick compares the cells' first
    rows. ``totals``: rows per cell, where ``rows`` holds only the first of each (see :func:`priority_sample`).
    """
    generator = random.Random(seed)
    cells: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: str(r["id"])):
        cells.setdefault(tuple(r[c] for c in CELL), []).append((r["draw"] if "draw" in r else generator.random(), str(r["id"]), r))
    for q in cells.values():
        q.sort(key=lambda x: x[:2], reverse=True)  # the next one is last
    size = totals or {c: len(q) for c, q in cells.items()}
    target = min(target, sum(size.values()))

    def count(k: int) -> dict:
        out: dict = {}
        for c, n in size.items():
            out[c[k]] = out.get(c[k], 0) + n
        return dict(sorted(out.items(), key=lambda x: str(x[0])))

    available = count(0)
    quota, years, classes = allocate_years(available, target), dict.fromkeys(available, 0), dict(base_counts or {})
    length = {name: k for k, (name, _) in enumerate(sorted(count(4).items(), key=lambda x: (x[1], x[0])))}
    buckets = sorted({str(c[2]) for c in size})
    floor = bucket_floor if len(buckets) * bucket_floor <= target else target // max(1, len(buckets))
    out: list[dict] = []

    def rank(c: tuple) -> tuple:
        year, label, _, edge, bin_ = c
        lack = quota[year] - years[year]
        short = max(0, min_class - classes.get(label, 0)) if label else 0
        return (lack <= 0, -lack, not label, not edge, -short, length[bin_], *cells[c][-1][:2])

    def take(candidates: list[tuple]) -> None:
        c = min(candidates, key=rank)
        r = cells[c].pop()[2]
        if not cells[c]:
            del cells[c]
        years[r["year"]] += 1
        if r["label"]:
            classes[r["label"]] = classes.get(r["label"], 0) + 1
        out.append({k: v for k, v in r.items() if k != "draw"})

    for b in buckets:
        for _ in range(floor):
            own = [c for c in cells if str(c[2]) == b]
            if own and len(out) < target:
                take(own)
    while len(out) < target:
        year = max({c[0] for c in cells}, key=lambda y: (quota[y] - years[y], available[y], y))
        take([c for c in cells if c[0] == year])
    return out


#: Rows that the sampling loops gather at most; more are refused.
MAX_GATHERED = 1_000_000


def first_of_cells(rows: DataFrame, cell: list[str], id_col: str, n: int, seed: int) -> tuple[list, list]:
    """(counts of the cells, the first ``n`` rows of each by a hash of the id with the seed): all that a loop that picks
    ``n`` rows can reach, as rows of a cell are taken in order. The limit is applied before the shuffle."""
    counts = rows.groupBy(*cell).count().limit(MAX_GATHERED + 1).collect()
    if len(counts) * n > MAX_GATHERED:
        raise ValueError(f"{len(counts)} cells with {n} rows each are too many for a loop on the driver")
    draw = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    order = Window.partitionBy(*cell).orderBy("draw", F.col(id_col).cast("string"))
    first = rows.select(id_col, *[c for c in cell if c != id_col], draw.alias("draw")).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.lit(n)).drop("_k")
    return counts, first.collect()


def priority_sample(rows: DataFrame, target: int, min_class: int = 0, base_counts: dict | None = None, bucket_floor: int = 12, seed: int = 13) -> DataFrame:
    """:func:`greedy_sample` of a table of any size (id and CELL's columns), with ``pick_order``.

    The driver sees the cells' counts and their first ``target`` rows, which gives the sample that all rows would.
    """
    counts, first = first_of_cells(rows, list(CELL), "id", target, seed)
    totals = {tuple(r[c] for c in CELL): r["count"] for r in counts}
    picked = greedy_sample([r.asDict() for r in first], target, min_class, base_counts, bucket_floor, seed, totals)
    ids = rows.sparkSession.createDataFrame([(r["id"], k) for k, r in enumerate(picked, 1)], f"id {dict(rows.dtypes)['id']}, pick_order int")
    return rows.join(F.broadcast(ids), "id")


def irr_size(counts: dict[str, int], fraction: float, min_per_class: int) -> int:
    """Double-rated subset's size: the half-even share of all, but the minimum of each class at least."""
    return max(round(sum(counts.values()) * fraction), sum(min(min_per_class, n) for n in counts.values()))


def panel_features(panel: DataFrame) -> DataFrame:
    """Shares, logs and dummies of a firm-year panel, from the columns that it has."""
    has = set(panel.columns)
    log = lambda c: F.log1p(F.greatest(F.coalesce(F.col(c), F.lit(0)).cast("double"), F.lit(0.0)))
    new: dict[str, Column] = {}
    if "patents_ai" in has:
        new["log_patents_ai"] = log("patents_ai")
    if {"n_A", "n_S", "n_total"} <= has:
        new |= {f"{name}Share": F.try_divide(F.col(c).cast("double"), F.col("n_total")) for name, c in (("Act", "n_A"), ("Spec", "n_S"))}
    else:
        new |= {f"{name}Share": F.col(c) for name, c in (("Act", "share_A"), ("Spec", "share_S")) if c in has}
    if "n_total" in has:
        new["log_docs"] = log("n_total")
    new |= {f"log_{c}": log(c) for c in ("n_A", "n_S", "n_I") if c in has}
    acts = F.coalesce(F.col("n_A"), F.lit(0)) if "n_A" in has else F.lit(0)
    new["has_actionable"] = (acts > 0).cast("int") if "n_A" in has else F.lit(None).cast("int")
    new["has_spec_only"] = ((F.coalesce(F.col("n_S"), F.lit(0)) > 0) & (acts == 0)).cast("int") if "n_S" in has else F.lit(None).cast("int")
    out = panel.withColumns(new)
    both = {"ActShare", "SpecShare"} <= set(out.columns)
    return out.withColumn("SpecMinusAct", F.col("SpecShare") - F.col("ActShare") if both else F.lit(None).cast("double"))
