"""Labelling operators: suggestions, dedupe with conflicts, double-rated subsets, adjudication, replies."""

from __future__ import annotations

import heapq
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.contracts import LABELS
from corpusloom.functions import text as T
from corpusloom.operators.neardup import near_duplicate_pairs, resolve


def suggest_labels(sentences: DataFrame, classified: DataFrame) -> DataFrame:
    """``label_suggested`` of each sentence: the classified row at its position in the file, else the first with its normalised text.

    ``sentences``: file, position, sentence; ``classified``: file, position (null for rows of text files), sentence,
    label, source_rank (CSV rows before text rows). Labels outside the allowed set suggest nothing.
    """
    ok = classified.withColumn("label", T.allowed_label(F.col("label"))).where("label is not null")
    at = ok.where("position is not null").groupBy("file", "position").agg(F.min("label").alias("_at"))
    norm = T.normalize_sentence(F.col("sentence"))
    by = ok.withColumn("norm", norm).where("norm <> ''").groupBy("file", "norm").agg(F.min_by("label", F.struct("source_rank", F.coalesce("position", F.lit(1 << 30)), "label")).alias("_by"))
    out = sentences.withColumn("norm", norm).join(at, ["file", "position"], "left").join(by, ["file", "norm"], "left")
    return out.withColumn("label_suggested", F.coalesce("_at", "_by")).drop("_at", "_by", "norm")


def dedupe_exact(rows: DataFrame, order: list[str]) -> DataFrame:
    """First row of each (sentence_norm, label); rows without a norm or an allowed label go."""
    ok = rows.where((F.coalesce("sentence_norm", F.lit("")) != "") & F.coalesce(F.col("label").isin(*LABELS), F.lit(False)))
    fields = [c for c in rows.columns if c not in ("sentence_norm", "label")]
    best = ok.groupBy("sentence_norm", "label").agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_b"))
    return best.select(*[F.col(f"_b.{c}").alias(c) if c in fields else F.col(c) for c in rows.columns])


#: Near-duplicate pairs of a labelling batch that are resolved on the driver.
MAX_PAIRS = 1_000_000


def dedupe_near(rows: DataFrame, id_col: str = "sample_id", threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(kept rows, conflicts): near-duplicates of one label keep the first, of two labels go both.

    Pairs come from the distributed join; the order-dependent resolution runs on the driver, on a labelling batch's pairs
    (MAX_PAIRS at most, more raise an error).
    """
    pairs = near_duplicate_pairs(rows, id_col, "sentence_norm", threshold)
    label = rows.select(F.col(id_col).alias("id"), "label")
    named = pairs.join(label.select(F.col("id").alias("id_a"), F.col("label").alias("label_a")), "id_a").join(label.select(F.col("id").alias("id_b"), F.col("label").alias("label_b")), "id_b")
    found = named.limit(MAX_PAIRS + 1).collect()
    if len(found) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} near-duplicate pairs in a labelling batch: drop exact copies first")
    labels = {r.id_a: r.label_a for r in found} | {r.id_b: r.label_b for r in found}
    gone, conflicts = resolve([(r.id_a, r.id_b) for r in found], labels)
    kind = dict(rows.dtypes)[id_col]
    spark = rows.sparkSession
    drop = spark.createDataFrame([(x,) for x in sorted(gone)], f"{id_col} {kind}")
    similarity = {(r.id_a, r.id_b): r.similarity for r in found}
    out = [(a, b, labels[a], labels[b], float(similarity[a, b]), "label_conflict") for a, b in conflicts]
    return rows.join(drop, id_col, "left_anti"), spark.createDataFrame(out, f"sample_id_a {kind}, sample_id_b {kind}, label_a string, label_b string, similarity double, reason string")


def irr_subset(rows: list[dict], fraction: float = 0.1, min_per_class: int = 5, seed: int = 13, totals: dict[tuple, int] | None = None, short: set | None = None) -> list[dict]:
    """Subset to be rated twice: a minimum of each class spread over strata, then a fill by class deficit.

    ``rows``: sample_id, label, stratum. Each pick changes the next one's order, but rows of one class and stratum differ by
    their draws alone, so a pick compares the first rows of these cells. Ties break by a seeded draw (a row's
    ``draw`` where given), then sample_id. ``totals``: rows per (label, stratum), where ``rows`` holds only the first of each;
    the first cell that would need more than those is put into ``short``, and the picks end there.
    """
    rows = sorted((r for r in rows if r["label"] in LABELS), key=lambda r: r["sample_id"])
    size: dict[tuple, int] = {k: n for k, n in (totals or {}).items() if k[0] in LABELS}
    if not totals:
        for r in rows:
            size[r["label"], r["stratum"]] = size.get((r["label"], r["stratum"]), 0) + 1
    n = sum(size.values())
    if not n:
        return []
    per_class = {x: sum(k for c, k in size.items() if c[0] == x) for x in LABELS}
    strata = {s: sum(k for c, k in size.items() if c[1] == s) for _, s in size}
    target = irr_target(per_class, fraction, min_per_class)
    want = {x: round(target * k / n) for x, k in per_class.items()}
    for k in range(max(0, target - sum(want.values()))):
        want[sorted(LABELS, key=lambda x: -per_class[x])[k % len(LABELS)]] += 1
    picked, per_stratum, per_label = [], dict.fromkeys(strata, 0), dict.fromkeys(LABELS, 0)

    def take(r: dict) -> None:
        picked.append(r)
        per_stratum[r["stratum"]] += 1
        per_label[r["label"]] += 1

    for k, x in enumerate(LABELS, 1):
        draw = random.Random(seed + k)
        own = [r for r in rows if r["label"] == x]
        order = [(per_stratum[r["stratum"]], strata[r["stratum"]], r["draw"] if "draw" in r else draw.random(), r["sample_id"], i) for i, r in enumerate(own)]
        for *_, i in sorted(order)[:min_per_class]:
            take(own[i])
    ids = {r["sample_id"] for r in picked}
    draw = random.Random(seed + 1000)
    cells: dict[tuple, list] = {}
    for r in rows:
        if r["sample_id"] not in ids:
            cells.setdefault((r["label"], r["stratum"]), []).append((r["draw"] if "draw" in r else draw.random(), r["sample_id"], r))
    for q in cells.values():
        q.sort(key=lambda x: x[:2], reverse=True)  # the next one is last

    held: dict[tuple, int] = {}
    for r in rows:
        held[r["label"], r["stratum"]] = held.get((r["label"], r["stratum"]), 0) + 1
    rank = lambda c: (per_stratum[c[1]], strata[c[1]], *cells[c][-1][:2])  # noqa: E731  only grows, so what a heap holds is a lower bound
    heaps = {x: [(rank(c), i, c) for i, c in enumerate(cells) if c[0] == x] for x in LABELS}
    for h in heaps.values():
        heapq.heapify(h)
    while len(picked) < target:
        best = None
        for x, h in heaps.items():
            while h and (now := rank(h[0][2])) > h[0][0]:
                heapq.heapreplace(h, (now, *h[0][1:]))
            need = max(0, want[x] - per_label[x])
            if h and (best is None or (need == 0, -need, *h[0][0]) < best[0]):
                best = ((need == 0, -need, *h[0][0]), x)
        if best is None:
            break
        _, i, c = heapq.heappop(heaps[best[1]])
        take(cells[c].pop()[2])
        if cells[c]:
            heapq.heappush(heaps[c[0]], (rank(c), i, c))
        elif short is not None and held[c] < size[c]:
            short.add(c)
            break
    return sorted(({k: v for k, v in r.items() if k != "draw"} for r in picked), key=lambda r: r["sample_id"])


def irr_target(per_class: dict[str, int], fraction: float, min_per_class: int) -> int:
    """Rows to be rated twice: the half-even share of all, one at least, and the minimum of each class."""
    n = sum(per_class.values())
    return min(n, max(1, round(n * fraction), sum(min(min_per_class, k) for k in per_class.values())))


def irr_sample(rows: DataFrame, fraction: float = 0.1, min_per_class: int = 5, seed: int = 13) -> DataFrame:
    """:func:`irr_subset` of a table of any size (sample_id, label, stratum).

    The driver sees the cells' counts and the first rows of each cell, some twice its even share of the picks: those whose draw, a
    64-bit hash, is below a bound, so nothing is sorted. Where a cell runs out in the loop, its bound is doubled and the loop starts
    again. So it sees all that the loop can reach, in proportion to the picks and not to cells times picks. Rows of a cell are
    picked in order, so the last pick of each names them all.
    """
    ok = rows.where(F.col("label").isin(*LABELS))
    counts = {(r["label"], r["stratum"]): r["count"] for r in ok.groupBy("label", "stratum").count().collect()}
    if not counts:
        return ok
    per_class: dict[str, int] = {}
    for (x, _), n in counts.items():
        per_class[x] = per_class.get(x, 0) + n
    target = irr_target(per_class, fraction, min_per_class)
    drawn = ok.withColumn("draw", F.xxhash64(F.col("sample_id").cast("string"), F.lit(seed)))
    spark, kind = rows.sparkSession, dict(rows.dtypes)
    same = lambda a, b: (a["label"] == b["_label"]) & a["stratum"].eqNullSafe(b["_stratum"])
    need = dict.fromkeys(counts, 2 * -(-target // len(counts)) + 2 * min_per_class + 20)
    wanted, known = list(counts), {}
    while wanted:
        below = {c: -(2**63) + (1 << 64) * min(need[c], counts[c]) // counts[c] - 1 for c in wanted}
        some = F.broadcast(spark.createDataFrame([(*c, x) for c, x in below.items()], f"_label string, _stratum {kind['stratum']}, _below long"))
        known |= {c: [] for c in wanted}
        for r in drawn.join(some, same(drawn, some) & (F.col("draw") <= F.col("_below")), "left_semi").select("sample_id", "label", "stratum", "draw").collect():
            known[r["label"], r["stratum"]].append(r.asDict())
        short = {c for c in wanted if len(known[c]) <= min_per_class and len(known[c]) < counts[c]}
        if not short:
            picked = irr_subset([r for c in known.values() for r in c], fraction, min_per_class, seed, counts, short)
        need |= {c: 2 * need[c] for c in short}
        wanted = list(short)
    ids = {r["sample_id"] for r in picked}
    last = [(*c, *max((r["draw"], r["sample_id"]) for r in own if r["sample_id"] in ids)) for c, own in known.items() if any(r["sample_id"] in ids for r in own)]
    ends = F.broadcast(spark.createDataFrame(last, f"_label string, _stratum {kind['stratum']}, _draw long, _id {kind['sample_id']}"))
    reached = F.struct("draw", "sample_id") <= F.struct(F.col("_draw").alias("draw"), F.col("_id").alias("sample_id"))
    return drawn.join(ends, same(drawn, ends) & reached, "left_semi").drop("draw")


#: Columns that a second rater sees.
BLINDED = {"text_only": [], "partial": ["source_year", "source_form"], "none": ["source_year", "source_form", "source_cik", "source_file", "sentence_index", "ff12_code", "ff12_name"]}


def blinded(rows: DataFrame, mode: str = "text_only") -> DataFrame:
    """The sheet for the second rater."""
    item = T.stable_id(F.col("sample_id"), F.col("sentence_id"), F.lit("irr"))
    return rows.withColumn("irr_item_id", item).select("irr_item_id", "sentence", *BLINDED[mode]).withColumns({"rater2_label": F.lit(""), "rater2_note": F.lit("")})


def pending(master: DataFrame, second: DataFrame) -> DataFrame:
    """Items without an allowed second label."""
    got = second.select("irr_item_id", T.allowed_label(F.col("rater2_label")).alias("rater2_label"))
    return master.join(got, "irr_item_id", "left").where("rater2_label is null")


def adjudication(rated: DataFrame) -> DataFrame:
    """Disagreements with their pair and transition."""
    pair = F.concat_ws("|", F.array_sort(F.array("rater1_label", "rater2_label")))
    move = F.concat(F.substring("rater1_label", 1, 1), F.lit("->"), F.substring("rater2_label", 1, 1))
    return rated.where("rater1_label <> rater2_label").withColumns({"disagreement_pair": pair, "transition": move, "final_label": F.lit(None).cast("string")})


def first_eligible(rows: DataFrame, eligible: Column, order: list[str]) -> DataFrame:
    """One row: the first eligible one, else the first, and whether that was the fallback."""
    ranked = rows.withColumn("_ok", F.coalesce(eligible, F.lit(False)))
    return ranked.orderBy(F.col("_ok").desc(), *order).limit(1).withColumn("selection_fallback", ~F.col("_ok")).drop("_ok")


#: Keys under which scores are found.
SCORE_KEYS = {"p_actionable": ("a", "actionable", "p_actionable"), "p_speculative": ("s", "speculative", "p_speculative"), "p_irrelevant": ("i", "irrelevant", "p_irrelevant")}
SCORE_NESTS = ("probs", "scores", "sims", "cos", "cosines")


def unpack_scores(json: Column, depth: int = 2) -> dict[str, Column]:
    """Scores of a JSON object whatever their keys' case or nest, nests within nests down to ``depth``; outer objects win."""
    found: dict[str, list[Column]] = {name: [] for name in SCORE_KEYS}
    level = [json]
    for d in range(depth + 1):
        below = []
        for obj in level:
            low = F.transform_keys(F.from_json(obj, "map<string,string>"), lambda k, v: F.lower(k))
            for name, keys in SCORE_KEYS.items():
                found[name] += [F.try_element_at(low, F.lit(k)).try_cast("double") for k in keys]
            if d < depth:
                below += [F.get_json_object(obj, f"$.{at}") for at in SCORE_NESTS]
        level = below
    return {name: F.coalesce(*cols) for name, cols in found.items()}


def parse_reply(text: Column, labels: tuple[str, ...] = LABELS, confidence: tuple[str, ...] = ("low", "medium", "high")) -> Column:
    """struct(label, confidence, rationale, valid) of a model's JSON reply, code fence aside."""
    body = F.regexp_replace(F.trim(text), r"^`+(?:json)?\s*|\s*`+$", "")
    r = F.from_json(body, "label string, confidence string, rationale string, assistive_only boolean")
    label, level, why = F.trim(r["label"]), F.lower(F.trim(r["confidence"])), F.trim(r["rationale"])
    valid = F.coalesce(label.isin(*labels) & level.isin(*confidence) & (why != "") & r["assistive_only"], F.lit(False))
    return F.struct(label.alias("label"), level.alias("confidence"), why.alias("rationale"), valid.alias("valid"))
