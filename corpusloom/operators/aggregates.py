"""Aggregations: firm-year counts, agreement and quality metrics, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.contracts import LABELS
from corpusloom.functions.numbers import log1p_count
from corpusloom.operators.windows import interpolated_percentiles


def label_counts(rows: DataFrame, keys: list[str], label: str, labels: tuple[str, ...] = LABELS, keep_empty: DataFrame | None = None) -> DataFrame:
    """Counts of each label per key, total and log1p of each; keys of ``keep_empty`` appear with zeros.

    One pass: the empty keys come in as rows with a null label, other labels than the listed count nowhere.
    """
    base = rows.select(*keys, F.col(label).alias("_l"))
    if keep_empty is not None:
        base = base.unionByName(keep_empty.select(*keys).distinct().withColumn("_l", F.lit(None).cast("string")))
    short = {x: x[0].upper() for x in labels}
    out = base.groupBy(*keys).agg(*[F.count_if(F.col("_l") == x).alias(f"{short[x]}_count") for x in labels], F.count_if(F.col("_l").isin(*labels)).alias("total_count"))
    return out.withColumns({f"AI_frequency{short[x]}": log1p_count(F.col(f"{short[x]}_count")) for x in labels} | {"AI_frequency_total": log1p_count(F.col("total_count"))})


def confusion(rows: DataFrame, true: str, pred: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Confusion matrix with fixed axes, zero-filled: (true, one column per label)."""
    spark = rows.sparkSession
    spine = spark.createDataFrame([(x,) for x in labels], "true string")
    got = rows.where(F.col(true).isin(*labels)).groupBy(F.col(true).alias("true")).agg(*[F.count_if(F.col(pred) == x).alias(x) for x in labels])
    return F.broadcast(spine).join(got, "true", "left").na.fill(0)


def class_metrics(rows: DataFrame, true: str, pred: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Per class: tp, support, predicted, precision, recall, f1 (0 where a denominator is 0); one pass over the rows."""
    stats = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), (F.col(true) == x).alias("t"), (F.col(pred) == x).alias("p")) for x in labels])).alias("c")
    g = rows.select(stats).groupBy("c.label").agg(F.count_if(F.expr("c.t and c.p")).alias("tp"), F.count_if(F.expr("c.t")).alias("support"), F.count_if(F.expr("c.p")).alias("predicted"))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a.cast("double") / F.nullif(b, F.lit(0)))
    g = g.withColumn("precision", safe(F.col("tp"), F.col("predicted"))).withColumn("recall", safe(F.col("tp"), F.col("support")))
    both = F.col("precision") + F.col("recall")
    return g.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0))))


def overall_metrics(rows: DataFrame, true: str, pred: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row: n, correct, accuracy, and macro means of precision, recall and f1."""
    m = class_metrics(rows, true, pred, labels).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col(true) == F.col(pred)).alias("correct"))
    return n.crossJoin(F.broadcast(m)).withColumn("accuracy", F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("n")), F.lit(0.0)))


def kappa(rows: DataFrame, a: str, b: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row: n, observed and expected agreement, Cohen's kappa (null for no rows; 1 or 0 where chance is certain)."""
    ok = rows.where(F.col(a).isin(*labels) & F.col(b).isin(*labels))
    sums = ok.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"), *[F.count_if(F.col(a) == x).alias(f"a{i}") for i, x in enumerate(labels)], *[F.count_if(F.col(b) == x).alias(f"b{i}") for i, x in enumerate(labels)])
    n = F.nullif(F.col("n"), F.lit(0)).cast("double")
    po = F.col("same") / n
    pe = sum((F.col(f"a{i}") / n * (F.col(f"b{i}") / n) for i in range(len(labels))), F.lit(0.0))
    k = F.when(F.abs(1 - pe) < 1e-12, F.when(F.abs(1 - po) < 1e-12, 1.0).otherwise(0.0)).otherwise(F.try_divide(po - pe, 1 - pe))
    return sums.select("n", po.alias("observed"), pe.alias("expected"), k.alias("kappa"))


def class_agreement(rows: DataFrame, a: str, b: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Share of the first rater's rows of each class on which the second agrees; null without any."""
    spine = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    got = rows.groupBy(F.col(a).alias("label")).agg(F.count_if(F.col(a) == F.col(b)).alias("same"), F.count("*").alias("n"))
    return F.broadcast(spine).join(got, "label", "left").select("label", F.coalesce("same", F.lit(0)).alias("same"), F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.col("same").cast("double"), F.col("n")).alias("agreement"))


def transitions(rows: DataFrame, true: str, pred: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Counts of each ordered pair of different labels ("A->S"), zero for those unseen."""
    pairs = [(x, y, f"{x[0]}->{y[0]}") for x in labels for y in labels if x != y]
    spine = rows.sparkSession.createDataFrame(pairs, "t string, p string, transition string")
    got = rows.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    return F.broadcast(spine).join(got, ["t", "p"], "left").select("transition", F.coalesce("n", F.lit(0)).alias("n"))


def share_pathologies(rows: DataFrame, key: str, label: str, labels: tuple[str, ...] = LABELS, irrelevant_at: float = 0.99, any_at: float = 0.95) -> DataFrame:
    """Per file: rows, valid and error rows, shares of each label, and reasons why the shares look wrong."""
    g = rows.groupBy(key).agg(F.count("*").alias("total_rows"), F.count_if(F.col(label).isin(*labels)).alias("valid_rows"), F.count_if(F.col(label) == "ERROR").alias("error_rows"), *[F.count_if(F.col(label) == x).alias(f"{x[0]}_count") for x in labels])
    share = {x[0]: F.when(F.col("valid_rows") == 0, 0.0).otherwise(F.col(f"{x[0]}_count") / F.nullif(F.col("valid_rows"), F.lit(0))) for x in labels}
    g = g.withColumns({f"{k}_share": v for k, v in share.items()})
    last = labels[-1][0]
    reasons = F.concat_ws("; ", F.when(F.col(f"{last}_share") >= irrelevant_at, f"{last}_share>={irrelevant_at}"), F.when(F.greatest(*[F.col(f"{x[0]}_share") for x in labels]) >= any_at, f"max_share>={any_at}"))
    return g.withColumn("pathology_reasons", reasons).withColumn("pathology_flag", F.col("pathology_reasons") != "")


def token_summary(rows: DataFrame, count: str) -> DataFrame:
    """count, min, median (interpolated), mean, max; one row."""
    one = rows.agg(F.count(count).alias("n"), F.min(count).alias("min"), F.avg(count).alias("mean"), F.max(count).alias("max"))
    middle = interpolated_percentiles(rows, count, (0.5,)).agg(F.first("_q").alias("_q"))  # one row, also without values
    return one.crossJoin(F.broadcast(middle)).select("n", "min", F.col("_q")[0].alias("median"), "mean", "max")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def flag_counts(rows: DataFrame, flags: str) -> DataFrame:
    return rows.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def missing_shares(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, share): one pass, then unpivoted."""
    one = rows.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])).alias("x")
    return one.select("_n", pairs).select("x.column", "x.missing", F.coalesce(F.try_divide(F.col("x.missing").cast("double"), F.col("_n")), F.lit(0.0)).alias("share"))


def duplicate_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """members: rows of keys that occur twice or more; extras: rows beyond the first of each key."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("members"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extras"))


def complete_keys(rows: DataFrame, key: str, part: str, parts: int) -> DataFrame:
    """Keys that have ``parts`` distinct values of ``part``."""
    return rows.groupBy(key).agg(F.count_distinct(part).alias("parts")).where(F.col("parts") == parts)


def centroids(rows: DataFrame, label: str, vector: str, dims: int | None = None) -> DataFrame:
    """(label, centroid): element-wise means in double precision; vectors of another length or with nulls don't count."""
    ok = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    ok = ok & (F.size(vector) == dims) if dims else ok
    parts = rows.where(ok).select(F.col(label).alias("label"), F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_v")).select("label", F.transform("_v", lambda s: s["m"]).alias("centroid"))


def source_windows(index: DataFrame, years: dict[str, list[int]]) -> DataFrame:
    """Per window: filings, years present, expected years missing, status."""
    spine = index.sparkSession.createDataFrame([(w, y) for w, ys in years.items() for y in ys], "source_window_id string, year int")
    per = index.groupBy("source_window_id", "year").agg(F.count("*").alias("n"))
    g = spine.join(per, ["source_window_id", "year"], "left").groupBy("source_window_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("filings"), F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.col("year")))).alias("indexed_years"), F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.col("year")))).alias("missing_years"))
    status = F.when(F.size("indexed_years") == 0, "missing").when(F.size("missing_years") == 0, "available").otherwise("incomplete")
    return g.withColumn("status", status)


def corpus_summary(index: DataFrame) -> DataFrame:
    """Filings by year, by form and by year and quarter in one grouping-sets pass: (grouping, value, n)."""
    made = index.groupingSets([["year"], ["form"], ["year", "quarter"]], "year", "form", "quarter").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "year").when(F.col("g") == 5, "form").otherwise("year_quarter")
    value = F.when(F.col("g") == 3, F.col("year").cast("string")).when(F.col("g") == 5, F.col("form")).otherwise(F.concat(F.col("year").cast("string"), F.lit(":Q"), F.col("quarter").cast("string")))
    return made.select(kind.alias("grouping"), value.alias("value"), "n")


def qa_gate(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: names of the checks violated by at least one row, and pass or fail."""
    hits = rows.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    names = F.array_compact(F.array(*[F.when(F.col(n) > 0, F.lit(n)) for n in checks]))
    return hits.select(names.alias("violations")).withColumn("status", F.when(F.size("violations") == 0, "pass").otherwise("fail"))


def usage_totals(log: DataFrame, caps: dict[str, float]) -> DataFrame:
    """Sum of each capped measure, and whether it is over its cap."""
    one = log.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in caps])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("used"), F.lit(float(v)).alias("cap"), (F.col(c) > v).alias("over")) for c, v in caps.items()])).alias("x")).select("x.*")


def run_timing(steps: DataFrame) -> DataFrame:
    """One row over (phase, command, kind, seconds, attempt): total, validation subtotal, slowest phase and command, reruns."""
    phases = steps.groupBy("phase").agg(F.sum("seconds").alias("s")).agg(F.max_by("phase", F.struct("s", "phase")).alias("slowest_phase"))
    one = steps.agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.when(F.col("kind") == "validation", F.col("seconds"))), F.lit(0.0)).alias("validation"), F.max_by("command", F.struct("seconds", "command")).alias("slowest_command"), F.count_if(F.expr("attempt > 1")).alias("reruns"))
    return one.crossJoin(F.broadcast(phases))


def repeated_blockers(blockers: DataFrame, stem: Column) -> DataFrame:
    """Blockers of the same type and command that occurred more than once, with their ids in order."""
    return blockers.groupBy("type", stem.alias("stem")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).where("n > 1")


#: Percentiles that a profile shows.
QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, min, q25, q50, q75, max, duplicates) of some numeric columns: exact interpolated quartiles,
    sample standard deviation, and on every row the number of rows of the whole table that repeat an earlier one."""
    repeated = df.groupBy(F.xxhash64(*df.columns), F.md5(F.to_json(F.struct(*df.columns)))).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))
    parts = None
    for c in columns:
        x = F.col(c).cast("double")
        one = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
        q = interpolated_percentiles(df, c, QUARTILES).agg(F.first("_q").alias("_q"))
        row = one.crossJoin(F.broadcast(q)).select(F.lit(c).alias("column"), "n", "mean", "std", "min", *[F.col("_q")[k].alias(f"q{round(100 * p)}") for k, p in enumerate(QUARTILES)], "max")
        parts = row if parts is None else parts.unionByName(row)
    return parts.crossJoin(F.broadcast(repeated))


def profile(df: DataFrame) -> DataFrame:
    """(column, kind, n, missing, distinct, min, max, mean) of every column in one pass; min, max as text, mean of numbers only, distinct values by sketch."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    plain = [(c, t) for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    mean = lambda c, t: F.avg(c) if t in numeric else F.lit(None).cast("double")
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("kind"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), F.approx_count_distinct(c).alias("distinct"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"), mean(c, t).alias("mean")) for c, t in plain]
    return df.agg(F.array(*rows).alias("p")).select(F.explode("p").alias("x")).select("x.*")


def conditional_counts(rows: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Per key: all rows, those that meet the condition (null counts as no), and their share."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(condition).alias("hits"))
    return g.withColumn("share", F.try_divide(F.col("hits").cast("double"), F.col("total")))
