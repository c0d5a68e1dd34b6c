"""The planner's data operators: task graphs, readiness, scores. Graphs are a project's tasks, a few hundred rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def topological_order(nodes: list, edges: list[tuple]) -> list:
    """Kahn's order, smallest name first among the ready; raises on a cycle."""
    import heapq

    before = {n: 0 for n in nodes}
    after: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in set(edges):
        if a in before and b in before:
            before[b] += 1
            after[a].append(b)
    ready = [n for n, k in before.items() if not k]
    heapq.heapify(ready)
    out = []
    while ready:
        n = heapq.heappop(ready)
        out.append(n)
        for m in after[n]:
            before[m] -= 1
            if not before[m]:
                heapq.heappush(ready, m)
    if len(out) != len(before):
        raise ValueError(f"cycle among {sorted(set(before) - set(out))}")
    return out


#: More nodes or edges than a project's plan can have are refused rather than gathered.
MAX_GRAPH = 200_000


def graph_metrics(spark: SparkSession, edges: DataFrame, nodes: DataFrame, limit: int = MAX_GRAPH) -> DataFrame:
    """Per node: tasks downstream (transitive) and critical-path depth; raises on a cycle.

    ``edges``: parent, child (edges to or from ids that aren't nodes don't count); ``nodes``: id. Each node's set of
    descendants is the union of its children's, taken once per edge from the leaves up, so the number of paths doesn't
    matter. The graph, ``limit`` rows at most, is a bit set per node on the driver.
    """
    ids = [r[0] for r in nodes.select("id").where("id is not null").distinct().limit(limit + 1).collect()]
    pairs = [tuple(r) for r in edges.select("parent", "child").distinct().limit(limit + 1).collect()]
    if max(len(ids), len(pairs)) > limit:
        raise ValueError(f"a task graph has {limit} nodes and edges at most")
    order = topological_order(sorted(ids), pairs)
    place = {n: k for k, n in enumerate(order)}
    children: dict = {n: [] for n in order}
    for a, b in pairs:
        if a in place and b in place:
            children[a].append(b)
    below, depth = dict.fromkeys(order, 0), dict.fromkeys(order, 1)
    for n in reversed(order):
        for c in children[n]:
            below[n] |= below[c] | 1 << place[c]
            depth[n] = max(depth[n], depth[c] + 1)
    kind = dict(nodes.dtypes)["id"]
    return spark.createDataFrame([(n, below[n].bit_count(), depth[n]) for n in order], f"id {kind}, downstream long, depth int")


def readiness(tasks: DataFrame) -> DataFrame:
    """Status of each task from its conditions, first match wins.

    Columns: deferred, missing_dependencies, policy_blocks, failed_preconditions, outputs_present,
    failed_quality (counts or booleans), manual.
    """
    status = (
        F.when(F.col("deferred"), "deferred")
        .when(F.col("missing_dependencies") > 0, "waiting_on_deps")
        .when((F.col("policy_blocks") > 0) | (F.col("failed_preconditions") > 0), "blocked_precondition")
        .when(F.col("outputs_present") & (F.col("failed_quality") == 0), "satisfied")
        .when(F.col("failed_quality") > 0, "blocked_quality")
        .when(F.col("manual"), "blocked_manual")
        .otherwise("ready")
    )
    return tasks.withColumn("status", status)


#: Weights of the task score.
WEIGHTS = {"unblock": 5, "depth": 4, "risk": 3, "automation": 2, "manual": 2, "gap": 4, "quality": 5}


def task_score(downstream: Column, depth: Column, risk: Column, automation: Column, effort: Column, gaps: Column, failed_quality: Column, w: dict | None = None) -> Column:
    """Weighted value of doing a task next; ``automation`` is full, partial or manual."""
    w = WEIGHTS | (w or {})
    bonus = F.when(automation == "full", 2).when(automation == "partial", 1).otherwise(0)
    manual = F.when(automation == "manual", effort).otherwise(0)
    return (w["unblock"] * F.least(downstream, F.lit(10)) + w["depth"] * depth + w["risk"] * risk + w["automation"] * bonus - w["manual"] * manual - w["gap"] * gaps - w["quality"] * F.when(failed_quality, 1).otherwise(0)).cast("double")


def phase_score(downstream: Column, depth: Column, gaps: Column, status: Column, w: dict | None = None) -> Column:
    """Weighted value of a phase: what it unblocks and its depth, less gaps, failed quality and manual blocks."""
    w = WEIGHTS | (w or {})
    manual = F.when(status == "blocked_manual", 1).otherwise(0)
    quality = F.when(status == "blocked_quality", 1).otherwise(0)
    return (w["unblock"] * F.least(downstream, F.lit(10)) + w["depth"] * depth - w["manual"] * manual - w["gap"] * gaps - w["quality"] * quality).cast("double")


def option_score(risk: Column, probability: Column, effort: Column, side_effects: Column) -> Column:
    return F.round(risk * 2.5 + probability * 30.0 - effort * 3.0 - side_effects * 2, 3)


def top_by_status(scored: DataFrame, n: int = 3) -> DataFrame:
    """The n best tasks of each status; ties by id."""
    rank = F.row_number().over(Window.partitionBy("status").orderBy(F.col("score").desc(), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n)


def reroute(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(task, blocked_by, alternative): for each blocked task the best ready task that doesn't depend on it.

    ``tasks``: id, status, score; ``edges``: parent, child. A blocked task's direct children can't stand in for it; of the
    rest the ready task of highest score is proposed, ties by id; null where there is none. What is joined per blocked task is
    the few best ready tasks (as many as its children, plus one), never all pairs.
    """
    width = F.coalesce(F.size("children"), F.lit(0)) + 1
    ready = tasks.where("status = 'ready'").select("id", "score")
    ranked = ready.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))
    below = edges.groupBy(F.col("parent").alias("id")).agg(F.collect_set("child").alias("children"))
    blocked = tasks.where("status like 'blocked%'").select("id", F.col("status").alias("blocked_by")).join(below, "id", "left").withColumn("children", F.coalesce("children", F.array().cast(dict(below.dtypes)["children"])))
    tried = blocked.withColumn("rank", F.explode(F.sequence(F.lit(1), width))).join(ranked.select("rank", F.col("id").alias("alternative")), "rank")
    best = tried.where(~F.array_contains("children", F.col("alternative"))).groupBy("id").agg(F.min_by("alternative", "rank").alias("alternative"))
    return blocked.select(F.col("id").alias("task"), "blocked_by").join(best.withColumnRenamed("id", "task"), "task", "left")


def duration_seconds(start: Column, end: Column) -> Column:
    """Seconds between two ISO times, 0 at least and where either can't be read."""
    s = lambda c: F.try_to_timestamp(c).cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), s(end) - s(start)), F.lit(0.0))


def document_lines(docs: DataFrame, text: str = "text", risk: str = r"(?i)\b(gate|risk|block(?:er|ed)?)\b", header: str = r"^#+ ") -> DataFrame:
    """Unique non-blank lines of each document in order, with the heading above and whether a gate or risk is named."""
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    head = F.last(F.when(F.col("line").rlike(header), F.regexp_replace("line", header, "")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos"))
    first = lines.withColumn("section", head).groupBy("doc_id", "line").agg(F.min_by(F.struct("pos", "section"), "pos").alias("x"))
    return first.select("doc_id", "x.pos", "line", "x.section", F.col("line").rlike(risk).alias("is_risk"))


def line_findings(docs: DataFrame, pattern: Column, text: str = "text") -> DataFrame:
    """(doc_id, line number, line) of lines that match."""
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.where(pattern).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def sensor(df: DataFrame, kind: str, **spec) -> DataFrame:
    """One row (kind, passed, detail) of a data-quality condition: row_count, column_values, unique, fragment_rate, json_field, required_columns, years_present."""
    from corpusloom.functions import numbers, text

    detail = {
        "row_count": lambda: F.count("*"),
        "column_values": lambda: F.count_if(~F.col(spec["column"]).isin(*spec["allowed"])),
        "unique": lambda: F.count("*") - F.count_distinct(*spec["columns"]),
        "fragment_rate": lambda: F.coalesce(F.avg(text.looks_fragmented(F.col(spec["column"])).cast("double")), F.lit(1.0)),
        "json_field": lambda: F.max(F.get_json_object(spec["column"], "$." + spec["field"])),
        "required_columns": lambda: F.lit(len([c for c in spec["columns"] if c not in df.columns])),
        "years_present": lambda: F.size(F.array_except(F.array(*map(F.lit, spec["years"])), F.collect_set(spec["column"]))),
    }[kind]()
    one = df.agg(F.count("*").alias("_n"), detail.alias("detail")) if kind == "required_columns" else df.agg(detail.alias("detail"))
    value = F.col("detail") if isinstance(spec.get("value"), str) else F.col("detail").cast("double")
    passed = numbers.compare(value, spec.get("operator", "=="), spec.get("value", 0))
    return one.select(F.lit(kind).alias("kind"), passed.alias("passed"), F.col("detail").cast("string").alias("detail"))
