"""Two-stage rule cascade over centroid scores, as one Column expression (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.numbers import cosine

#: The cascade's patterns.
PATTERNS = {
    "focus_on_ai": r"\bfocus(?:ed|es|ing)?\s+on\s+.*\b(ai|artificial intelligence)\b",
    "future_features": r"\b(future|next\s+year|plan to|planning to|intend(?:s|ed)? to)\b.*\b(feature|service|module|product|capability|capabilities)\b",
    "intend_focus": r"\bintend(?:s|ed)?\s+to\s+focus\s+on\b",
    "global_laws": r"^global operations are subject to (?:complex(?:\s*(?:and|,)?\s*changing)?|changing) laws and regulations",
    "laws_list": r"^(these|our) laws and regulations (involve|include)",
    "infrastructure": r"\b(ai|artificial intelligence)\s+infrastructure\b",
    "apply_learnings": r"applying\s+.*\s+learnings\b",
    "future_based_on_ai": r"\bfuture\b.*?(features|services).*?\bbased\s+on\b.*?(ai|artificial intelligence)\b",
    "innovating_build": r"\binnovating\s+in\s+(ai|artificial intelligence)(?:\s+technologies)?\b.*?\bto\s+build\b",
    "offering_ml": r"\boffers? (?:a )?broad set of .* including .* (machine learning|ml)\b",
    "provides_ml": r"\b(provides|offer(?:s|ing)?)\b.*\b(machine learning|ml)\b",
    "estimate": r"\brely upon? .* (techniques|algorithms|models).*(seek|seeks|aim) to estimate\b",
    "prevent_deliver": r"\b(prevent\s+us\s+from\s+delivering|prevent\s+us\s+from\s+providing)\b",
    "user_diminish": r"\b(user experience is diminished|affect the user experience)\b",
    "decreased_engagement": r"\bdecreased\s+engagement\b.*\b(internet\s+shutdowns|taxes\s+imposed\s+on\s+the\s+use\s+of\s+social\s+media)\b",
    "action": r"\b(launch|deploy|deployed|operate|operat(?:ing|es)|run|running|build|built|apply|applies|applied|recommend|recommend(?:ing|s)|develop|developed|developing|deliver|delivering|improve|improving|optimiz(?:e|es|ing)|implement|implemented|implementing|use|using|serve|serving|support|supporting)\b",
    "modal": r"\b(may|might|could|plan to|planning to|intend(?:s|ed)? to|aim to|expect to|will)\b",
    "invest_unproven": r"continue\s+to\s+invest\s+in\s+new\s+and\s+unproven\s+technologies,?\s+including\s+(ai|artificial intelligence)",
    "data_leakage": r"data\s+leakage|unauthorized\s+exposure\s+of\s+data",
    "reevaluated": r"reevaluated our data center investment strategy",
    "lawsuits": r"subject to multiple lawsuits|subject of multiple lawsuits",
    "develop_deploy": r"develop(?:ing)?\s+and\s+deploy(?:ing)?\s+ai",
}

#: Score changes in order; (patterns of which one must match, {class: change}); results below 0 become 0 on decreases.
BOOSTS = (
    (("laws_list",), {"i": 0.15, "s": -0.08}),
    (("offering_ml", "provides_ml"), {"a": 0.12}),
    (("estimate",), {"s": 0.12}),
    (("future_features",), {"a": -0.06}),
    (("apply_learnings",), {"i": 0.1, "s": 0.05, "a": -0.08}),
    (("prevent_deliver", "user_diminish"), {"a": 0.06}),
    (("invest_unproven",), {"s": 0.12, "i": -0.06}),
    (("future_based_on_ai",), {"i": 0.12, "a": -0.06}),
    (("develop_deploy",), {"a": 0.1}),
    (("global_laws",), {"s": 0.12, "i": -0.08}),
)
TAU, EPS_IRRELEVANT, MIN_TOKENS = 0.07, 0.03, 6


def has(sentence: Column, *names: str) -> Column:
    """Whether one of the named patterns occurs."""
    out = F.lit(False)
    for n in names:
        out = out | sentence.rlike("(?i)" + PATTERNS[n])
    return F.coalesce(out, F.lit(False))


def force_speculative(x: Column) -> Column:
    return (has(x, "modal") & ~has(x, "action")) | has(x, "intend_focus", "focus_on_ai", "future_features", "global_laws")


def irrelevant_gate(x: Column) -> Column:
    exempt = has(x, "focus_on_ai", "intend_focus", "future_features", "global_laws", "invest_unproven")
    plain = has(x, "infrastructure", "data_leakage", "reevaluated", "lawsuits", "decreased_engagement", "laws_list", "future_based_on_ai", "apply_learnings")
    return ~exempt & (plain | (has(x, "innovating_build") & ~has(x, "action")))


def boosted(x: Column, a: Column, s: Column, i: Column) -> dict[str, Column]:
    """Scores after the changes, folded in order because decreases stop at zero."""
    now = {"a": a, "s": s, "i": i}
    for names, changes in BOOSTS:
        hit = has(x, *names)
        for k, d in changes.items():
            now[k] = F.when(hit, F.greatest(F.lit(0.0), now[k] + d) if d < 0 else now[k] + d).otherwise(now[k])
    return now


def _largest(a: Column, s: Column, i: Column) -> Column:
    return F.when((a >= s) & (a >= i), "Actionable").when(s >= i, "Speculative").otherwise("Irrelevant")


def classify(rows: DataFrame, sentence: str, scores: tuple[str, str, str], two_stage: bool = True, boosts: bool = True, tau: float = TAU, eps: float = EPS_IRRELEVANT, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Adds label_pred, p_actionable, p_speculative, p_irrelevant, fine_margin; null scores give label "ERROR"."""
    x = F.col(sentence)
    raw = [F.col(c).cast("double") for c in scores]
    flags = rows.withColumn("_force", force_speculative(x)).withColumn("_action", has(x, "action")).withColumn("_gate", irrelevant_gate(x) if two_stage else F.lit(False))
    flags = flags.withColumn("_ops", has(x, "prevent_deliver", "user_diminish") & ~has(x, "modal")).withColumn("_short", T.token_count(x) < min_tokens)
    new = boosted(x, *raw) if boosts else dict(zip("asi", raw, strict=True))
    flags = flags.withColumns({"_a": new["a"], "_s": new["s"], "_i": new["i"]})
    rule = F.when(F.col("_force") & ~F.col("_action"), "force").when(F.col("_short"), "short").when(F.col("_gate"), "gate").when(F.col("_ops"), "ops").otherwise("fine")
    flags = flags.withColumn("rule", rule)
    a, s, i = F.col("_a"), F.col("_s"), F.col("_i")
    fine = F.when((F.abs(i - F.greatest(a, s)) < eps) & (i > 0.5) & F.lit(two_stage), "Irrelevant")
    fine = fine.when(F.abs(a - s) < tau, F.when(F.col("_force"), "Speculative").when(a >= s, "Actionable").otherwise("Speculative")).otherwise(_largest(a, s, i))
    needs = F.col("rule").isin("short", "fine")
    null = raw[0].isNull() | raw[1].isNull() | raw[2].isNull()
    by_rule = {"force": "Speculative", "gate": "Irrelevant", "ops": "Actionable"}
    label = F.when(x.isNull() | (needs & null), "ERROR")
    for k, v in by_rule.items():
        label = label.when(F.col("rule") == k, v)
    label = label.when(F.col("rule") == "short", _largest(*raw)).otherwise(fine)
    top = F.sort_array(F.array(a, s, i), asc=False)
    one = lambda name, short, fine_score: F.when(F.col("label_pred") == "ERROR", F.lit(None).cast("double")).when(F.col("rule") == "short", short).when(F.col("rule") == "fine", fine_score).otherwise((F.col("label_pred") == name).cast("double"))
    out = flags.withColumn("label_pred", label)
    out = out.withColumns({"p_actionable": one("Actionable", raw[0], a), "p_speculative": one("Speculative", raw[1], s), "p_irrelevant": one("Irrelevant", raw[2], i), "fine_margin": F.when(F.col("rule") == "fine", F.round(top[0] - top[1], 3)).otherwise(0.0)})
    return out.drop("_force", "_action", "_gate", "_ops", "_short", "_a", "_s", "_i")


def nearest_centroid(rows: DataFrame, vector: str, centroids: DataFrame) -> DataFrame:
    """Adds the centroid of largest cosine and its score; ``centroids``: (label, centroid), one row per class, broadcast.

    The cosine is exact in double precision; ties go to the smaller label.
    """
    table = F.broadcast(centroids.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("_c")))
    scored = F.transform("_c", lambda c: F.struct(cosine(F.col(vector), c["centroid"]).alias("score"), c["label"].alias("label")))
    best = F.aggregate(F.filter("_s", lambda z: z["score"].isNotNull()), F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast(dict(centroids.dtypes)["label"]).alias("label")), lambda m, z: F.when(m["score"].isNull() | (z["score"] > m["score"]), z).otherwise(m))
    out = rows.crossJoin(table).withColumn("_s", scored).withColumn("_b", best)
    return out.withColumn("nearest", F.col("_b.label")).withColumn("similarity", F.col("_b.score")).drop("_c", "_s", "_b")


def lexical_nudge(x: Column, a: Column, s: Column, step: float = 0.06) -> tuple[Column, Column]:
    """The evaluator's simple variant: action words lift the first score, modal words the second."""
    return F.when(has(x, "action"), a + step).otherwise(a), F.when(has(x, "modal"), s + step).otherwise(s)


#: The evaluator's own patterns; it isn't the cascade above, and parity isn't claimed.
EVALUATOR = {
    "list": r"\b(including|such as|as well as|among other|and other)\b",
    "category": r"\b(internet|e[- ]?commerce|web services|devices|advertis(ing|ement)|privacy|data protection|tax|employment|antitrust|tariff|omnichannel|electronic|robotics|virtual reality|blockchain|iot|cloud|edge computing)\b",
    "alongside": r"\b(is|are)\s+(?:among|alongside|one of|together with)\b",
    "generic": r"\b(discussed|topic|focus|trend|coverage|buzzword|headline)\b",
    "infrastructure": r"\bAI infrastructure such as (GPU|GPUs|accelerators)\b",
    "infrastructure_broad": r"\b(ai|artificial intelligence)\s+infrastructure\s+.*\bsuch as\b.*\b(gpu|gpus|graphics processing units|accelerators)\b",
    "data_leakage": r"^The use of AI .* (data leakage|exposure)",
    "strategy": r"reevaluated .* strategy .* artificial intelligence",
    "modal": r"\b(may|might|could|will|would|should|intend(?:s|ed)?\s+to|plan(?:s|ned)?\s+to|aims?\s+to|anticipate|seek|hope|explor(?:e|ing)|evaluat(?:e|ing))\b",
    "action": r"\b(use|uses|using|deploy|deployed|embed|embedded|launch(?:ed|es)?|implement(?:ed|s)?|roll(?:ed)?\s+out|in\s+production|operational|customers|currently\s+use|reduced|improved|increased|support\s+live\s+operations|recommend|enhance|develop|build|apply|applied|applying|improve|improving|operate|operating)\b",
    "number": r"\b\d+(?:\.\d+)?%|\b\d{2,}\b",
    "risk": r"\b(risk|liability|lawsuit|lawsuits?|legal claim|legal liability|regulators?|regulation|compliance|reputation(al)?)\b",
    "future": r"\b(will|going to|in the future|expected to|plan(?:s|ned)? to|intend(?:s|ed)? to)\b",
    "deployment": r"\b(deploy|deployed|launched?|rolled out|support live|operational|currently use)\b",
    "focus_products": r"focus(ed)? on .* (products|services).* based on AI",
    "future_features": r"future (features|services)",
    "focus_list": r"focus(ed)?\s+on\s+.*\b(ai|artificial intelligence)\b",
    "lawsuits": r"\b(subject to multiple lawsuits|subject of multiple lawsuits)\b",
    "glossary": r"\b(glossary|definition|defined as)\b",
}


def _ev(x: Column, *names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | x.rlike("(?i)" + EVALUATOR[n])
    return F.coalesce(out, F.lit(False))


def evaluator_gate(x: Column, min_tokens: int = MIN_TOKENS) -> Column:
    """The evaluator's irrelevance gate, first match wins: short and header-like lines, exemptions, lists, named cases."""
    n = T.token_count(x)
    commas, ands = F.length(F.regexp_replace(x, "[^,]", "")), F.lower(x).contains(" and ")
    dense = _ev(x, "category") & (_ev(x, "list") | (commas >= 1) | ands) & (n > 10) & ~_ev(x, "action")
    named = _ev(x, "infrastructure", "infrastructure_broad", "data_leakage", "strategy", "lawsuits") | has(x, "laws_list", "future_based_on_ai", "apply_learnings", "decreased_engagement")
    header = x.rlike(r"\p{L}") & (F.upper(x) == x)
    return (
        F.when((n < min_tokens) | x.endswith(":") | header | _ev(x, "glossary"), True)
        .when(_ev(x, "focus_products", "focus_list", "future_features") | has(x, "invest_unproven", "global_laws"), False)
        .otherwise(dense | (_ev(x, "alongside", "generic") & _ev(x, "category")) | named | (has(x, "innovating_build") & ~_ev(x, "action")))
    )


#: The evaluator's score changes in order; (own patterns, cascade patterns, own pattern that must be absent, changes).
EVALUATOR_BOOSTS = (
    (("modal",), (), None, {"s": 0.06}),
    (("action", "number"), (), None, {"a": 0.06}),
    (("risk",), (), None, {"s": 0.08}),
    (("future",), (), None, {"s": 0.05}),
    (("deployment",), (), None, {"a": 0.08}),
    ((), ("offering_ml", "provides_ml"), None, {"a": 0.12}),
    ((), ("estimate",), None, {"s": 0.12}),
    ((), ("prevent_deliver", "user_diminish"), None, {"a": 0.06}),
    ((), ("global_laws",), None, {"s": 0.12, "i": -0.08}),
    ((), ("laws_list",), None, {"i": 0.15, "s": -0.08}),
    ((), ("future_based_on_ai",), None, {"i": 0.12, "a": -0.06}),
    ((), ("apply_learnings",), None, {"i": 0.1, "s": 0.05, "a": -0.08}),
    ((), ("develop_deploy",), None, {"a": 0.1}),
    (("future_features",), (), None, {"a": -0.06}),
    ((), ("apply_learnings",), "deployment", {"i": 0.05}),
    ((), ("invest_unproven",), None, {"s": 0.12, "i": -0.06}),
)


def classify_evaluator(rows: DataFrame, sentence: str, scores: tuple[str, str, str], boosts: bool = False, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The evaluator's variant: short lines are irrelevant, and after its gate the answer is never Irrelevant."""
    x = F.col(sentence)
    now = dict(zip("asi", (F.col(c).cast("double") for c in scores), strict=True))
    if boosts:
        for own, shared, absent, changes in EVALUATOR_BOOSTS:
            hit = _ev(x, *own) | has(x, *shared)
            hit = hit & ~_ev(x, absent) if absent else hit
            for k, d in changes.items():
                now[k] = F.when(hit, F.greatest(F.lit(0.0), now[k] + d) if d < 0 else now[k] + d).otherwise(now[k])
    action = _ev(x, "action")
    force = (_ev(x, "modal") & ~action) | has(x, "intend_focus", "global_laws") | _ev(x, "focus_products", "focus_list", "future_features")
    ops = has(x, "prevent_deliver", "user_diminish") & ~_ev(x, "modal")
    rule = F.when(force & ~action, "force").when(evaluator_gate(x, min_tokens), "gate").when(ops, "ops").otherwise("fine")
    out = rows.withColumn("rule", rule).withColumns({"_a": now["a"], "_s": now["s"]})
    fine = F.when(F.col("_s") >= F.col("_a"), "Speculative").otherwise("Actionable")
    label = F.when(F.col("rule") == "force", "Speculative").when(F.col("rule") == "gate", "Irrelevant").when(F.col("rule") == "ops", "Actionable").otherwise(fine)
    spread = F.when(F.col("rule") == "fine", F.round(F.abs(F.col("_a") - F.col("_s")), 3))
    return out.withColumn("label_pred", label).withColumn("fine_margin", spread).drop("_a", "_s")


def batch_plan(files: DataFrame, outputs: DataFrame, key: str, centroids_modified=None, force: bool = False, refresh: bool = True, limit: int | None = None) -> DataFrame:
    """What a batch run does with each file: ``action`` run, skip or refresh (the centroids are newer than its output).

    ``outputs``: key and ``modified`` of what is there. Forced runs do every file; ``limit`` files in key order are
    looked at (the run's own option).
    """
    work = files.orderBy(key).limit(limit) if limit is not None else files
    there = outputs.groupBy(key).agg(F.max("modified").alias("_out"))
    old = F.lit(False) if centroids_modified is None or not refresh else F.col("_out") < F.lit(centroids_modified)
    action = F.when(F.lit(force) | F.col("_out").isNull(), "run").when(old, "refresh").otherwise("skip")
    return work.join(there, key, "left").withColumn("action", action).drop("_out")


def classify_files(sentences: DataFrame, plan: DataFrame, key: str, scores: tuple[str, str, str], **options) -> DataFrame:
    """The cascade over the sentences of the files that a :func:`batch_plan` runs or refreshes."""
    due = plan.where("action <> 'skip'").select(key).distinct()
    return classify(sentences.join(due, key, "left_semi"), "sentence", scores, **options)


def hashed_vector(sentence: Column, dims: int = 64) -> Column:
    """Stand-in for a sentence encoder: token counts in ``dims`` hash buckets, JVM-side."""
    bucket = F.transform(T.tokens(T.normalize_sentence(F.coalesce(sentence, F.lit("")))), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)))
    return T.with_value(bucket, lambda v: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(v, lambda b: b == k)).cast("float")))


def embed(rows: DataFrame, sentence: str, encode, column: str = "embedding") -> DataFrame:
    """Vectors from any encoder (a function of a list of texts to a list of vectors), in Arrow batches; null text is ""."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(sentence)).to_pylist()]
            vectors = pa.array([list(map(float, v)) for v in encode(texts)] if texts else [], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*batch.schema.names, column])

    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(column, ArrayType(FloatType()))]))
