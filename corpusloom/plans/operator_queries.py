"""Queries of operators that no other query exercises: contracts, joins, scalar functions, sampling, cascade, planner."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom import contracts
from corpusloom.functions import numbers as N
from corpusloom.functions import text as T
from corpusloom.operators import aggregates as A
from corpusloom.operators import classify as C
from corpusloom.operators import labeling as L
from corpusloom.operators import planner as P
from corpusloom.operators import regression as G
from corpusloom.operators import relational as R
from corpusloom.operators import sentences as S
from corpusloom.operators import windows as W
from corpusloom.plans.registry import query
from corpusloom.plans.text_queries import _KEPT, _TOKENS, SENTENCES, _sentences


@query("SELECT c_custkey AS id, c_mktsegment AS segment, c_name, c_acctbal AS balance, 'x' AS note FROM customer")
def p1_contract_columns(t):
    """Synonyms copied, defaults added, preferred columns first."""
    df = contracts.with_synonyms(t.customer.select("c_name", "c_custkey", "c_acctbal", "c_mktsegment"), {"id": ("key", "C_CUSTKEY"), "segment": ("c_mktsegment",), "balance": ("bal", "c_acctbal")})
    df = contracts.order_columns(contracts.with_defaults(df, {"note": "x", "balance": 0.0}), ["id", "segment", "absent"])
    contracts.require_columns(df, ["id", "segment", "note"])
    assert df.columns[:2] == ["id", "segment"]
    return df.select("id", "segment", "c_name", "balance", "note")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def p2_duplicate_keys(t):
    return contracts.duplicate_keys(t.orders, ["o_custkey"])


@query(rf"""WITH {SENTENCES}, s AS (SELECT lang, {_TOKENS.format('sentence')} AS k, regexp_matches(sentence, '[.?!]$') AND NOT regexp_matches(sentence, '^\p{{Ll}}') AND NOT regexp_matches(sentence, '[-–—]\s*\d+\s*[-–—]') AS whole FROM sentences)
 SELECT lang, count(*) AS n FROM s WHERE k BETWEEN 6 AND 120 AND whole GROUP BY lang""")
def h1_eligible(t):
    """Sentences that may be labelled: 6 to 120 tokens, fragment score 0."""
    s = _sentences(t).select("lang", T.token_count(F.col("sentence")).alias("token_count"), T.fragment_score(T.integrity_flags(F.col("sentence"))).alias("fragment_score"))
    return W.eligible_sentences(s).groupBy("lang").agg(F.count("*").alias("n"))


_ODD = "x AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN CAST('inf' AS DOUBLE) WHEN c_custkey % 3 = 0 THEN CAST('nan' AS DOUBLE) ELSE c_acctbal END AS v FROM customer)"


def _odd(t):
    k = F.col("c_custkey")
    v = F.when(k % 7 == 0, F.lit(None).cast("double")).when(k % 5 == 0, float("inf")).when(k % 3 == 0, float("nan")).otherwise(F.col("c_acctbal"))
    return t.customer.select("c_custkey", v.alias("v"))


@query(f"WITH {_ODD} SELECT c_custkey, v FROM x WHERE v IS NOT NULL AND isfinite(v)")
def h2_finite_rows(t):
    """Rows without nulls, NaN or infinities."""
    return _odd(t).withColumn("v", N.finite(F.col("v"))).na.drop(subset=["v"])


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS cash, CASE WHEN c_nationkey = 0 THEN CASE WHEN c_acctbal > 0 THEN 'inf' WHEN c_acctbal < 0 THEN '-inf' ELSE 'nan' END ELSE 'finite' END AS kind, coalesce(TRY_CAST(substr(c_name, 1, 1) AS DOUBLE), -0.3) AS filled, abs(-c_acctbal) * c_nationkey AS cap, round_even(c_nationkey / 2.0, 0) AS half FROM customer")
def h3_numbers(t):
    """Negatives to null, the ratio without a guard, coercion with a fill, market capitalisation, half-even rounding."""
    n, b = F.col("c_nationkey"), F.col("c_acctbal")
    r = N.ratio_unguarded(b, n)
    kind = F.when(F.isnan(r), "nan").when(r == float("inf"), "inf").when(r == float("-inf"), "-inf").otherwise("finite")
    return t.customer.select("c_custkey", N.non_negative(b).alias("cash"), kind.alias("kind"), N.numeric(F.substring("c_name", 1, 1), -0.3).alias("filled"), N.market_cap(-b, n).alias("cap"), N.half_even(n / 2).cast("double").alias("half"))


@query("SELECT c_custkey, o.n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def j1_one_to_one(t):
    right = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return R.join_one_to_one(t.customer.select("c_custkey"), right, ["c_custkey"])


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders), s AS (SELECT o_custkey AS k, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F')
 SELECT o.k, o.v, s.v AS v_ctrl FROM o LEFT JOIN s ON s.k = o.k AND s.r = 1 WHERE o.r = 1""")
def j2_keep_last_join(t):
    order = ["o_orderdate", "o_orderkey"]
    left = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), *order)
    right = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), *order)
    return R.join_keep_last(left, right, ["k"], order).select("k", "v", "v_ctrl")


@query("SELECT s_suppkey AS irr_item_id FROM supplier WHERE s_suppkey % 4 <> 1")
def j3_pending(t):
    """Items of which the second rater's label is absent or not an allowed one."""
    k = F.col("s_suppkey")
    second = t.supplier.where(k % 2 == 1).select(k.alias("irr_item_id"), F.when(k % 4 == 1, " Actionable ").otherwise("Unsure").alias("rater2_label"))
    return L.pending(t.supplier.select(k.alias("irr_item_id")), second).select("irr_item_id")


@query("SELECT c_custkey, s_name, CASE WHEN s_name IS NULL THEN 'gap' ELSE 'complete' END AS part FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > 8000")
def j4_complete_and_gaps(t):
    rich = t.supplier.where("s_acctbal > 8000").select(F.col("s_nationkey").alias("c_nationkey"), "s_name")
    complete, gaps = R.split_complete(t.customer.select("c_custkey", "c_nationkey"), rich, "c_nationkey", "s_name")
    return complete.withColumn("part", F.lit("complete")).unionByName(gaps.withColumn("part", F.lit("gap"))).select("c_custkey", "s_name", "part")


@query("SELECT DISTINCT c_custkey, coalesce(s.s_name, g.n, c_name) AS name FROM customer LEFT JOIN supplier s ON s.s_suppkey = c_custkey LEFT JOIN (SELECT n_nationkey, n_name AS n FROM nation WHERE n_regionkey < 3) g ON g.n_nationkey = c_nationkey")
def j5_enriched_names(t):
    rows = t.customer.select("c_custkey", F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("tic"), "c_name")
    by_id = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    by_tic = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("tic"), F.col("n_name").alias("name"))
    return R.enrich_name(rows, by_id, by_tic, "id", "tic", "name", "c_name").select("c_custkey", "name")


@query(r"SELECT s.p_partkey, b.firm, min(b.p_name) AS term FROM part s, (SELECT DISTINCT p_name, p_size AS firm FROM part) b WHERE contains(' ' || s.p_name || ' ', ' ' || b.p_name || ' ') GROUP BY 1, 2")
def j6_phrases_per_firm(t):
    """Every part's name as a term of the firm of its size; each (patent, firm) once."""
    terms = t.part.select(F.col("p_size").alias("firm"), F.col("p_name").alias("term")).distinct()
    return R.match_phrases(t.part.select("p_partkey", "p_name"), "p_name", terms, "term", "firm", "p_partkey")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
def k1_union_all(t):
    r = t.region.select(F.col("r_name").alias("name"))
    return t.nation.select(F.col("n_name").alias("name")).unionByName(r).unionByName(r)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT r_regionkey + 100 FROM region")
def k2_union(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).union(t.region.select(F.col("r_regionkey") + 100)).distinct()


@query(r"""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS uncertain, CASE n_nationkey % 4 WHEN 0 THEN n_nationkey WHEN 1 THEN -n_nationkey END AS whole, lower(n_name) || 's own' AS org,
 CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS sic2, n_name || ' a b' AS plain, CASE n_nationkey % 3 WHEN 0 THEN 'tool.py' WHEN 1 THEN n_name ELSE 'unknown' END AS stem FROM nation""")
def m1_text_functions(t):
    """Flags, truncated integers, organisation names, two-digit industries, quotes, command stems."""
    k = F.col("n_nationkey")
    flag = F.element_at(F.array(F.lit(" Yes "), F.lit("no"), F.lit("2")), k % 3 + 1)
    number = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(".9 "))).when(k % 4 == 1, F.concat(F.lit("-"), k.cast("string"))).when(k % 4 == 2, F.lit("nan")).otherwise("x")
    sic = F.when(k % 2 == 0, F.concat((k * 100 + 99).cast("string"), F.lit(".0"))).otherwise("n/a")
    message = F.when(k % 3 == 0, F.lit("Step command failed: /usr/bin/tool.py --x 1")).when(k % 3 == 1, F.col("n_name"))
    return t.nation.select("n_nationkey", T.is_true(flag).alias("uncertain"), T.safe_int(number).alias("whole"), T.clean_org(F.concat("n_name", F.lit("'s: own!"))).alias("org"), T.sic2(sic).alias("sic2"), T.strip_quotes(F.concat(F.lit(" “'"), "n_name", F.lit("  a\tb\" "))).alias("plain"), T.command_stem(message).alias("stem"))


@query(r"""WITH l AS (SELECT doc_id, trim(x) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE NOT regexp_matches(x, '^[ -~]*[^ -~]')),
 f AS (SELECT doc_id, s = '' OR len(list_filter(string_split_regex(s, '\s+'), lambda t: t <> '')) < 5 OR NOT regexp_matches(s, '[.!?]$') OR regexp_matches(s, '^[^a-zA-Z]*[a-z]') OR regexp_matches(s, '^[(\[]?[a-z0-9][)\]]?\s') OR regexp_matches(s, '[;:,]$') AS bad FROM l)
 SELECT doc_id, count(*) AS lines, count(*) FILTER (bad) AS fragments FROM f GROUP BY doc_id""")
def m2_looks_fragmented(t):
    """ASCII lines that look like fragments, per document."""
    lines = t.texts.select("doc_id", F.explode(F.split("text", "\n")).alias("s")).where(~F.col("s").rlike(r"^[ -~]*[^ -~]")).select("doc_id", F.trim("s").alias("s"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(T.looks_fragmented(F.col("s"))).alias("fragments"))


@query("SELECT o_orderkey, greatest(0, o_orderkey % 50 - o_orderkey % 41) AS page_merges, greatest(0, o_orderkey % 41 - o_orderkey % 37) AS sentence_merges FROM orders")
def n1_merge_accounting(t):
    k = F.col("o_orderkey")
    out = S.merge_accounting(t.orders.select("o_orderkey", (k % 50).alias("segmented"), (k % 41).alias("after_page"), (k % 37).alias("after_sentence")))
    return out.select("o_orderkey", "page_merges", "sentence_merges")


@query(rf"""WITH {SENTENCES}, n AS (SELECT doc_id, count(*) AS segmented, count(*) FILTER ({_KEPT}) AS kept FROM sentences GROUP BY doc_id),
 d AS (SELECT d.doc_id, lang, CASE WHEN d.doc_id % 11 = 0 THEN 'error' WHEN d.doc_id % 7 = 0 THEN 'skipped_exists' WHEN coalesce(kept, 0) > 0 THEN 'ok' ELSE 'empty' END AS status, coalesce(segmented, 0) AS segmented, coalesce(kept, 0) AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id)
 SELECT lang, count(*) AS documents, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'skipped_exists') AS skipped_exists, count(*) FILTER (status = 'error') AS error,
 CAST(sum(CASE WHEN status IN ('ok', 'empty') THEN segmented ELSE 0 END) AS BIGINT) AS segmented, CAST(sum(CASE WHEN status IN ('ok', 'empty') THEN kept ELSE 0 END) AS BIGINT) AS kept FROM d GROUP BY lang""")
def n2_run_totals(t):
    """Totals per language of a run in which some documents were done before and some can't be read."""
    docs = t.texts.select("doc_id", "lang", "text")
    ids = t.documents.select("doc_id")
    status = S.extraction_status(docs, list(S.AI_KEYWORDS), done=ids.where("doc_id % 7 = 0"), failed=ids.where("doc_id % 11 = 0"))
    return S.status_totals(status.join(t.documents.select("doc_id", "lang"), "doc_id"), "lang")


_RULE_TIER = SENTENCES.replace("coalesce(text, '')", "regexp_replace(coalesce(text, ''), '\\b(" + "|".join(S.ABBREVIATIONS) + "|[A-Z])\\.(\\s)', '\\1' || chr(30) || '\\2', 'g')").replace("x <> '')", "x <> '')").replace("parts[i] AS sentence", "replace(parts[i], chr(30), '.') AS sentence")


@query(rf"""WITH {_RULE_TIER}, k AS (SELECT doc_id, sentence_index, sentence FROM sentences WHERE regexp_matches(sentence, '(?i)(^|[^\p{{L}}\p{{N}}_])(artificial intelligence|machine learning|AI|deep learning)([^\p{{L}}\p{{N}}_]|$)')),
 w AS (SELECT *, regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]') AS ws FROM k),
 c AS (SELECT doc_id, sentence_index, sentence, len(list_filter(ws, lambda x: x = 'that')) AS concrete, len(list_filter(ws, lambda x: x IN ('is', 'was'))) AS vague FROM w)
 SELECT doc_id, sentence_index, sentence, concrete, vague, CASE WHEN concrete + vague = 0 THEN 0.0 ELSE concrete / (concrete + vague) END AS score FROM c""")
def n3_rule_tier(t):
    """The second segmenter tier with its own keywords and term scores."""
    out = S.clean_filings(t.texts.select("doc_id", "text"), ["that"], ["is", "was"])
    return out.withColumns({c: F.col(c).cast("long") for c in ("concrete", "vague")})


@query("SELECT * FROM (VALUES " + ", ".join(f"({k})" for k in random.Random(42).sample(range(25), 10)) + ") x(n_nationkey)")
def q1_sampled_entities(t):
    """Ten of the 25 nations by the seeded generator over their sorted keys."""
    ids = W.sample_entities([r[0] for r in t.nation.select("n_nationkey").collect()], 10)
    return t.spark.createDataFrame([(k,) for k in ids], "n_nationkey int")


_SHARES = "SELECT k, CAST(503 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY k) <= 503 % count(*) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota"


@query(f"{_SHARES} FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS k FROM orders)")
def q2_year_quotas(t):
    have = {r[0]: r[1] for r in t.orders.groupBy(F.year("o_orderdate")).count().collect()}
    return t.spark.createDataFrame(list(W.allocate_years(have, 503).items()), "k int, quota long")


@query(f"{_SHARES} FROM (SELECT DISTINCT CAST(quarter(o_orderdate) AS INTEGER) AS k FROM orders)")
def q3_quarter_quotas(t):
    have = {r[0]: r[1] for r in t.orders.groupBy(F.quarter("o_orderdate")).count().collect()}
    return t.spark.createDataFrame(list(W.allocate(have, 503).items()), "k int, quota long")


@query()
def q4_priority_sample(t):
    """200 orders by year quotas, suggested labels, edge cases and buckets."""
    k = F.col("o_orderkey")
    rows = t.orders.select(k.alias("id"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") == "F", "Actionable").when(F.col("o_orderstatus") == "O", "Speculative").alias("label"), F.substring("o_orderpriority", 1, 1).alias("bucket"), (k % 9 == 0).alias("edge"), F.when(k % 5 == 0, "short").otherwise("long").alias("length_bin"))
    return W.priority_sample(rows, 200, 40)


@query()
def q5_irr_sample(t):
    """A hundredth of the orders to be rated twice, spread over classes and strata."""
    label = F.when(F.col("o_orderstatus") == "F", "Actionable").when(F.col("o_orderstatus") == "O", "Speculative").otherwise("Irrelevant")
    return L.irr_sample(t.orders.select(F.col("o_orderkey").alias("sample_id"), label.alias("label"), F.concat(F.year("o_orderdate").cast("string"), F.lit("|"), "o_orderpriority").alias("stratum")), 0.01, 20)


@query("SELECT CAST(20 AS BIGINT) AS n")
def q6_spot_check(t):
    """An unseeded sample: only its size is fixed."""
    return W.spot_check(t.nation.select("n_nationkey"), 20).agg(F.count("*").alias("n"))


@query("""SELECT 'c_acctbal' AS "column", count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, min(c_acctbal) AS min, round(quantile_cont(c_acctbal, 0.25), 6) AS q25, round(quantile_cont(c_acctbal, 0.5), 6) AS q50, round(quantile_cont(c_acctbal, 0.75), 6) AS q75, max(c_acctbal) AS max, CAST(0 AS BIGINT) AS duplicates FROM customer
 UNION ALL SELECT 'c_nationkey', count(c_nationkey), round(avg(c_nationkey), 6), round(stddev_samp(c_nationkey), 6), min(c_nationkey), round(quantile_cont(CAST(c_nationkey AS DOUBLE), 0.25), 6), round(quantile_cont(CAST(c_nationkey AS DOUBLE), 0.5), 6), round(quantile_cont(CAST(c_nationkey AS DOUBLE), 0.75), 6), max(c_nationkey), CAST(0 AS BIGINT) FROM customer""")
def r1_describe(t):
    out = A.describe(t.customer, ["c_acctbal", "c_nationkey"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@query("SELECT 'm' AS model, n_name AS term, printf('%.3f%s (%.3f)', n_nationkey / 7.0, CASE WHEN n_nationkey < 3 THEN '***' WHEN n_nationkey < 9 THEN '**' WHEN n_nationkey < 15 THEN '*' ELSE '' END, 0.25) AS cell FROM nation")
def r2_journal_table(t):
    k = F.col("n_nationkey")
    p = F.when(k < 3, 0.005).when(k < 9, 0.03).when(k < 15, 0.07).otherwise(0.5)
    return G.journal_table(t.nation.select(F.lit("m").alias("model"), F.col("n_name").alias("term"), (k / 7.0).alias("coef"), F.lit(0.25).alias("se"), p.alias("p")))


@query("SELECT CAST(n_nationkey AS INTEGER) AS id, CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS position FROM nation")
def g5_topological_order(t):
    """Every edge leads to a larger key, so the order with the smallest ready task first is that of the keys."""
    nodes = sorted((r[0] for r in t.nation.select("n_nationkey").collect()), reverse=True)
    order = P.topological_order(nodes, [(a, b) for a in nodes for b in (2 * a + 1, 2 * a + 2, a + 7) if b < 25])
    return t.spark.createDataFrame([(n, k) for k, n in enumerate(order, 1)], "id int, position int")


@query("SELECT n_nationkey AS id, CAST(5 * least(n_nationkey, 10) + 4 * (n_nationkey % 4) - 2 * CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END - 4 * (n_nationkey % 3) - 5 * CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM nation")
def g6_phase_scores(t):
    k = F.col("n_nationkey")
    status = F.when(F.col("n_regionkey") == 1, "blocked_manual").when(F.col("n_regionkey") == 2, "blocked_quality").otherwise("ready")
    return t.nation.select(k.alias("id"), P.phase_score(k, k % 4, k % 3, status).alias("score"))


_REROUTE = "k AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'ready' WHEN n_nationkey % 3 = 1 THEN 'blocked_quality' ELSE 'waiting_on_deps' END AS status, CAST(n_nationkey % 10 AS DOUBLE) AS score FROM nation)"


@query(f"WITH {_REROUTE}, c AS (SELECT b.id AS task, b.status AS blocked_by, r.id AS alternative, row_number() OVER (PARTITION BY b.id ORDER BY r.score DESC, r.id) AS rn FROM k b LEFT JOIN k r ON r.status = 'ready' AND r.id NOT IN (2 * b.id + 1, 2 * b.id + 2, b.id + 8) WHERE b.status LIKE 'blocked%') SELECT task, blocked_by, alternative FROM c WHERE rn = 1")
def g7_reroute(t):
    k = F.col("n_nationkey")
    status = F.when(k % 3 == 0, "ready").when(k % 3 == 1, "blocked_quality").otherwise("waiting_on_deps")
    edges = t.nation.select(k.alias("parent"), F.explode(F.array(k * 2 + 1, k * 2 + 2, k + 8)).alias("child"))
    return P.reroute(t.nation.select(k.alias("id"), status.alias("status"), (k % 10).cast("double").alias("score")), edges)


@query("""SELECT 'row_count' AS kind, count(*) >= 10 AS passed FROM orders UNION ALL SELECT 'column_values', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) = 0 FROM orders UNION ALL SELECT 'unique', count(*) = count(DISTINCT o_orderkey) FROM orders
 UNION ALL SELECT 'fragment_rate', FALSE UNION ALL SELECT 'json_field', TRUE UNION ALL SELECT 'required_columns', FALSE UNION ALL SELECT 'years_present', len(list_filter([1995, 1996, 2030], lambda y: y NOT IN (SELECT year(o_orderdate) FROM orders))) = 0 FROM (SELECT 1)""".replace("len(list_filter([1995, 1996, 2030], lambda y: y NOT IN (SELECT year(o_orderdate) FROM orders))) = 0 FROM (SELECT 1)", "count(DISTINCT year(o_orderdate)) FILTER (year(o_orderdate) IN (1995, 1996, 2030)) = 3 FROM orders"))
def g8_sensors(t):
    """The seven kinds of data-quality conditions."""
    o = t.orders.withColumn("year", F.year("o_orderdate"))
    made = [
        P.sensor(o, "row_count", operator=">=", value=10),
        P.sensor(o, "column_values", column="o_orderstatus", allowed=["F", "O"]),
        P.sensor(o, "unique", columns=["o_orderkey"]),
        P.sensor(t.part, "fragment_rate", column="p_name", operator="<=", value=0.5),
        P.sensor(t.region.select(F.to_json(F.struct(F.struct(F.lit(3).alias("b")).alias("a"))).alias("j")), "json_field", column="j", field="a.b", value="3"),
        P.sensor(o, "required_columns", columns=["o_orderkey", "absent"]),
        P.sensor(o, "years_present", column="year", years=[1995, 1996, 2030]),
    ]
    out = made[0]
    for x in made[1:]:
        out = out.unionByName(x)
    return out.select("kind", "passed")


def _sql(name: str, column: str = "sentence") -> str:
    table = C.EVALUATOR if name.startswith("ev:") else C.PATTERNS
    return f"regexp_matches({column}, '(?i){table[name.removeprefix('ev:')]}')"


def _any(*names: str) -> str:
    return "(" + " OR ".join(map(_sql, names)) + ")"


def _folded(source: str, steps: list[tuple[str, dict[str, float]]]) -> str:
    """SQL that applies score changes one after the other; decreases stop at zero."""
    for hit, changes in steps:
        parts = ", ".join(f"CASE WHEN {hit} THEN {f'greatest(0.0, {k} + ({d}))' if d < 0 else f'{k} + {d}'} ELSE {k} END AS {k}" for k, d in changes.items())
        source = f"(SELECT * REPLACE ({parts}) FROM {source})"
    return source


_SCORED = f"(SELECT sentence, {_TOKENS.format('sentence')} AS n, 0.4 + {_TOKENS.format('sentence')} / 200.0 AS a, CAST(0.45 AS DOUBLE) AS s, CAST(0.3 AS DOUBLE) AS i FROM sentences WHERE {_KEPT})"
_BOOSTED = _folded("raw", [(_any(*names), changes) for names, changes in C.BOOSTS])
_FORCE = f"(({_sql('modal')} AND NOT {_sql('action')}) OR {_any('intend_focus', 'focus_on_ai', 'future_features', 'global_laws')})"
_GATE = f"(NOT {_any('focus_on_ai', 'intend_focus', 'future_features', 'global_laws', 'invest_unproven')} AND ({_any('infrastructure', 'data_leakage', 'reevaluated', 'lawsuits', 'decreased_engagement', 'laws_list', 'future_based_on_ai', 'apply_learnings')} OR ({_sql('innovating_build')} AND NOT {_sql('action')})))"
CASCADE_SQL = rf"""WITH {SENTENCES}, raw AS (SELECT *, a AS a0, s AS s0, i AS i0 FROM {_SCORED}), b AS {_BOOSTED},
 r AS (SELECT *, {_FORCE} AS force, CASE WHEN {_FORCE} AND NOT {_sql('action')} THEN 'force' WHEN n < 6 THEN 'short' WHEN {_GATE} THEN 'gate' WHEN {_any('prevent_deliver', 'user_diminish')} AND NOT {_sql('modal')} THEN 'ops' ELSE 'fine' END AS rule FROM b),
 l AS (SELECT rule, CASE rule WHEN 'force' THEN 'Speculative' WHEN 'gate' THEN 'Irrelevant' WHEN 'ops' THEN 'Actionable'
  WHEN 'short' THEN CASE WHEN a0 >= s0 AND a0 >= i0 THEN 'Actionable' WHEN s0 >= i0 THEN 'Speculative' ELSE 'Irrelevant' END
  ELSE CASE WHEN abs(i - greatest(a, s)) < 0.03 AND i > 0.5 THEN 'Irrelevant' WHEN abs(a - s) < 0.07 THEN CASE WHEN force THEN 'Speculative' WHEN a >= s THEN 'Actionable' ELSE 'Speculative' END
   WHEN a >= s AND a >= i THEN 'Actionable' WHEN s >= i THEN 'Speculative' ELSE 'Irrelevant' END END AS label_pred FROM r)
 SELECT label_pred, rule, count(*) AS n FROM l GROUP BY 1, 2"""


@query(CASCADE_SQL)
def e5_rule_cascade(t):
    """Rule cascade over keyword sentences with lexical stand-in scores (no encoder offline): label counts."""
    s = S.keyword_filter(_sentences(t), list(S.AI_KEYWORDS))
    n = T.token_count(F.col("sentence")).cast("double")
    s = s.withColumns({"a": F.lit(0.4) + n / 200, "s": F.lit(0.45), "i": F.lit(0.3)})
    return C.classify(s, "sentence", ("a", "s", "i")).groupBy("label_pred", "rule").agg(F.count("*").alias("n"))


def _ev(*names: str) -> str:
    return _any(*(f"ev:{n}" for n in names))


_EV_BOOSTED = _folded("raw", [(" AND ".join(filter(None, [_any(*(f"ev:{n}" for n in own), *shared), f"NOT {_ev(absent)}" if absent else ""])), changes) for own, shared, absent, changes in C.EVALUATOR_BOOSTS])
_EV_FORCE = f"(({_ev('modal')} AND NOT {_ev('action')}) OR {_any('intend_focus', 'global_laws')} OR {_ev('focus_products', 'focus_list', 'future_features')})"
_EV_DENSE = f"({_ev('category')} AND ({_ev('list')} OR contains(sentence, ',') OR contains(lower(sentence), ' and ')) AND n > 10 AND NOT {_ev('action')})"
_EV_NAMED = f"({_ev('infrastructure', 'infrastructure_broad', 'data_leakage', 'strategy', 'lawsuits')} OR {_any('laws_list', 'future_based_on_ai', 'apply_learnings', 'decreased_engagement')})"
_EV_GATE = rf"""CASE WHEN n < 6 OR sentence LIKE '%:' OR (regexp_matches(sentence, '\p{{L}}') AND upper(sentence) = sentence) OR {_ev('glossary')} THEN TRUE
 WHEN {_ev('focus_products', 'focus_list', 'future_features')} OR {_any('invest_unproven', 'global_laws')} THEN FALSE
 ELSE {_EV_DENSE} OR ({_ev('alongside', 'generic')} AND {_ev('category')}) OR {_EV_NAMED} OR ({_sql('innovating_build')} AND NOT {_ev('action')}) END"""
EVALUATOR_SQL = rf"""WITH {SENTENCES}, raw AS (SELECT * FROM {_SCORED}), b AS {_EV_BOOSTED},
 r AS (SELECT *, CASE WHEN {_EV_FORCE} AND NOT {_ev('action')} THEN 'force' WHEN {_EV_GATE} THEN 'gate' WHEN {_any('prevent_deliver', 'user_diminish')} AND NOT {_ev('modal')} THEN 'ops' ELSE 'fine' END AS rule FROM b)
 SELECT CASE rule WHEN 'force' THEN 'Speculative' WHEN 'gate' THEN 'Irrelevant' WHEN 'ops' THEN 'Actionable' ELSE CASE WHEN s >= a THEN 'Speculative' ELSE 'Actionable' END END AS label_pred, rule, count(*) AS n FROM r GROUP BY 1, 2"""


@query(EVALUATOR_SQL)
def e6_evaluator_variant(t):
    """The evaluator's cascade over keyword sentences with lexical stand-in scores: label counts."""
    s = S.keyword_filter(_sentences(t), list(S.AI_KEYWORDS))
    s = s.withColumns({"a": F.lit(0.4) + T.token_count(F.col("sentence")) / 200, "s": F.lit(0.45), "i": F.lit(0.3)})
    return C.classify_evaluator(s, "sentence", ("a", "s", "i"), boosts=True).groupBy("label_pred", "rule").agg(F.count("*").alias("n"))


#: A sentence for each of the cascade's rules and most of its patterns.
RULES = (
    "We may explore new options for artificial intelligence in every region.",
    "AI helps.",
    "We provide AI infrastructure to several regional customers of ours.",
    "Bad weather could not prevent us from delivering AI systems.",
    "Outages prevent us from delivering AI systems to the regions.",
    "We intend to focus on artificial intelligence and build products with it.",
    "Our group offers a broad set of services including cloud and machine learning.",
    "These laws and regulations involve AI and privacy and much else besides.",
    "Applying our learnings to AI makes the teams much better each year.",
    "We are subject to multiple lawsuits about AI and its output.",
    "We develop and deploy AI across our stores to improve operations.",
    "Global operations are subject to complex and changing laws and regulations about AI.",
    "We continue to invest in new and unproven technologies, including AI and others.",
    "We are innovating in AI technologies and hope to build the next thing.",
    "In the future our services will be based on AI to a large extent.",
    "We rely upon the techniques of AI that seek to estimate demand.",
    "Decreased engagement with AI followed the internet shutdowns of last year.",
)
_RULE_ROWS = ", ".join("({}, '{}')".format(k, s.replace("'", "''")) for k, s in enumerate(RULES))
_RULE_SENTENCES = f"x(id, sentence) AS (VALUES {_RULE_ROWS}), sc(j, a, s, i) AS (VALUES (0, 0.55, 0.5, 0.3), (1, 0.3, 0.6, 0.58), (2, 0.2, 0.1, 0.9), (3, NULL, 0.4, 0.4)), raw AS (SELECT *, CAST(a AS DOUBLE) AS a0, CAST(s AS DOUBLE) AS s0, CAST(i AS DOUBLE) AS i0, {_TOKENS.format('sentence')} AS n FROM x, (SELECT j, CAST(a AS DOUBLE) AS a, CAST(s AS DOUBLE) AS s, CAST(i AS DOUBLE) AS i FROM sc))"


def _rule_rows(t):
    scores = [(0, 0.55, 0.5, 0.3), (1, 0.3, 0.6, 0.58), (2, 0.2, 0.1, 0.9), (3, None, 0.4, 0.4)]
    rows = [(k, x, *z) for k, x in enumerate(RULES) for z in scores]
    return t.spark.createDataFrame(rows, "id int, sentence string, j int, a double, s double, i double")


@query(rf"""WITH {_RULE_SENTENCES}, b AS {_BOOSTED}, r AS (SELECT *, {_FORCE} AS force, CASE WHEN {_FORCE} AND NOT {_sql('action')} THEN 'force' WHEN n < 6 THEN 'short' WHEN {_GATE} THEN 'gate' WHEN {_any('prevent_deliver', 'user_diminish')} AND NOT {_sql('modal')} THEN 'ops' ELSE 'fine' END AS rule FROM b),
 l AS (SELECT *, CASE WHEN rule IN ('short', 'fine') AND a0 IS NULL THEN 'ERROR' ELSE CASE rule WHEN 'force' THEN 'Speculative' WHEN 'gate' THEN 'Irrelevant' WHEN 'ops' THEN 'Actionable'
  WHEN 'short' THEN CASE WHEN a0 >= s0 AND a0 >= i0 THEN 'Actionable' WHEN s0 >= i0 THEN 'Speculative' ELSE 'Irrelevant' END
  ELSE CASE WHEN abs(i - greatest(a, s)) < 0.03 AND i > 0.5 THEN 'Irrelevant' WHEN abs(a - s) < 0.07 THEN CASE WHEN force THEN 'Speculative' WHEN a >= s THEN 'Actionable' ELSE 'Speculative' END
   WHEN a >= s AND a >= i THEN 'Actionable' WHEN s >= i THEN 'Speculative' ELSE 'Irrelevant' END END END AS label_pred FROM r)
 SELECT id, j, rule, label_pred, round(CASE WHEN label_pred = 'ERROR' THEN NULL WHEN rule = 'short' THEN a0 WHEN rule = 'fine' THEN a WHEN label_pred = 'Actionable' THEN 1 ELSE 0 END, 6) AS p_actionable,
 round(CASE WHEN label_pred = 'ERROR' THEN NULL WHEN rule = 'short' THEN i0 WHEN rule = 'fine' THEN i WHEN label_pred = 'Irrelevant' THEN 1 ELSE 0 END, 6) AS p_irrelevant FROM l""")
def e8_cascade_rules(t):
    """The cascade on a sentence for each rule with four score triples, one of them unknown."""
    out = C.classify(_rule_rows(t), "sentence", ("a", "s", "i"))
    return out.select("id", "j", "rule", "label_pred", F.round("p_actionable", 6).alias("p_actionable"), F.round("p_irrelevant", 6).alias("p_irrelevant"))


@query(rf"""WITH {_RULE_SENTENCES} SELECT id, j, round(CASE WHEN {_sql('action')} THEN a + 0.06 ELSE a END, 6) AS a, round(CASE WHEN {_sql('modal')} THEN s + 0.06 ELSE s END, 6) AS s FROM raw""")
def e9_lexical_nudges(t):
    a, s = C.lexical_nudge(F.col("sentence"), F.col("a"), F.col("s"))
    return _rule_rows(t).select("id", "j", F.round(a, 6).alias("a"), F.round(s, 6).alias("s"))
