"""Queries over tables: joins, aggregates, windows, vectors, regressions, graphs, event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import numbers as N
from corpusloom.functions import text as T
from corpusloom.operators import aggregates as A
from corpusloom.operators import classify as C
from corpusloom.operators import planner as P
from corpusloom.operators import regression as G
from corpusloom.operators import relational as R
from corpusloom.operators import windows as W
from corpusloom.plans.registry import query
from corpusloom.streaming import events as E

ARF = ("A", "R", "N")


def _panel(t):
    """Orders per customer and year."""
    o = t.orders.select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    return o.groupBy("o_custkey", "year").agg(F.round(F.sum("o_totalprice"), 2).alias("sales"), F.count("*").alias("orders"))


_PANEL = "panel AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS sales, count(*) AS orders FROM orders GROUP BY 1, 2)"


@query("SELECT max(o_orderkey) AS o_orderkey, o_custkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1 GROUP BY o_custkey")
def b5_keep_last(t):
    return R.last_per_key(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, arg_min(o_orderkey, -(epoch(o_orderdate) * 10000000) + o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def b6_latest_per_group(t):
    o = t.orders.select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderkey", "o_orderdate")
    return R.dedupe(o, ["o_custkey", "year"], F.struct(-F.unix_timestamp("o_orderdate"), F.col("o_orderkey")), ["o_orderkey"])


@query("SELECT p_partkey, term FROM part, (SELECT unnest(['ring', 'red', 'get']) AS term) WHERE contains(p_name, term)")
def b7_theta_contains(t):
    return R.match_substrings(t.part.select("p_partkey", "p_name"), "p_name", ["ring", "red", "get"]).select("p_partkey", "term")


@query(r"SELECT s.p_partkey, b.p_name AS term FROM part s, (SELECT DISTINCT p_name FROM part) b WHERE contains(' ' || s.p_name || ' ', ' ' || b.p_name || ' ')")
def b8_theta_phrase(t):
    terms = t.part.select(F.col("p_name").alias("term")).distinct()
    return R.match_terms(t.part.select("p_partkey", "p_name"), "p_name", terms, "term").select("p_partkey", "term")


@query("SELECT c.c_custkey, coalesce(CAST(s.s_suppkey AS VARCHAR), CAST(g.k AS VARCHAR), '') AS code, CASE WHEN s.s_suppkey IS NOT NULL THEN 'exact' WHEN g.k IS NOT NULL THEN 'fallback' ELSE 'unknown' END AS code_source FROM customer c LEFT JOIN (SELECT s_suppkey FROM supplier) s ON s.s_suppkey = c.c_custkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier GROUP BY 1) g ON g.s_nationkey = c.c_nationkey")
def b9_lookup_fallback(t):
    rows = t.customer.select("c_custkey", F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"))
    exact = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("code"))
    general = t.supplier.groupBy(F.col("s_nationkey").alias("nk")).agg(F.min("s_suppkey").cast("string").alias("code"))
    return R.lookup_with_fallback(rows, exact, general, ["k"], ["nk"], "code").select("c_custkey", "code", "code_source")


@query("WITH one AS (SELECT c_custkey, s_suppkey, 'key' AS matched_by FROM customer JOIN supplier ON s_suppkey = c_custkey), two AS (SELECT c_custkey, s_suppkey, 'nation' AS matched_by FROM customer JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey WHERE c_custkey NOT IN (SELECT c_custkey FROM one)) SELECT * FROM one UNION ALL SELECT * FROM two")
def b10_priority_match(t):
    rows = t.customer.select("c_custkey", F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"))
    by_key = t.supplier.select(F.col("s_suppkey").alias("k"), "s_suppkey")
    by_nation = t.supplier.groupBy(F.col("s_nationkey").alias("nk")).agg(F.min("s_suppkey").alias("s_suppkey"))
    return R.priority_match(rows, "c_custkey", [("key", by_key, ["k"]), ("nation", by_nation, ["nk"])]).select("c_custkey", "s_suppkey", "matched_by")


@query("SELECT n.n_nationkey, m.c_mktsegment FROM nation n CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) m WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_mktsegment = m.c_mktsegment AND c_acctbal > 9000)")
def b11_missing_combinations(t):
    rich = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").cast("long").alias("n_nationkey"), "c_mktsegment")
    nations = t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    return R.missing_combinations(nations, t.customer.select("c_mktsegment"), rich, ["n_nationkey", "c_mktsegment"])


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def b12_star_join(t):
    out = R.join_many_to_one(t.customer.select("c_custkey", "c_name", "c_nationkey"), t.nation.select("n_nationkey", "n_name", "n_regionkey"), "c_nationkey", "n_nationkey")
    return R.join_many_to_one(out, t.region, "n_regionkey", "r_regionkey").select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def b13_update_by_map(t):
    o = t.orders.select("o_orderkey", "o_orderstatus")
    return R.update_by_map(o, o.where("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey", "o_orderstatus")


@query("SELECT k, side FROM (SELECT o_orderkey AS k, 'missing' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'unexpected' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))")
def b14_coverage(t):
    return R.set_difference_both_ways(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")), "k")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def b15_intersect(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query(f"WITH {_PANEL} SELECT p.o_custkey, p.year, p.sales, c.c_acctbal, c.c_mktsegment FROM panel p LEFT JOIN customer c ON c.c_custkey = p.o_custkey")
def b16_panel_join(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    return _panel(t).select("o_custkey", "year", "sales").join(c, "o_custkey", "left")


_YEARS = "SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS f FROM lineitem"


@query(f"""WITH l AS ({_YEARS}), k AS (SELECT DISTINCT s_suppkey AS l_suppkey, year FROM supplier, (SELECT DISTINCT year FROM l)),
 c AS (SELECT k.l_suppkey, k.year, count(*) FILTER (f = 'A') AS "A_count", count(*) FILTER (f = 'R') AS "R_count", count(*) FILTER (f = 'N') AS "N_count" FROM k LEFT JOIN l ON l.l_suppkey = k.l_suppkey AND l.year = k.year GROUP BY 1, 2)
 SELECT l_suppkey, year, "A_count", "R_count", "N_count", "A_count" + "R_count" + "N_count" AS total_count, round(ln(1 + "A_count"), 6) AS "AI_frequencyA", round(ln(1 + "R_count"), 6) AS "AI_frequencyR", round(ln(1 + "N_count"), 6) AS "AI_frequencyN", round(ln(1 + "A_count" + "R_count" + "N_count"), 6) AS "AI_frequency_total" FROM c""")
def c1_label_counts(t):
    rows = t.lineitem.select("l_suppkey", F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("f"))
    years = rows.select("year").distinct()
    spine = t.supplier.select(F.col("s_suppkey").alias("l_suppkey")).crossJoin(F.broadcast(years))
    out = A.label_counts(rows, ["l_suppkey", "year"], "f", ARF, keep_empty=spine.select("l_suppkey", "year"))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("AI_")})


@query("""WITH g AS (SELECT l_suppkey, count(*) AS total_rows, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'N') AS n FROM lineitem GROUP BY 1)
 SELECT l_suppkey, total_rows, round(a / total_rows, 6) AS "A_share", round(n / total_rows, 6) AS "N_share",
 concat_ws('; ', CASE WHEN n / total_rows >= 0.35 THEN 'N_share>=0.35' END, CASE WHEN greatest(a, r, n) / total_rows >= 0.36 THEN 'max_share>=0.36' END) AS pathology_reasons FROM g""")
def c2_share_pathologies(t):
    out = A.share_pathologies(t.lineitem, "l_suppkey", "l_returnflag", ARF, 0.35, 0.36)
    return out.select("l_suppkey", "total_rows", F.round("A_share", 6).alias("A_share"), F.round("N_share", 6).alias("N_share"), "pathology_reasons")


@query("""WITH x AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), n AS (SELECT count(*) AS n, count(*) - count(quality) AS q, count(*) - count(toxic) AS t, count(*) - count(doc_id) AS d FROM x)
 SELECT 'doc_id' AS "column", d AS missing, round(d / n, 6) AS share FROM n UNION ALL SELECT 'quality', q, round(q / n, 6) FROM n UNION ALL SELECT 'toxic', t, round(t / n, 6) FROM n""")
def c3_missing_shares(t):
    x = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return A.missing_shares(x, ["doc_id", "quality", "toxic"]).withColumn("share", F.round("share", 6))


@query("WITH n AS (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS members, CAST(sum(n - 1) AS BIGINT) AS extras FROM n")
def c4_duplicates(t):
    return A.duplicate_summary(t.lineitem, ["l_orderkey", "l_partkey"])


@query("SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS parts FROM orders GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) = 7")
def c5_complete_keys(t):
    return A.complete_keys(t.orders.select("o_custkey", F.year("o_orderdate").alias("y")), "o_custkey", "y", 7)


@query("SELECT CAST(l_returnflag AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1")
def c6_value_counts(t):
    return A.value_counts(t.lineitem, "l_returnflag")


_RATERS = "r AS (SELECT CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS a, CASE WHEN toxic = 1 THEN 'yes' ELSE 'no' END AS b FROM labels)"
YN = ("yes", "no")


def _raters(t):
    f = lambda c: F.when(F.col(c) == 1, "yes").otherwise("no")
    return t.labels.select(f("quality").alias("a"), f("toxic").alias("b"))


@query(f"WITH {_RATERS} SELECT a AS \"true\", count(*) FILTER (b = 'yes') AS yes, count(*) FILTER (b = 'no') AS no FROM r GROUP BY a")
def c7_confusion(t):
    return A.confusion(_raters(t), "a", "b", YN)


_CLASS = f"""{_RATERS}, k AS (SELECT unnest(['yes', 'no']) AS label), g AS (SELECT label, count(*) FILTER (a = label AND b = label) AS tp, count(*) FILTER (a = label) AS support, count(*) FILTER (b = label) AS predicted FROM r, k GROUP BY label),
 p AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS "precision", CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall FROM g),
 m AS (SELECT *, CASE WHEN "precision" + recall = 0 THEN 0 ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1 FROM p)"""


@query(f'WITH {_CLASS} SELECT label, tp, support, predicted, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m')
def c8_class_metrics(t):
    out = A.class_metrics(_raters(t), "a", "b", YN)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f'WITH {_CLASS}, o AS (SELECT round(avg("precision"), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM m) SELECT count(*) AS n, count(*) FILTER (a = b) AS correct, any_value(macro_precision) AS macro_precision, any_value(macro_recall) AS macro_recall, any_value(macro_f1) AS macro_f1, round(count(*) FILTER (a = b) / count(*), 6) AS accuracy FROM r, o')
def c9_overall_metrics(t):
    out = A.overall_metrics(_raters(t), "a", "b", YN)
    return out.withColumns({c: F.round(c, 6) for c in ("macro_precision", "macro_recall", "macro_f1", "accuracy")})


@query(f"WITH {_RATERS}, s AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg(CASE WHEN a = 'yes' THEN 1.0 ELSE 0.0 END) AS ay, avg(CASE WHEN b = 'yes' THEN 1.0 ELSE 0.0 END) AS b1 FROM r), e AS (SELECT n, po, ay * b1 + (1 - ay) * (1 - b1) AS pe FROM s) SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM e")
def c10_kappa(t):
    out = A.kappa(_raters(t), "a", "b", YN)
    return out.withColumns({c: F.round(c, 6) for c in ("observed", "expected", "kappa")})


@query(f"WITH {_RATERS} SELECT 'y->n' AS transition, count(*) FILTER (a = 'yes' AND b = 'no') AS n FROM r UNION ALL SELECT 'n->y', count(*) FILTER (a = 'no' AND b = 'yes') FROM r")
def c11_transitions(t):
    return A.transitions(_raters(t), "a", "b", YN)


@query(f"WITH {_RATERS} SELECT a AS label, count(*) FILTER (a = b) AS same, count(*) AS n, round(count(*) FILTER (a = b) / count(*), 6) AS agreement FROM r GROUP BY a")
def c12_class_agreement(t):
    return A.class_agreement(_raters(t), "a", "b", YN).withColumn("agreement", F.round("agreement", 6))


@query("SELECT count(n_chars) AS n, min(n_chars) AS min, median(n_chars) AS median, round(avg(n_chars), 6) AS mean, max(n_chars) AS max FROM documents")
def c13_token_summary(t):
    return A.token_summary(t.documents, "n_chars").withColumn("mean", F.round("mean", 6))


_INDEX = "i AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS form, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CASE WHEN year(o_orderdate) BETWEEN 1999 AND 2001 THEN 'late' ELSE 'early' END AS w FROM orders)"


def _index(t):
    y = F.year("o_orderdate")
    return t.orders.select(y.alias("year"), F.col("o_orderpriority").alias("form"), F.quarter("o_orderdate").alias("quarter"), F.when(y.between(1999, 2001), "late").otherwise("early").alias("source_window_id"))


@query(f"WITH {_INDEX} SELECT 'year' AS \"grouping\", CAST(year AS VARCHAR) AS value, count(*) AS n FROM i GROUP BY 2 UNION ALL SELECT 'form', form, count(*) FROM i GROUP BY 2 UNION ALL SELECT 'year_quarter', year || ':Q' || quarter, count(*) FROM i GROUP BY 2")
def c14_corpus_summary(t):
    return A.corpus_summary(_index(t))


@query(f"WITH {_INDEX} SELECT w AS source_window_id, count(*) FILTER (year BETWEEN 1994 AND 2003) AS filings, CASE WHEN w = 'late' THEN 'available' ELSE 'incomplete' END AS status FROM i GROUP BY w")
def c15_source_windows(t):
    out = A.source_windows(_index(t), {"late": [1999, 2000, 2001], "early": [1994, 1995, 1996, 1997, 1998]})
    return out.select("source_window_id", "filings", "status")


@query("SELECT CASE WHEN count(*) FILTER (l_quantity <= 0) + count(*) FILTER (l_discount > 0.09) > 0 THEN 'fail' ELSE 'pass' END AS status, count(*) FILTER (l_quantity <= 0) > 0 AS bad_quantity, count(*) FILTER (l_discount > 0.09) > 0 AS big_discount FROM lineitem")
def c16_qa_gate(t):
    out = A.qa_gate(t.lineitem, {"quantity": F.col("l_quantity") <= 0, "discount": F.col("l_discount") > 0.09})
    return out.select("status", F.array_contains("violations", "quantity").alias("bad_quantity"), F.array_contains("violations", "discount").alias("big_discount"))


@query("SELECT 'value' AS measure, round(sum(value), 2) AS used, 1000.0 AS cap, sum(value) > 1000 AS \"over\" FROM events UNION ALL SELECT 'user_id', round(sum(user_id), 2), 1e12, sum(user_id) > 1e12 FROM events")
def c17_usage_totals(t):
    return A.usage_totals(t.events, {"value": 1000.0, "user_id": 1e12}).withColumn("used", F.round("used", 2))


_STEPS = "s AS (SELECT o_orderpriority AS phase, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'validation' ELSE 'command' END AS kind, o_totalprice AS seconds, 1 + o_orderkey % 3 AS attempt FROM orders)"


@query(f"WITH {_STEPS} SELECT round(sum(seconds), 2) AS total, round(sum(seconds) FILTER (kind = 'validation'), 2) AS validation, (SELECT id FROM s ORDER BY seconds DESC, id DESC LIMIT 1) AS slowest_command, count(*) FILTER (attempt > 1) AS reruns, (SELECT phase FROM s GROUP BY phase ORDER BY sum(seconds) DESC LIMIT 1) AS slowest_phase FROM s")
def c18_run_timing(t):
    s = t.orders.select(F.col("o_orderpriority").alias("phase"), F.col("o_orderkey").alias("command"), F.when(F.col("o_orderstatus") == "F", "validation").otherwise("command").alias("kind"), F.col("o_totalprice").alias("seconds"), (1 + F.col("o_orderkey") % 3).alias("attempt"))
    out = A.run_timing(s)
    return out.select(F.round("total", 2).alias("total"), F.round("validation", 2).alias("validation"), "slowest_command", "reruns", "slowest_phase")


@query("SELECT o_orderstatus AS type, CASE WHEN o_orderkey % 3 = 0 THEN 'tool' || substr(o_orderpriority, 1, 1) || '.py' WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE 'unknown' END AS stem, count(*) AS n, min(o_orderkey) AS first_id FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def c19_repeated_blockers(t):
    k = F.col("o_orderkey")
    message = F.when(k % 3 == 0, F.concat(F.lit("Step command failed: /opt/bin/tool"), F.substring("o_orderpriority", 1, 1), F.lit(".py --go now"))).when(k % 3 == 1, F.col("o_orderpriority"))
    b = t.orders.select(F.col("o_orderstatus").alias("type"), k.alias("id"), message.alias("message"))
    return A.repeated_blockers(b, T.command_stem(F.col("message"))).select("type", "stem", "n", F.col("ids")[0].alias("first_id"))


@query(f"WITH {_PANEL}, l AS (SELECT *, lag(sales) OVER (PARTITION BY o_custkey ORDER BY year) AS b FROM panel) SELECT o_custkey, year, b AS sales_lag, round((sales - b) / abs(b), 6) AS sales_growth FROM l")
def d1_lag_growth(t):
    out = W.lag_growth(_panel(t), "o_custkey", "year", "sales")
    return out.select("o_custkey", "year", "sales_lag", F.round("sales_growth", 6).alias("sales_growth"))


@query(f"""WITH {_PANEL}, l AS (SELECT o_custkey, year, orders, lead(orders, 1) OVER w AS l1, lead(orders, 2) OVER w AS l2 FROM panel WINDOW w AS (PARTITION BY o_custkey ORDER BY year))
 SELECT o_custkey, year, l1 AS orders_lead1, l2 AS orders_lead2, round(ln(1 + l1), 6) AS log1p_orders_lead1, CASE WHEN coalesce(l1 > 1, FALSE) THEN 1 ELSE 0 END AS any1, CASE WHEN l2 IS NULL THEN 0 ELSE 1 END AS any_orders_lead2 FROM l""")
def d2_leads(t):
    out = W.leads(_panel(t), "o_custkey", "year", "orders")
    return out.select("o_custkey", "year", "orders_lead1", "orders_lead2", F.round("log1p_orders_lead1", 6).alias("log1p_orders_lead1"), F.coalesce(F.col("orders_lead1") > 1, F.lit(False)).cast("int").alias("any1"), "any_orders_lead2")


@query("""WITH q AS (SELECT c_mktsegment AS m, quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM customer GROUP BY 1)
 SELECT c_custkey, round(least(greatest(c_acctbal, lo), hi), 4) AS c_acctbal_w FROM customer JOIN q ON m = c_mktsegment""")
def d3_winsorize_group(t):
    out = W.winsorize(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", "c_mktsegment")
    return out.select("c_custkey", F.round("c_acctbal_w", 4).alias("c_acctbal_w"))


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM customer) SELECT c_custkey, round(least(greatest(c_acctbal, lo), hi), 4) AS c_acctbal_w FROM customer, q""")
def d4_winsorize_all(t):
    out = W.winsorize(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal")
    return out.select("c_custkey", F.round("c_acctbal_w", 4).alias("c_acctbal_w"))


@query(f"""WITH {_PANEL} SELECT o_custkey, year, round(ln(sales), 6) AS ln_sales, round(c_acctbal / nullif(sales, 0), 6) AS leverage, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS cash
 FROM panel JOIN customer ON c_custkey = o_custkey""")
def d5_fundamentals(t):
    p = _panel(t).join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    return p.select("o_custkey", "year", F.round(N.ln_positive(F.col("sales")), 6).alias("ln_sales"), F.round(N.ratio(F.col("c_acctbal"), F.col("sales")), 6).alias("leverage"), N.non_negative(F.col("c_acctbal")).alias("cash"))


@query("""WITH d AS (SELECT doc_id, lang, CAST(substr(source, 4) AS INTEGER) % 5 + 1 AS b, n_chars > 500 AS known FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang, b, known ORDER BY doc_id) AS k FROM d),
 o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN known THEN 0 ELSE 1 END, CASE WHEN known THEN k ELSE 0 END, CASE WHEN known THEN b ELSE 0 END, doc_id) AS selection_order FROM r)
 SELECT lang, doc_id, CAST(selection_order AS INTEGER) AS selection_order, CASE WHEN known THEN 'round_robin' ELSE 'fill' END AS selection_reason FROM o WHERE selection_order <= 40""")
def d6_round_robin(t):
    d = t.documents.select("doc_id", "lang", (F.substring("source", 4, 9).cast("int") % 5 + 1).alias("b"), (F.col("n_chars") > 500).alias("known"))
    return W.round_robin(d, "lang", "b", F.col("known"), 40, ["doc_id"]).select("lang", "doc_id", "selection_order", "selection_reason")


@query("""WITH d AS (SELECT lang AS quarter, CAST(CAST(substr(source, 4) AS INTEGER) % 12 + 1 AS VARCHAR) AS ff, n_chars > 500 AS known, source AS f, doc_id AS si, CAST(doc_id AS VARCHAR) AS id, n_chars % 3 = 0 AS edge, CASE WHEN n_chars < 800 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS lb FROM documents),
 a0 AS (SELECT *, row_number() OVER (PARTITION BY quarter, f ORDER BY si, id) AS rf FROM d WHERE known), a AS (SELECT *, row_number() OVER (PARTITION BY quarter, ff ORDER BY rf, f, si, id) AS rb FROM a0),
 b0 AS (SELECT *, CASE WHEN edge THEN 0 ELSE 1 END AS e, CASE lb WHEN 'medium' THEN 0 WHEN 'long' THEN 1 ELSE 2 END AS lp FROM d WHERE NOT known), b AS (SELECT *, row_number() OVER (PARTITION BY quarter, f ORDER BY e, lp, si, id) AS rf FROM b0),
 u AS (SELECT quarter, id, f, si, 0 AS s, rb AS x, ff AS y, 0 AS z FROM a UNION ALL SELECT quarter, id, f, si, 1, rf * 2 + e, '', lp FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY s, x, y, z, f, si, id) AS k FROM u)
 SELECT quarter, id AS sentence_id, CAST(k AS INTEGER) AS batch_order, CASE WHEN s = 0 THEN 'quarter_ff12_round_robin' ELSE 'quarter_diversity_fill' END AS selection_reason FROM o WHERE k <= 60""")
def d7_select_batch(t):
    n = F.col("n_chars")
    rows = t.documents.select(F.col("lang").alias("quarter"), (F.substring("source", 4, 9).cast("int") % 12 + 1).cast("string").alias("ff12_code"), (n > 500).alias("known"), F.col("source").alias("source_file"), F.col("doc_id").alias("sentence_index"), F.col("doc_id").cast("string").alias("sentence_id"), (n % 3 == 0).alias("edge_case_flag"), F.when(n < 800, "short").when(n < 2000, "medium").otherwise("long").alias("length_bin"))
    quotas = t.spark.createDataFrame([(q, 60) for q in ("en", "fr", "de", "es")], "quarter string, quota int")
    return W.select_batch(rows, quotas).select("quarter", "sentence_id", "batch_order", "selection_reason")


@query("SELECT lang, doc_id, CAST(r AS INTEGER) AS class_rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 10")
def d8_top_per_class(t):
    return W.top_per_class(t.documents.select("lang", "doc_id", "n_chars"), "lang", 10, [F.col("n_chars").desc(), "doc_id"]).select("lang", "doc_id", "class_rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def d9_top_ten(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


_CENTROIDS = "p AS (SELECT label, unnest(range(1, 65)) AS i, embedding FROM embeddings), m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM p GROUP BY 1, 2)"


@query(f"WITH {_CENTROIDS} SELECT label, CAST(i AS INTEGER) AS pos, round(x, 6) AS x FROM m")
def e1_centroids(t):
    return A.centroids(t.embeddings, "label", "embedding", 64).select("label", F.posexplode("centroid").alias("pos", "x")).select("label", (F.col("pos") + 1).alias("pos"), F.round("x", 6).alias("x"))


@query(f"""WITH {_CENTROIDS}, c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label), s AS (SELECT vec_id, c.label, list_cosine_similarity(list_transform(embedding, lambda z: CAST(z AS DOUBLE)), v) AS s FROM embeddings e, c),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM s) SELECT vec_id, label AS nearest, round(s, 6) AS similarity FROM r WHERE k = 1""")
def e2_nearest_centroid(t):
    c = A.centroids(t.embeddings, "label", "embedding", 64)
    return C.nearest_centroid(t.embeddings.select("vec_id", "embedding"), "embedding", c).select("vec_id", "nearest", F.round("similarity", 6).alias("similarity"))


@query("""WITH s AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS s, CAST(embedding[3] AS DOUBLE) AS i FROM embeddings)
 SELECT vec_id, round(greatest(a, s, i) - (a + s + i - greatest(a, s, i) - least(a, s, i)), 6) AS margin, CASE WHEN a >= s AND a >= i THEN 'Actionable' WHEN s >= i THEN 'Speculative' ELSE 'Irrelevant' END AS label FROM s""")
def e3_margin_argmax(t):
    cols = [F.col("embedding")[k].cast("double") for k in range(3)]
    return t.embeddings.select("vec_id", F.round(N.margin(cols), 6).alias("margin"), N.argmax(("Actionable", "Speculative", "Irrelevant"), cols).alias("label"))


@query()
def f2_fe_ols(t):
    """Fixed-effects regression on the customer-year panel, customers as entities; m2's balance is absorbed by them."""
    p = _panel(t).join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("balance")), "o_custkey")
    p = p.withColumn("ln_sales", F.log("sales"))
    out = G.run_models(p, {"m1": ("ln_sales", ["orders"]), "m2": ("ln_sales", ["orders", "balance"])}, "o_custkey", "year")
    return out.withColumns({c: F.round(c, 6) for c in ("coef", "se", "t", "p")})


_EDGES = "e AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey * 2 + 1 AS BIGINT) AS b FROM nation WHERE n_nationkey * 2 + 1 < 25 UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey * 2 + 2 AS BIGINT) FROM nation WHERE n_nationkey * 2 + 2 < 25 UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey + 7 AS BIGINT) FROM nation WHERE n_nationkey + 7 < 25)"


def _graph(t):
    k = F.col("n_nationkey").cast("long")
    n = t.nation.select(k.alias("id"))
    e = n.select(F.col("id").alias("parent"), F.explode(F.array(F.col("id") * 2 + 1, F.col("id") * 2 + 2, F.col("id") + 7)).alias("child")).where("child < 25").distinct()
    return n, e


@query(f"WITH RECURSIVE {_EDGES}, w(root, id, depth) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 1 FROM nation UNION ALL SELECT w.root, e.b, w.depth + 1 FROM w JOIN (SELECT DISTINCT a, b FROM e) e ON e.a = w.id) SELECT root AS id, count(DISTINCT id) - 1 AS downstream, CAST(max(depth) AS INTEGER) AS depth FROM w GROUP BY root")
def g1_graph_metrics(t):
    n, e = _graph(t)
    return P.graph_metrics(t.spark, e, n)


_TASKS = "k AS (SELECT o_orderkey AS id, o_orderkey % 11 = 0 AS d, o_orderkey % 5 AS dep, o_orderkey % 7 AS pre, o_orderstatus = 'F' AS outs, o_orderkey % 3 AS q, o_orderkey % 2 = 0 AS man FROM orders)"


@query(f"WITH {_TASKS}, s AS (SELECT CASE WHEN d THEN 'deferred' WHEN dep > 0 THEN 'waiting_on_deps' WHEN pre > 0 THEN 'blocked_precondition' WHEN outs AND q = 0 THEN 'satisfied' WHEN q > 0 THEN 'blocked_quality' WHEN man THEN 'blocked_manual' ELSE 'ready' END AS status FROM k) SELECT status, count(*) AS n FROM s GROUP BY status")
def g2_readiness(t):
    k = F.col("o_orderkey")
    tasks = t.orders.select((k % 11 == 0).alias("deferred"), (k % 5).alias("missing_dependencies"), F.lit(0).alias("policy_blocks"), (k % 7).alias("failed_preconditions"), (F.col("o_orderstatus") == "F").alias("outputs_present"), (k % 3).alias("failed_quality"), (k % 2 == 0).alias("manual"))
    return P.readiness(tasks).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'ready' ELSE 'blocked' END AS status, CAST(5 * least(n_nationkey, 10) + 4 * (n_nationkey % 4) + 3 * n_regionkey + 2 * (CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 0 END) - 2 * (CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 3 END) - 4 * (n_nationkey % 2) - 5 * (CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS score FROM nation),
 r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY score DESC, id) AS rank FROM s) SELECT id, status, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def g3_task_scores(t):
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    score = P.task_score(k, k % 4, r, F.when(k % 3 == 0, "full").otherwise("manual"), F.lit(3), k % 2, r == 1)
    return P.top_by_status(t.nation.select(k.alias("id"), F.when(k % 2 == 0, "ready").otherwise("blocked").alias("status"), score.alias("score")))


@query("SELECT n_nationkey AS id, round(2.5 * n_regionkey + 30 * (n_nationkey / 25) - 3 * (n_nationkey % 5) - 2 * (n_nationkey % 3), 3) AS score FROM nation")
def g4_option_scores(t):
    k = F.col("n_nationkey")
    return t.nation.select(k.alias("id"), P.option_score(F.col("n_regionkey"), k / 25, k % 5, k % 3).alias("score"))


_FF = {c: r for c, _, r in T.FF12}
_FF_CASE = " ".join(f"WHEN {' OR '.join(f'p_partkey BETWEEN {a} AND {b}' for a, b in r)} THEN {c}" for c, r in _FF.items() if r)


@query(f"SELECT CAST(CASE {_FF_CASE} ELSE 12 END AS INTEGER) AS code, count(*) AS n FROM part GROUP BY 1")
def s1_industry_codes(t):
    return t.part.groupBy(T.ff12_code(F.col("p_partkey")).alias("code")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, lpad(regexp_replace(c_name, '[^0-9]', '', 'g'), 10, '0') AS padded, CASE WHEN ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0') = '' THEN '0' ELSE ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0') END AS stripped FROM customer")
def s2_entity_ids(t):
    return t.customer.select("c_custkey", T.cik_padded(F.col("c_name")).alias("padded"), T.cik_stripped(F.col("c_name")).alias("stripped"))


@query("SELECT p_partkey, lower(regexp_replace(p_name, '[^a-zA-Z0-9 ]', '', 'g')) AS name FROM part")
def s3_company_names(t):
    return t.part.select("p_partkey", T.clean_company(F.concat("p_name", F.lit(" Holdings, Inc."))).alias("x")).select("p_partkey", F.regexp_replace("x", " holdings$", "").alias("name"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 AS passed FROM events")
def s4_json_field(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", k.alias("k"), N.compare(k, ">=", 50).alias("passed"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x1_tumbling(t):
    return E.tumbling(t.events).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS session_start, count(*) AS n FROM k GROUP BY user_id, k""")
def x2_sessions(t):
    return E.sessions(t.events).select("user_id", "session_start", "n")


@query("SELECT (SELECT count(*) FROM events) AS n, (SELECT count(DISTINCT event_id) FROM events) AS distinct_events")
def x3_first_seen(t):
    e = t.events.select("event_id", "ts")
    return e.agg(F.count("*").alias("n")).crossJoin(E.first_seen(e).agg(F.count("*").alias("distinct_events")))
