"""Queries of the parsers, labelling and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import aggregates as A
from corpusloom.operators import classify as C
from corpusloom.operators import labeling as L
from corpusloom.operators import relational as R
from corpusloom.operators import sentences as S
from corpusloom.operators import windows as W
from corpusloom.operators.planner import duration_seconds
from corpusloom.plans.registry import query
from corpusloom.sources.scratch import Scratch
from corpusloom.plans.table_queries import _PANEL, _panel
from corpusloom.sources import readers, writers


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Actionable' WHEN 'O' THEN 'Speculative' ELSE 'Irrelevant' END AS label FROM orders WHERE o_orderkey % 5 <> 0")
def s5_label_lines(t):
    label = F.when(F.col("o_orderstatus") == "F", "Actionable").when(F.col("o_orderstatus") == "O", "Speculative").otherwise("Irrelevant")
    line = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("some text | Label: "), label, F.lit(" | Score: 0.5"))).otherwise("malformed")
    return readers.parse_label_lines(t.orders.select("o_orderkey", line.alias("line"))).select("o_orderkey", "label")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS cik, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CASE WHEN o_orderstatus = 'F' THEN '10-K' ELSE '10-Q' END AS form,
 CASE WHEN year(o_orderdate) BETWEEN 2021 AND 2024 THEN 'active_2021_2024' ELSE 'historical_2000_2020' END AS source_window_id, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3, 4, 5""")
def s6_filing_index(t):
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K")
    path = F.concat(F.lit("/c/"), F.year("o_orderdate"), F.lit("/QTR"), F.quarter("o_orderdate"), F.lit("/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), form, F.lit("_edgar_data_"), F.col("o_custkey"), F.lit("_"), F.col("o_orderkey"), F.lit(".txt"))
    index, _ = readers.filings_index(t.orders.select(path.alias("path")))
    return index.groupBy("cik", "year", "quarter", "form", "source_window_id").agg(F.count("*").alias("n"))


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def s7_parse_vectors(t):
    v = t.embeddings.select("vec_id", readers.parse_vector(F.col("embedding").cast("string")).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT 'f' || (o_custkey % 50) || '.txt' AS filename, arg_min(p, (CASE WHEN y THEN 0 ELSE 1 END) * 1000000000000 + length(p) * 100000000 + o_orderkey) AS path FROM (SELECT o_orderkey, o_custkey, o_orderkey % 3 = 0 AS y, CASE WHEN o_orderkey % 3 = 0 THEN '/r' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(5, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') || '/2024/f' || (o_custkey % 50) || '.txt' ELSE '/r' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(5, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') || '/f' || (o_custkey % 50) || '.txt' END AS p FROM orders) GROUP BY 1")
def s8_prefer_paths(t):
    name = F.concat(F.lit("f"), F.col("o_custkey") % 50, F.lit(".txt"))
    key = F.col("o_orderkey").cast("string")
    root = F.concat(F.lit("/r"), F.lpad(key, F.greatest(F.length(key), F.lit(5)), F.lit("0")), F.when(F.col("o_orderkey") % 3 == 0, "/2024/").otherwise("/"))
    return readers.prefer_paths(t.orders.select(F.concat(root, name).alias("path")))


@query("SELECT c_custkey, sha256(c_name || chr(31) || c_mktsegment) AS h FROM customer")
def s9_row_hashes(t):
    return t.customer.select("c_custkey", writers.row_hash(["c_name", "c_mktsegment"]).alias("h"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def s10_not_done(t):
    return writers.not_done(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN month(o_orderdate) <= 5 THEN CAST(year(o_orderdate) AS INTEGER) - 1 ELSE CAST(year(o_orderdate) AS INTEGER) END AS fyear, greatest(0.0, CAST(epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate) AS DOUBLE)) AS seconds FROM orders")
def s11_dates(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", W.align_fiscal_year(F.year(d), F.month(d)).alias("fyear"), duration_seconds(d.cast("string"), F.lit("1998-01-01 00:00:00")).alias("seconds"))


@query("""SELECT doc_id, regexp_replace(text || ' sk-proj-' || repeat('x1', 12) || ' end', 'sk-(proj-)?[A-Za-z0-9_-]{20,}', '[REDACTED_SECRET]', 'g') AS text FROM documents""")
def s12_redact(t):
    return t.documents.select("doc_id", T.redact(F.concat("text", F.lit(" sk-proj-" + "x1" * 12 + " end"))).alias("text"))


@query("SELECT c_custkey, c_acctbal / 10 AS p_actionable, CAST(c_nationkey AS DOUBLE) AS p_speculative, CAST(NULL AS DOUBLE) AS p_irrelevant FROM customer")
def s13_unpack_scores(t):
    json = F.to_json(F.struct((F.col("c_acctbal") / 10).alias("Actionable"), F.struct(F.col("c_nationkey").alias("S"), F.lit(7).alias("a")).alias("probs")))
    return t.customer.select("c_custkey", *[c.alias(n) for n, c in L.unpack_scores(json).items()])


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'Actionable' ELSE 'Other' END AS label, c_nationkey % 2 = 0 AND c_nationkey % 3 > 0 AS valid FROM customer")
def s14_parse_replies(t):
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.when(F.col("c_nationkey") % 2 == 0, "Actionable").otherwise("Other").alias("label"), F.lit("High").alias("confidence"), F.lit("because").alias("rationale"), (F.col("c_nationkey") % 3 > 0).alias("assistive_only"))), F.lit("\n```"))
    r = L.parse_reply(reply)
    return t.customer.select("c_custkey", r["label"].alias("label"), r["valid"].alias("valid"))


@query("SELECT c_custkey, FALSE AS selection_fallback FROM customer WHERE c_acctbal > 9000 ORDER BY c_custkey LIMIT 1")
def s15_first_eligible(t):
    return L.first_eligible(t.customer, F.col("c_acctbal") > 9000, ["c_custkey"]).select("c_custkey", "selection_fallback")


@query("""WITH s AS (SELECT doc_id, text, lang, CAST(floor(doc_id / 10) AS BIGINT) AS f, row_number() OVER (PARTITION BY floor(doc_id / 10) ORDER BY doc_id) AS p FROM documents),
 c AS (SELECT f, p, text, CASE WHEN lang = 'en' THEN 'Actionable' WHEN lang = 'fr' THEN 'Speculative' END AS label FROM s WHERE p % 2 = 0),
 n AS (SELECT f, text, arg_min(label, p) AS label FROM c WHERE label IS NOT NULL AND trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) <> '' GROUP BY 1, 2)
 SELECT s.doc_id, coalesce(c.label, n.label) AS label_suggested FROM s LEFT JOIN c ON c.f = s.f AND c.p = s.p LEFT JOIN n ON n.f = s.f AND n.text = s.text""")
def b17_label_suggestions(t):
    from pyspark.sql.window import Window

    d = t.documents.select("doc_id", F.floor(F.col("doc_id") / 10).alias("file"), F.col("text").alias("sentence"), "lang")
    d = d.withColumn("position", F.row_number().over(Window.partitionBy("file").orderBy("doc_id")))
    label = F.when(F.col("lang") == "en", "Actionable").when(F.col("lang") == "fr", "Speculative").otherwise("none")
    c = d.where("position % 2 = 0").select("file", "position", "sentence", label.alias("label"), F.lit(0).alias("source_rank"))
    return L.suggest_labels(d.select("doc_id", "file", "position", "sentence"), c).select("doc_id", "label_suggested")


@query("SELECT text AS sentence_norm, CASE WHEN lang = 'en' THEN 'Actionable' ELSE 'Speculative' END AS label, min(doc_id) AS doc_id FROM documents WHERE lang IN ('en', 'fr') AND text <> '' GROUP BY 1, 2")
def b18_dedupe_labelled(t):
    label = F.when(F.col("lang") == "en", "Actionable").when(F.col("lang") == "fr", "Speculative").otherwise("other")
    return L.dedupe_exact(t.documents.select("doc_id", F.col("text").alias("sentence_norm"), label.alias("label")), ["doc_id"])


@query("SELECT c.c_custkey, coalesce(s.s_name, c.c_name) AS c_name FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey")
def b19_upsert(t):
    old = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    return R.upsert(t.customer.select("c_custkey", "c_name"), old, "c_custkey", ["c_name"])


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN 'Actionable' ELSE 'Speculative' END AS rater1_label, CASE WHEN n_nationkey % 2 = 0 THEN 'Actionable' ELSE 'Irrelevant' END AS rater2_label, CASE WHEN n_regionkey < 2 THEN 'A->I' WHEN n_nationkey % 2 = 0 THEN 'S->A' ELSE 'S->I' END AS transition FROM nation WHERE NOT (n_regionkey < 2 AND n_nationkey % 2 = 0)")
def b20_adjudication(t):
    a = F.when(F.col("n_regionkey") < 2, "Actionable").otherwise("Speculative")
    b = F.when(F.col("n_nationkey") % 2 == 0, "Actionable").otherwise("Irrelevant")
    return L.adjudication(t.nation.select("n_nationkey", a.alias("rater1_label"), b.alias("rater2_label"))).select("n_nationkey", "rater1_label", "rater2_label", "transition")


@query(f"""WITH {_PANEL}, p AS (SELECT o_custkey, year, orders AS n_total, orders // 2 AS n_A, orders - orders // 2 AS n_S FROM panel)
 SELECT o_custkey, year, round(n_A / n_total, 6) AS act_share, round(n_S / n_total - n_A / n_total, 6) AS spec_minus_act, round(ln(1 + n_total), 6) AS log_docs, CASE WHEN n_A > 0 THEN 1 ELSE 0 END AS has_actionable, CASE WHEN n_S > 0 AND n_A = 0 THEN 1 ELSE 0 END AS has_spec_only FROM p""")
def d10_panel_features(t):
    half = F.floor(F.col("orders") / 2)
    p = _panel(t).select("o_custkey", "year", F.col("orders").alias("n_total"), half.alias("n_A"), (F.col("orders") - half).alias("n_S"))
    out = W.panel_features(p)
    return out.select("o_custkey", "year", F.round("ActShare", 6).alias("act_share"), F.round("SpecMinusAct", 6).alias("spec_minus_act"), F.round("log_docs", 6).alias("log_docs"), "has_actionable", "has_spec_only")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) SELECT doc_id, count(*) AS lines, count(*) FILTER (NOT (regexp_matches(s, '^\p{Lu}') AND regexp_matches(s, '[.!?]$'))) AS incomplete FROM l GROUP BY doc_id""")
def a14_completion_checks(t):
    lines = t.texts.select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(S.incomplete(F.col("s"))).alias("incomplete"))


@query("SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS hits, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS share FROM lineitem GROUP BY 1, 2")
def c20_conditional_counts(t):
    rows = t.lineitem.select("l_suppkey", F.year("l_shipdate").alias("year"), "l_returnflag")
    return A.conditional_counts(rows, ["l_suppkey", "year"], F.col("l_returnflag") == "R").withColumn("share", F.round("share", 6))


@query("SELECT 'c_acctbal' AS \"column\", count(c_acctbal) AS n, count(*) - count(c_acctbal) AS missing, round(avg(c_acctbal), 6) AS mean FROM customer UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(*) - count(c_nationkey), round(avg(c_nationkey), 6) FROM customer")
def c21_profile(t):
    p = A.profile(t.customer.select("c_acctbal", "c_nationkey"))
    return p.select("column", "n", "missing", F.round("mean", 6).alias("mean"))


@query()
def e7_hashed_centroids(t):
    """Keyword sentences as hashed vectors, their centroids by language, and the nearest centroid of each: a confusion count."""
    s = S.keyword_filter(S.explode_sentences(t.texts.select("doc_id", "lang", "text")).drop("text"), list(S.AI_KEYWORDS))
    v = s.select("doc_id", "sentence_index", F.col("lang").alias("label"), C.hashed_vector(F.col("sentence")).alias("embedding"))
    v = Scratch(t.spark, "e7").write(v, "vectors")  # read twice: the texts are cut and hashed once
    return C.nearest_centroid(v, "embedding", A.centroids(v, "label", "embedding", 64)).groupBy("label", "nearest").agg(F.count("*").alias("n"))
