"""Queries that write a table or a small file tree to the scratch folder and read it back through the sources."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from corpusloom.operators import aggregates as A
from corpusloom.operators import classify as C
from corpusloom.operators import relational as R
from corpusloom.operators import sentences as S
from corpusloom.plans.registry import query
from corpusloom.sources import readers, writers
from corpusloom.sources.scratch import Scratch


def _tree(t):
    """A corpus with a filing per nation: every fifth name is no filing's, every third has a derived file beside it,
    every fourth text isn't UTF-8; two files lie outside the quarters."""
    base = Scratch(t.spark, "tree").path("corpus")
    put = lambda at, data: writers.put_bytes(t.spark, f"{base}/{at}", data)
    for r in t.nation.select("n_nationkey", "n_name").collect():  # 25 rows at any scale
        k, folder = r.n_nationkey, f"{2000 + r.n_nationkey}/QTR{r.n_nationkey % 4 + 1}"
        stem = f"{2000 + k}0315_{'10-K' if k % 2 == 0 else '10-Q'}_edgar_data_{k * 7 + 1}_{k}"
        text = (b"\xff\xfe" if k % 4 == 0 else b"") + f"Filing of {r.n_name}.\n".encode()
        put(f"{folder}/{stem if k % 5 else f'report_{k}'}.txt", text)
        if k % 3 == 0 and k % 5:
            put(f"{folder}/{stem}_classified.txt", b"x")
    put("README.txt", b"not a filing")
    put("2001/notes.txt", b"not a filing")
    return base


_STEM = "CAST(2000 + n_nationkey AS VARCHAR) || '0315_' || CASE WHEN n_nationkey % 2 = 0 THEN '10-K' ELSE '10-Q' END || '_edgar_data_' || (n_nationkey * 7 + 1) || '_' || n_nationkey"
_FILES = f"""files AS (SELECT n_nationkey AS k, n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'report_' || n_nationkey ELSE {_STEM} END || '.txt' AS filename, n_nationkey % 5 <> 0 AS good FROM nation
 UNION ALL SELECT n_nationkey, n_name, {_STEM} || '_classified.txt', TRUE FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 5 <> 0)"""
_INDEX = f"""{_FILES}, idx AS (SELECT filename, good, CAST(k * 7 + 1 AS VARCHAR) AS cik, CAST(2000 + k AS INTEGER) AS year, CAST(k % 4 + 1 AS INTEGER) AS quarter, CASE WHEN k % 2 = 0 THEN '10-K' ELSE '10-Q' END AS form,
 CASE WHEN 2000 + k BETWEEN 2021 AND 2024 THEN 'active_2021_2024' ELSE 'historical_2000_2020' END AS source_window_id FROM files)"""


def _name():
    return F.regexp_extract("path", r"([^/]+)$", 1).alias("filename")


@query(f"WITH {_INDEX} SELECT filename, CASE WHEN good THEN cik END AS cik, CASE WHEN good THEN year END AS year, CASE WHEN good THEN quarter END AS quarter, CASE WHEN good THEN form END AS form, CASE WHEN good THEN source_window_id END AS source_window_id FROM idx")
def i1_corpus_walk(t):
    index, rest = readers.filings_index(readers.corpus_files(t.spark, _tree(t)))
    return index.select("filename", "cik", "year", "quarter", "form", "source_window_id").unionByName(rest.select(_name()), allowMissingColumns=True)


@query(f"WITH {_INDEX} SELECT filename, cik, year FROM idx WHERE good AND NOT filename LIKE '%_classified.txt' AND form = '10-K' AND source_window_id = 'active_2021_2024' AND year IN (2022, 2023, 2024)")
def i2_filing_filter(t):
    index, _ = readers.filings_index(readers.corpus_files(t.spark, _tree(t)))
    return readers.filing_filter(index, ["10-k"], [2022, 2023, 2024], "active_2021_2024").select("filename", "cik", "year")


@query(f"WITH {_FILES} SELECT filename, CASE WHEN filename LIKE '%_classified.txt' THEN 'x' WHEN k % 4 <> 0 THEN 'Filing of ' || n_name || '.' || chr(10) END AS text, CASE WHEN k % 4 = 0 AND NOT filename LIKE '%_classified.txt' THEN 'UnicodeDecodeError' END AS error_type FROM files")
def i3_strict_read(t):
    good, bad = readers.read_texts(t.spark, _tree(t) + "/*/QTR*/*.txt")
    return good.select(_name(), "text").unionByName(bad.select(_name(), "error_type"), allowMissingColumns=True)


@query(f"WITH {_FILES} SELECT filename, CASE WHEN filename LIKE '%_classified.txt' THEN 'x' ELSE 'Filing of ' || n_name || '.' || chr(10) END AS text FROM files")
def i4_lossy_read(t):
    return readers.read_texts_lossy(t.spark, _tree(t) + "/*/QTR*/*.txt").select(_name(), "text")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def i5_csv_declared(t):
    path = Scratch(t.spark, "csv").path("customer")
    writers.write_csv(t.customer, path, ["c_mktsegment", "c_custkey"])
    return readers.read_csv(t.spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS code, c_acctbal FROM customer")
def i6_csv_inferred(t):
    path = Scratch(t.spark, "csv").path("customer")
    code = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    writers.write_csv(t.customer.select(code.alias("code"), "c_acctbal", F.concat(F.lit('say "a, b"\n'), "c_name").alias("note")), path, ["code"])
    return readers.read_csv(t.spark, path, text_columns=("code",), columns=["code", "c_acctbal"])


@query("SELECT p_partkey, p_name, p_size FROM part")
def i7_tsv(t):
    path = Scratch(t.spark, "tsv").path("part")
    t.part.write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_csv(t.spark, path, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", sep="\t", columns=["p_partkey", "p_name", "p_size"])


@query("SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1, 2")
def i8_partitioned_parquet(t):
    path = Scratch(t.spark, "parquet").path("orders")
    writers.write_parquet(t.orders.withColumn("year", F.year("o_orderdate")), path, ["year"])
    return t.spark.read.parquet(path).where("year in (1996, 1997)").groupBy("o_orderpriority", "year").agg(F.count("*").alias("n"))


@query("SELECT p_name AS line, count(*) AS n FROM part GROUP BY 1")
def i9_text_lines(t):
    path = Scratch(t.spark, "lines").path("part")
    padded = F.explode(F.array(F.concat(F.lit("  "), "p_name", F.lit(" \t")), F.lit("   "), F.lit(None).cast("string")))
    writers.write_lines(t.part.select(padded.alias("x")), "x", path)
    return readers.read_lines(t.spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT CAST(0 AS BIGINT) AS n, TRUE AS there")
def i10_empty_marker(t):
    scratch = Scratch(t.spark, "lines")
    writers.write_lines(t.region.where("false"), "r_name", scratch.path("none"))
    there = writers.exists(t.spark, scratch.path("none/_SUCCESS"))
    return readers.read_lines(t.spark, scratch.path("none")).agg(F.count("*").alias("n")).withColumn("there", F.lit(there))


@query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Actionable' ELSE 'Irrelevant' END AS label, count(*) AS n FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY 1 UNION ALL SELECT 'Speculative', count(*) FROM supplier WHERE s_suppkey % 3 <> 0")
def i11_classified_files(t):
    scratch = Scratch(t.spark, "classified")
    label = F.when(F.col("s_suppkey") % 5 == 0, " ").when(F.col("s_suppkey") % 2 == 0, "Actionable").otherwise(" Irrelevant ")
    t.supplier.select(F.col("s_name").alias("sentence"), F.lit("unused").alias("label"), label.alias(" Label_Pred ")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(scratch.path("csv"))
    line = F.when(F.col("s_suppkey") % 3 != 0, F.concat("s_name", F.lit(" | Label: Speculative | Score: 0.4"))).otherwise(F.lit("no label here"))
    writers.write_lines(t.supplier.select(line.alias("x")), "x", scratch.path("txt"))
    return readers.read_classified(t.spark, scratch.path("csv"), scratch.path("txt")).groupBy("label").agg(F.count("*").alias("n"))


@query("""SELECT r_regionkey, CAST(2 AS BIGINT) AS n, sha256('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}') AS payload_sha256 FROM region""")
def i12_audit_log(t):
    scratch = Scratch(t.spark, "audit")
    line = writers.audit_line(F.struct("r_regionkey", "r_name"), F.lit("2024-01-01T00:00:00Z"))
    for _ in range(2):  # appended twice
        t.region.select(line.alias("value")).write.mode("append").text(scratch.path("log"))
    t.spark.createDataFrame([("{not json",)], "value string").write.mode("append").text(scratch.path("log"))
    log = readers.read_jsonl(t.spark, scratch.path("log"), "at string, payload struct<r_regionkey:int,r_name:string>, payload_sha256 string")
    return log.groupBy("payload.r_regionkey", "payload_sha256").agg(F.count("*").alias("n"))


@query("SELECT r_name AS label, [CAST(r_regionkey AS DOUBLE), 0.5, -1.0] AS centroid FROM region")
def i13_centroid_file(t):
    import json

    path = Scratch(t.spark, "centroids").path("c.json")
    writers.put_bytes(t.spark, path, json.dumps({r.r_name: [r.r_regionkey, 0.5, -1] for r in t.region.collect()}, indent=1).encode())
    return readers.read_centroids(t.spark, path)


@query("SELECT CAST(0 AS INTEGER) AS pos, 'n_nationkey' AS line UNION ALL SELECT 1, 'n_name' UNION ALL SELECT CAST(2 + 2 * n_nationkey AS INTEGER), CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT CAST(3 + 2 * n_nationkey AS INTEGER), n_name FROM nation")
def i14_docx(t):
    path = Scratch(t.spark, "docx").path("t.docx")
    writers.docx_table(t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey"), path)
    return readers.document_text(t.spark, path).select(F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("SELECT CAST(count(*) AS VARCHAR) AS orders, CAST(max(o_orderkey) AS VARCHAR) AS last FROM orders")
def i15_json_report(t):
    report = writers.json_report(t.orders.agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("last")))
    made = t.spark.createDataFrame([(report,)], "json string")
    return made.select(F.get_json_object("json", "$.orders").alias("orders"), F.get_json_object("json", "$.last").alias("last"))


_CELLS = "(SELECT * FROM region ORDER BY r_regionkey)"


@query(f"""SELECT 'md' AS kind, '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS body FROM {_CELLS}
 UNION ALL SELECT 'csv', 'r_regionkey,r_name' || chr(10) || string_agg(r_regionkey || ',' || r_name, chr(10) ORDER BY r_regionkey) FROM {_CELLS}
 UNION ALL SELECT 'html', '<table>' || chr(10) || '<tr><td>r_regionkey</td><td>r_name</td></tr>' || chr(10) || string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>', chr(10) ORDER BY r_regionkey) || chr(10) || '</table>' FROM {_CELLS}
 UNION ALL SELECT 'tex', '\\begin{{tabular}}{{ll}}' || chr(10) || 'r\\_regionkey & r\\_name \\\\' || chr(10) || string_agg(r_regionkey || ' & ' || r_name || ' \\\\', chr(10) ORDER BY r_regionkey) || chr(10) || '\\end{{tabular}}' FROM {_CELLS}
 UNION ALL SELECT 'txt', 'r_regionkey  r_name' || chr(10) || string_agg(rpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || '  ' || r_name, chr(10) ORDER BY r_regionkey) FROM {_CELLS}""")
def i16_report_tables(t):
    region = t.region.select("r_regionkey", "r_name").orderBy("r_regionkey")
    return t.spark.createDataFrame([(k, writers.format_table(region, k)) for k in ("md", "csv", "html", "tex", "txt")], "kind string, body string")


@query("SELECT * FROM (VALUES ('argument', '/a'), ('environment', '/b'), ('hint', '/c'), ('none', 'error')) x(given, root)")
def i17_source_root(t):
    import tempfile

    name, rows = "CORPUSLOOM_ROOT_OF_THIS_QUERY", []
    with tempfile.NamedTemporaryFile("w", suffix=".txt") as hint:  # read by the driver alone
        hint.write(" /c\n")
        hint.flush()
        os.environ[name] = "/b"
        rows += [("argument", readers.resolve_root("/a", name, hint.name)), ("environment", readers.resolve_root("", name, hint.name))]
        del os.environ[name]
        rows.append(("hint", readers.resolve_root("", name, hint.name)))
    try:
        rows.append(("none", readers.resolve_root("", name, "")))
    except ValueError:
        rows.append(("none", "error"))
    return t.spark.createDataFrame(rows, "given string, root string")


@query("SELECT CAST(n_nationkey AS INTEGER) AS pos, lower(n_name) AS keyword, n_name AS term FROM nation")
def i18_keyword_lists(t):
    names = [r.n_name for r in t.nation.orderBy("n_nationkey").collect()]
    keywords = S.load_keywords([x for n in names for x in (f'"{n}"  # a comment', "# only a comment", "", n.lower())])
    terms = S.load_terms([x for n in names for x in (f" {n} ", "")])
    return t.spark.createDataFrame([(k, *x) for k, x in enumerate(zip(keywords, terms, strict=True))], "pos int, keyword string, term string")


@query("SELECT 'pass' AS status, count(*) AS written FROM part UNION ALL SELECT 'fail', CAST(0 AS BIGINT)")
def i19_gated_write(t):
    scratch, out = Scratch(t.spark, "gate"), []
    for name, bad in (("good", F.col("p_size") < 0), ("bad", F.col("p_size") >= 0)):
        status = writers.write_if(t.part, A.qa_gate(t.part, {"size": bad}), scratch.path(name))
        out.append((status, t.spark.read.parquet(scratch.path(name)).count() if writers.exists(t.spark, scratch.path(name)) else 0))
    return t.spark.createDataFrame(out, "status string, written long")


@query("SELECT count(*) AS rows, TRUE AS same, TRUE AS differs FROM lineitem")
def i20_fingerprints(t):
    """The fingerprint of a table is that of its copy in another order, and not that of a changed one."""
    x = writers.fingerprint(t.lineitem).select("rows", F.col("fingerprint").alias("f"))
    y = writers.fingerprint(t.lineitem.repartition(7)).select(F.col("fingerprint").alias("g"))
    z = writers.fingerprint(t.lineitem.withColumn("l_tax", F.col("l_tax") + 0.01)).select(F.col("fingerprint").alias("h"))
    return x.crossJoin(F.broadcast(y)).crossJoin(F.broadcast(z)).select("rows", (F.col("f") == F.col("g")).alias("same"), (F.col("f") != F.col("h")).alias("differs"))


_OUTPUTS = "o AS (SELECT l_orderkey, max(l_shipdate) AS modified FROM lineitem GROUP BY 1)"


@query(f"WITH {_OUTPUTS} SELECT CASE WHEN modified IS NULL THEN 'run' WHEN modified < TIMESTAMP '1998-01-01' THEN 'refresh' ELSE 'skip' END AS action, count(*) AS n FROM orders LEFT JOIN o ON l_orderkey = o_orderkey GROUP BY 1")
def i21_batch_plan(t):
    import datetime

    out = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("modified"))
    return C.batch_plan(t.orders.select("o_orderkey"), out, "o_orderkey", datetime.datetime(1998, 1, 1)).groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {_OUTPUTS} SELECT o_orderkey FROM orders LEFT JOIN o ON l_orderkey = o_orderkey WHERE modified IS NULL OR modified < o_orderdate + INTERVAL 60 DAY")
def i22_stale_outputs(t):
    inputs = t.orders.select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 60 days")).alias("modified"))
    outputs = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("modified"))
    return writers.stale(inputs, outputs, "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_custkey DESC, o_orderkey LIMIT 25")
def i23_review_sample(t):
    return writers.review_sample(t.orders, [F.col("o_orderdate"), F.col("o_custkey").desc(), F.col("o_orderkey")], 25).select("o_orderkey", "o_totalprice")


@query("SELECT CAST(c_custkey AS VARCHAR) AS gvkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS cik, upper(c_mktsegment) AS tic, c_name AS conm, 'full' AS source FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), '', '', s_name, 'reduced' FROM supplier")
def i24_company_table(t):
    full = t.customer.select(F.col("c_custkey").alias("GVKEY"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("cik"), F.lower("c_mktsegment").alias("tic"), F.col("c_name").alias("conm"))
    reduced = t.supplier.select(F.col("s_suppkey").alias("gvkey"), F.col("s_name").alias("conm"))
    return readers.company_table(full).withColumn("source", F.lit("full")).unionByName(readers.company_table(reduced).withColumn("source", F.lit("reduced")))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-08-31'")
def i25_dated_pull(t):
    return readers.dated_pull(t.orders, "o_orderdate", "1996-03-01", "1996-08-31", ["o_orderkey", "o_orderdate"])


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND year(o_orderdate) = 1999")
def i26_parameterised_pull(t):
    o = t.orders.withColumn("fyear", F.year("o_orderdate"))
    poor = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    listed = readers.in_list(o, "o_orderpriority", ["1-URGENT", "5-LOW"], 1999, 1999)
    return readers.in_list(o, "o_custkey", poor, 1996, 1998).select("o_orderkey").unionByName(listed.select("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 AND o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def i27_fundamentals(t):
    ids = t.customer.where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return readers.fundamentals(t.orders.withColumn("fyear", F.year("o_orderdate")), ids, "o_custkey", 1996, 1999, {"o_orderstatus": "F"}).select("o_orderkey")


@query("SELECT c_custkey, s_name FROM customer JOIN supplier ON s_suppkey = c_custkey UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def i28_lookup_files(t):
    found, missing = R.lookup_files(t.customer, t.supplier.select(F.col("s_suppkey").alias("c_custkey"), "s_name"), ["c_custkey"])
    return found.select("c_custkey", "s_name").unionByName(missing.select("c_custkey"), allowMissingColumns=True)
