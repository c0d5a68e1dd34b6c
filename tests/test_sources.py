"""Readers, writers and the streaming extension on temporary folders."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.contracts import FILINGS_INDEX
from corpusloom.sources import readers as S
from corpusloom.sources import writers as W
from corpusloom.streaming import events as E


def put(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_corpus_index(spark, tmp_path):
    put(tmp_path, "2021/QTR1/20210301_10-K_edgar_data_11_a.txt", "x")
    put(tmp_path, "2024/QTR2/20240501_10-Q_edgar_data_22_b.txt", "x")
    put(tmp_path, "2024/QTR2/20240501_10-Q_edgar_data_22_b_ai_sentences.txt", "x")
    put(tmp_path, "2021/QTR1/README.txt", "x")
    put(tmp_path, "other/notes.txt", "x")
    files = S.corpus_files(spark, str(tmp_path))
    index, odd = S.filings_index(files, "root", "now")
    assert files.count() == 4 and tuple(index.columns) == FILINGS_INDEX and odd.count() == 1
    assert {(r.cik, r.year, r.quarter, r.form, r.source_window_id) for r in index.collect()} >= {("11", 2021, 1, "10-K", "active_2021_2024"), ("22", 2024, 2, "10-Q", "active_2021_2024")}
    assert {r.filename for r in S.filing_filter(index, ["10-q"], [2024]).collect()} == {"20240501_10-Q_edgar_data_22_b.txt"}


def test_text_readers(spark, tmp_path):
    put(tmp_path, "good.txt", "héllo\nworld")
    put(tmp_path, "bad.txt", b"ab\xffcd")
    good, bad = S.read_texts(spark, str(tmp_path))
    assert [r.text for r in good.collect()] == ["héllo\nworld"] and [r.error_type for r in bad.collect()] == ["UnicodeDecodeError"]
    assert {r.text for r in S.read_texts_lossy(spark, str(tmp_path)).collect()} == {"héllo\nworld", "abcd"}
    path = put(tmp_path, "lines/l.txt", " a \n\n b\n")
    assert [r.line for r in S.read_lines(spark, path).collect()] == ["a", "b"]


def test_delimited(spark, tmp_path):
    path = put(tmp_path, "t.csv", 'cik,name,x\n00123,"a ""q"", b",1\n7,"two\nlines",\n')
    df = S.read_csv(spark, path, text_columns=("cik",), columns=["cik", "name", "x"])
    assert [tuple(r) for r in df.collect()] == [("00123", 'a "q", b', 1), ("7", "two\nlines", None)]
    tsv = put(tmp_path, "t.tsv", "a\tb\n1\t2\n")
    assert [tuple(r) for r in S.read_csv(spark, tsv, "a int, b string", sep="\t").collect()] == [(1, "2")]


def test_labels(spark, tmp_path):
    a = put(tmp_path, "x_classified.csv", " Sentence ,LABEL_PRED,label\ns1,Actionable,x\ns2,Speculative,y\ns3,,z\n")
    b = put(tmp_path, "y_classified.txt", "one | Label: Irrelevant | Score: 1\ntwo | Label: Speculative\nmalformed line\n")
    rows = S.read_classified(spark, a, b).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in rows} == {"Actionable": 1, "Speculative": 2, "Irrelevant": 1}
    only = put(tmp_path, "z.csv", "sentence,label\na,Actionable\nb,Irrelevant\n")
    assert S.read_classified(spark, only, None).count() == 2
    with pytest.raises(ValueError):
        S.parse_label_table(spark.createDataFrame([(1,)], "a int"))


def test_paths_and_config(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([("/b/x.csv",), ("/a/2024/x.csv",), ("/a/long/2024/x.csv",), ("/q/y.csv",)], "path string")
    assert {r.filename: r.path for r in S.prefer_paths(files).collect()} == {"x.csv": "/a/2024/x.csv", "y.csv": "/q/y.csv"}
    monkeypatch.delenv("CORPUS_SOURCE_DIR", raising=False)
    hint = put(tmp_path, "hint", " /from/hint \n")
    assert S.resolve_root("/arg") == "/arg" and S.resolve_root(hint_file=hint) == "/from/hint"
    monkeypatch.setenv("CORPUS_SOURCE_DIR", "/env")
    assert S.resolve_root(hint_file=hint) == "/env"
    monkeypatch.delenv("CORPUS_SOURCE_DIR")
    with pytest.raises(ValueError):
        S.resolve_root()


def test_json_and_documents(spark, tmp_path):
    log = put(tmp_path, "u.jsonl", '{"tokens": 3}\nnot json\n{"tokens": 4}\n')
    assert S.read_jsonl(spark, log, "tokens long").agg(F.sum("tokens")).first()[0] == 7
    c = put(tmp_path, "c.json", json.dumps({"a": [1.0, 2.0], "b": [0.5, 0.5]}, indent=1))
    assert {r.label: r.centroid for r in S.read_centroids(spark, c).collect()} == {"a": [1.0, 2.0], "b": [0.5, 0.5]}
    assert spark.range(1).select(S.parse_vector(F.lit("[1, 2.5]"))).first()[0] == [1.0, 2.5]
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:d>')
    assert S.document_text(spark, str(tmp_path / "d.docx")).first().text == "One two\nThree"


def test_facts(spark):
    facts = spark.createDataFrame([("g1", 2020, "USD"), ("g1", 2030, "USD"), ("g2", 2020, "USD"), ("g1", 2021, "CAD")], "gvkey string, fyear int, cur string")
    ids = spark.createDataFrame([("g1",)], "gvkey string")
    assert [tuple(r) for r in S.fundamentals(facts, ids, "gvkey", 2018, 2025, {"cur": "USD"}).collect()] == [("g1", 2020, "USD")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, 'b "q"'), (1, "a"), (3, None)], "k int, v string")
    W.write_csv(df, str(tmp_path / "csv"), ["k"])
    assert [r.k for r in S.read_csv(spark, str(tmp_path / "csv"), "k int, v string").collect()] == [1, 2, 3]
    W.write_parquet(df, str(tmp_path / "pq"), ["k"])
    assert spark.read.parquet(str(tmp_path / "pq")).where("k = 2").first().v == 'b "q"'
    W.write_lines(df, "v", str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).count() == 2
    assert json.loads(W.json_report(df.agg(F.count("*").alias("n")))) == {"n": 3}
    assert W.markdown_table(df.orderBy("k").limit(1)) == "| k | v |\n| --- | --- |\n| 1 | a |"
    assert [r.k for r in W.review_sample(df, ["k"], 2).collect()] == [1, 2]
    W.append_audit(df.select(W.audit_line(F.struct("k"), F.lit("t")).alias("line")), str(tmp_path / "audit"))
    W.append_audit(df.select(W.audit_line(F.struct("k"), F.lit("t")).alias("line")), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 6
    assert W.exists(spark, str(tmp_path / "audit")) and not W.exists(spark, str(tmp_path / "none"))


def test_fingerprints_and_reruns(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (1, "a")], "k int, v string")
    same = W.fingerprint(df.repartition(3)).first()
    assert same == W.fingerprint(df.orderBy("k")).first() != W.fingerprint(df.distinct()).first()
    done = df.where("k = 1")
    assert [r.k for r in W.not_done(df, done, "k").collect()] == [2] and W.not_done(df, done, "k", force=True).count() == 3
    ins = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "p string, modified int")
    outs = spark.createDataFrame([("a", 6), ("b", 4)], "p string, modified int")
    assert sorted(r.p for r in W.stale(ins, outs, "p").collect()) == ["b", "c"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = E.read_events(spark, str(tmp_path / "in"), events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    E.run_once(E.first_seen(stream, "40 days").select("event_id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == events.select("event_id").distinct().count()
    assert E.sliding(events).agg(F.sum("n")).first()[0] == 4 * events.count()
