"""The pipeline's stages one by one and together, on a table written for the test."""

import random

import numpy as np
import pytest
from helpers import MESSY, OTHER, PROSE, labelled_documents

import corpus_pipeline as C
from corpusloom.llm import op4_quality as Q
from corpusloom.llm import op9_pii as P
from corpusloom.llm import op10_rules as R
from corpusloom.llm.tokens import default_vocabulary, vocabulary
from test_neardup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows():
    r = random.Random(8)
    words = (PROSE + " " + OTHER).replace(".", "").split()
    clean = [(1000 + i, " ".join(r.choice(words) for _ in range(90)) + ".") for i in range(40)]
    copies = [(2000 + i, clean[i % 3][1] + ("" if i % 2 else " End.")) for i in range(12)]
    private = [(3000 + i, " ".join(r.choice(words) for _ in range(50)) + f" mail me{i}@example.org now.") for i in range(4)]
    return MESSY + labelled_documents() + clean + copies + private


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    data = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows()]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(100 + i, 1, 0) for i in range(30)] + [(200 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def plain(sample):
    """The same pipeline by plain Python: the kept documents and their texts."""
    docs = [(i, t or "") for i, t in rows()]
    model = Q.fit(*sample)
    docs = [d for d in docs if Q.score(model, [d[1].encode()])[0] >= Q.THRESHOLD]
    crf = R.fit(sample.rows)
    docs = [d for d in docs if R.verdicts([d[1]], crf)["kept"][0]]
    group = brute(docs)
    kept = {i for i, c in group.items() if i == c}
    return list(dict.fromkeys(d for d in docs if d[0] in kept)) + [d for d in docs if d[0] is None]


def test_stages(spark, folder):
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "personal_data", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = plain(C._sample(spark, folder))
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == COLUMNS
        data = docs.collect()
        assert all((r.n_chars or 0) == len(r.text or "") for r in data)
        docs = spark.createDataFrame(data, docs.schema).repartition(2)
    kept = sorted((r.doc_id, r.text) for r in data if r.doc_id is not None)
    texts = {}
    for i, t in want:
        if i is not None:
            found = [s for s in P.base_spans(t)]
            texts[i] = P.clean_text(t, found)
    assert [i for i, _ in kept] == sorted(texts)
    assert {i for i in range(1003, 1040)} <= {i for i, _ in kept}
    assert not {i for i in range(2000, 2012)} & {i for i, _ in kept}
    assert all(t == texts[i] for i, t in kept if i < 3000)
    assert all("<EMAIL>" in t for i, t in kept if i >= 3000)
    packed = C.packing(spark, docs, folder).collect()
    enc = vocabulary(default_vocabulary())
    assert sum(r.length for r in packed) == sum(len(enc.encode(r.text)) + 1 for r in data)


def test_no_text_comes_to_the_driver(spark, folder, monkeypatch):
    """Both classifiers are fitted in a task, as on the collected sample."""
    want = C._sample(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: seen.extend(out := collect(self)) or out)
    stages = [stage(spark, docs, folder) for _, stage in C.STAGES[:2]]
    assert not any(isinstance(x, str) for r in seen for x in r)
    monkeypatch.undo()
    for got, keep in zip(stages, (Q.keep_quality, R.keep_by_rules), strict=True):
        assert sorted(got.collect(), key=repr) == sorted(keep(docs, want).collect(), key=repr)


def test_run(spark, folder):
    out = C.run(spark, folder)
    assert out.columns[:3] == ["doc_id", "start", "length"]
    rows_ = out.collect()
    assert {r.doc_id for r in rows_} >= set(range(1003, 1040))
    used = np.zeros(max(r.sequence_id for r in rows_) + 1, int)
    for r in rows_:
        used[r.sequence_id] += r.length
    assert set(used[:-12].tolist()) <= {1024}


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
