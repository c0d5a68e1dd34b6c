"""Operators 2, 5 and 8 against the tokenizers library."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import MESSY, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm.op2_chunks import ChunkEncoder, encode_decode
from corpusloom.llm.op5_packing import curve_keys, hilbert_index, pack, ranges, sequence_bounds
from corpusloom.llm.op8_binary import op8_binary_tokens
from corpusloom.llm.tokens import default_vocabulary, is_plain, vocabulary

TOK = Tokenizer.from_file(default_vocabulary())


def ids_of(text, end=None):
    ids = TOK.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])
    return np.array(ids, "<u4")


@given(st.text(max_size=300))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_library(text):
    enc = vocabulary(default_vocabulary())
    assert enc.encode(text).tolist() == ids_of(text).tolist()
    assert enc.encode_slowly(text).tolist() == ids_of(text).tolist()


def test_other_splitters_go_to_the_library(tmp_path):
    import json

    spec = json.loads(open(default_vocabulary(), encoding="utf-8").read())
    assert is_plain(spec)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    text = "Some words, 12 and more"
    assert not is_plain(spec) and vocabulary(str(path)).encode(text).tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
    assert vocabulary(str(path)).encode(text).tolist() != ids_of(text).tolist()


@given(st.lists(st.text(alphabet="ab \n'st.,é <|endoftext|>12", max_size=200), min_size=1, max_size=4), st.integers(1, 50))
@settings(max_examples=200, deadline=None)
def test_chunks_are_exact_at_any_cut(parts, repeat):
    # long inputs with many shared passages, so that there are many cuts and joins
    texts = ["".join(parts) * repeat, "x" + "".join(parts) * repeat]
    enc = ChunkEncoder(vocabulary(default_vocabulary()), store_bytes=2000)
    assert [ids.tolist() for ids, _ in enc.encode(texts)] == [ids_of(t).tolist() for t in texts]


def test_chunks_are_shared():
    passage = " ".join(f"word{i} and more" for i in range(3000))
    enc = ChunkEncoder(vocabulary(default_vocabulary()))
    texts = ["first " + passage, "another start, " + passage]
    assert [i.tolist() for i, _ in enc.encode(texts)] == [ids_of(t).tolist() for t in texts]
    assert enc.reused > 0.8 * enc.encoded


def test_op2_on_messy_rows(spark):
    rows = encode_decode(documents(spark)).collect()
    want = Counter()
    for i, t in MESSY:
        ids = ids_of(t)
        text = TOK.decode(ids.tolist(), skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_op2_real_outputs(spark):
    rows = encode_decode(documents(spark), with_ids=True).collect()
    assert all(r.decoded == TOK.decode(r.ids, skip_special_tokens=False) for r in rows)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_whole_table_equals_the_library(spark, folder):
    """All documents of a table: ids and their places by the library itself."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    at, want = 0, set()
    for i in sorted(texts):
        ids = ids_of(texts[i], 2)
        want.add((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op8_binary_tokens(spark, docs).collect()} == want


def test_op8_on_messy_rows(spark):
    rows = op8_binary_tokens(spark, documents(spark)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i, _ in MESSY), key=lambda x: -1 if x is None else x)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = Counter((i, len(ids_of(t, 2)), zlib.crc32(ids_of(t, 2).tobytes())) for i, t in MESSY)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_op8_partitions_do_not_matter(spark):
    a = {tuple(r) for r in op8_binary_tokens(spark, documents(spark, MESSY[:13])).collect()}
    b = {tuple(r) for r in op8_binary_tokens(spark, documents(spark, MESSY[:13][::-1]).coalesce(1)).collect()}
    assert a == b


def test_op5_on_messy_rows(spark):
    rows = pack(spark, documents(spark), with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    ids = {i: ids_of(t, 0).tolist() for i, t in MESSY[:13]}
    for i, want in ids.items():
        got = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in got] == np.cumsum([0, *(r.length for r in got)])[:-1].tolist()
        assert [x for r in got for x in r.ids] == want and got[0].doc_tokens == len(want)
    assert sum(r.length for r in rows) == sum(len(ids_of(t, 0)) for _, t in MESSY)


def test_op5_follows_the_curve(spark):
    """Documents lie in the stream in the order of their keys, whatever the ranges; a crowded key is spread over several."""
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(words[(i * 37 + k * k) % 300] for k in range(20 + i % 60))) for i in range(400)]
    rows += [(1000 + i, "the same text again and again " * 20) for i in range(300)]
    docs = documents(spark, rows)
    out = pack(spark, docs)
    first = {r.doc_id: r.sequence_id * 1024 + r.offset for r in out.where("start = 0").collect()}
    key = dict(zip([i for i, _ in rows], curve_keys([t for _, t in rows]).tolist(), strict=True))
    order = sorted(first, key=first.get)
    assert len(order) == len(rows) and [key[i] for i in order] == sorted(key.values())
    cuts = ranges(spark.createDataFrame([(k, 100) for k in key.values()], "curve_key long, n_ids long"), 16)
    assert cuts.count >= 8 and max(p for _, p in cuts.several.values()) > 4
    keys = np.array(sorted(key.values()))
    spread = cuts.assign(keys, np.arange(len(keys)))
    lone = np.array([k not in cuts.several for k in keys.tolist()])
    assert (np.diff(spread[lone]) >= 0).all() and spread.max() < cuts.count
    counts = np.bincount(spread, minlength=cuts.count)
    assert counts.max() < 3 * len(keys) / cuts.count


def test_hilbert_curve_is_continuous():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert_index(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("total", [0, 1, 1023, 1024, 1025, 5000])
def test_tail_needs_no_padding(total):
    bounds = sequence_bounds(total)
    sizes = np.diff(np.append(bounds, total)) if total % 1024 else np.array([], int)
    assert all(n & (n - 1) == 0 for n in sizes if n) and bounds[0] == total - total % 1024


@pytest.mark.parametrize("run", [encode_decode, lambda d: pack(d.sparkSession, d), lambda d: op8_binary_tokens(d.sparkSession, d)])
def test_empty_table(spark, run):
    assert run(documents(spark).where("false")).count() == 0
