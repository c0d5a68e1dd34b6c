"""Scalar text functions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import numbers as N
from corpusloom.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


def column(spark, make, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x")).alias("y")).collect()]


def plain_norm(s):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]+", " ", s.lower().strip())).strip()


def test_normalize_like_unicode_regex(spark):
    values = [" AI,\nSentence!!  ", "Café crème — été", "curly “quotes” here", "nb sp", "a\x1cb", "x_y z", "", "ÜBER-ALLES 12%"]
    assert column(spark, T.normalize_sentence, values) == [plain_norm(v) for v in values]


def test_stable_ids(spark):
    got = column(spark, lambda x: T.stable_id(x, F.lit("3"), F.lit("norm")), ["file.txt"])
    assert got == [hashlib.sha1(b"file.txt|3|norm").hexdigest()[:16]]


def test_token_count_and_bins(spark):
    assert column(spark, T.token_count, ["a b  c", "", " x ", "a b"]) == [3, 0, 1, 2]
    assert column(spark, T.length_bin, [12, 13, 24, 25], "int") == ["short", "medium", "medium", "long"]


def test_integrity_flags(spark):
    got = column(spark, T.integrity_flags, ["artificial intelligence", "The company uses many models today.", "", None, "It — 4 — goes on"])
    assert got == [["missing_terminal_punct", "lowercase_start", "short_sentence"], [], ["short_sentence"], ["short_sentence"], ["missing_terminal_punct", "page_fragment_like"]]
    assert column(spark, lambda x: T.fragment_score(T.integrity_flags(x)), ["artificial intelligence"]) == [0.75]


def test_entity_ids(spark):
    values = ["0000320193", "320193", "320193.0", "", None, "CIK 123", "12345678901"]
    assert column(spark, T.cik_padded, values) == ["0000320193", "0000320193", "0003201930", None, None, "0000000123", "12345678901"]
    assert column(spark, T.cik_stripped, values) == ["320193", "320193", "320193", "", "", "123", "12345678901"]


def test_industries(spark):
    values = ["3571", "2834", "3714", "3712", "6021", "4911", "3693", "", "abc", None, "3571.0"]
    assert column(spark, T.ff12_code, values) == [6, 10, 2, 3, 11, 8, 10, 12, 12, 12, 6]
    assert column(spark, T.ff12_name, [1, 12], "int") == ["NoDur", "Other"]


def test_company_names(spark):
    values = ["Foo Holdings Inc.", "Bar Corp", "Co", "A.B. Group", None]
    assert column(spark, T.clean_company, values) == ["foo", "bar", "co", "ab", ""]


def test_labels_flags_and_numbers(spark):
    assert column(spark, T.is_true, ["1", " TRUE ", "t", "no", None]) == [1, 1, 1, 0, 0]
    assert column(spark, T.allowed_label, ["Actionable", " Irrelevant", "x", None]) == ["Actionable", "Irrelevant", None, None]
    assert column(spark, T.safe_int, ["3.9", "-2", "x", None, "nan", "1e3"]) == [3, -2, None, None, None, 1000]
    assert column(spark, T.edge_case, ["We may grow", "maybe", None]) == [True, False, False]


def test_filing_paths(spark):
    path = "/c/2021/QTR1/20210301_10-K_edgar_data_320193_0000320193-21-000001.txt"
    p = one(spark, T.filing_parts(F.col("x")), path)
    assert (p.year, p.quarter, p.form, p.cik) == (2021, 1, "10-K", "320193")
    assert one(spark, T.filing_parts(F.col("x")), "/c/README.txt").cik is None
    assert column(spark, T.source_window, [2020, 2021, 2024, 2025], "int") == ["historical_2000_2020", "active_2021_2024", "active_2021_2024", "historical_2000_2020"]


def test_validity_and_quotes(spark):
    values = ["Too few words.", "The firm uses models for every one of its plants.", "the firm uses models for every one of its plants.", "The firm uses models for every one of its plants"]
    assert column(spark, T.validity_reason, values) == ["tokens<6", "", "no_initial_cap", "no_terminal_punct"]
    assert column(spark, T.strip_quotes, ['  “Hello   there”  ', "'x'"]) == ["Hello there", "x"]


def test_fragment_heuristic(spark):
    values = ["", "Four words only here", "This sentence is quite long enough.", "this sentence is quite long enough.", "a) the item is long enough.", "This sentence is quite long enough;"]
    assert column(spark, T.looks_fragmented, values) == [True, True, False, True, True, True]


def test_secrets_and_commands(spark):
    key = "sk-" + "a1" * 12
    assert column(spark, T.redact, [f"use {key} now"]) == ["use [REDACTED_SECRET] now"]
    assert column(spark, T.has_secret, [f"x {key}", "sk-short", None]) == [True, False, False]
    assert column(spark, T.command_stem, ["Step command failed: /usr/bin/make all", "other", "", None]) == ["make", "other", "unknown", "unknown"]


def test_numbers(spark):
    assert column(spark, lambda x: N.ratio(x, x), [0.0, 2.0], "double") == [None, 1.0]
    assert column(spark, N.ln_positive, [0.0, 1.0], "double") == [None, 0.0]
    assert column(spark, N.finite, [float("inf"), float("nan"), 1.0, None], "double") == [None, None, 1.0, None]
    assert column(spark, lambda x: N.half_even(x), [0.5, 1.5, 2.5], "double") == [0.0, 2.0, 2.0]
    assert column(spark, lambda x: N.numeric(x, -0.3), ["1.5", "C", None]) == [1.5, -0.3, -0.3]
    assert one(spark, N.cosine(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(1.0))), "x") == pytest.approx(0.8)
    assert one(spark, N.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0))), "x") is None
    assert one(spark, N.argmax(("A", "S", "I"), [F.lit(0.2), F.lit(0.4), F.lit(0.4)]), "x") == "S"
    assert one(spark, N.margin([F.lit(0.2), F.lit(0.5), F.lit(0.4)]), "x") == pytest.approx(0.1)
    assert column(spark, lambda x: N.compare(x, "not_in", [1, 2]), [1, 3, None], "int") == [False, True, False]
    with pytest.raises(ValueError):
        N.compare(F.lit(1), "~", 1)
