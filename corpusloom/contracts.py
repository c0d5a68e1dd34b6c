"""Schema contracts: required columns, synonyms, unique keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table doesn't meet its contract."""


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{what} lacks {', '.join(missing)}")
    return df


def resolve_column(df: DataFrame, synonyms: Iterable[str]) -> str | None:
    """The first of ``synonyms`` that the table has, whatever its case."""
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    return next((by_lower[s.lower()] for s in synonyms if s.lower() in by_lower), None)


def with_synonyms(df: DataFrame, canonical: dict[str, Iterable[str]]) -> DataFrame:
    """Copy each canonical column from the first synonym present, where the column itself is absent."""
    for name, synonyms in canonical.items():
        if name not in df.columns and (found := resolve_column(df, synonyms)):
            df = df.withColumn(name, F.col(found))
    return df


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add the missing columns as literals."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def order_columns(df: DataFrame, preferred: Iterable[str]) -> DataFrame:
    """Preferred columns that exist first, the rest in their order."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """Raise if a key occurs twice (one partial aggregation, one row fetched)."""
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ContractError(f"{what}: duplicate key {[bad[0][k] for k in keys]}")
    return df


#: Ordered columns of the canonical tables.
SENTENCE_TABLE = ("sentence_id", "sentence_text_id", "sentence", "sentence_norm", "source_file", "source_year", "source_quarter", "source_form", "source_cik", "sentence_index", "extractor_version", "keyword_version", "manifest_id", "source_window_id", "integrity_flags", "fragment_score", "token_count")
LABELED_DATASET = ("sample_id", "sentence_id", "sentence", "sentence_norm", "label", "is_uncertain", "uncertainty_note", "source_file", "source_year", "source_form", "source_cik", "sentence_index", "sic", "sic2", "ff12_code", "ff12_name", "token_count", "length_bin", "edge_case_flag")
FILINGS_INDEX = ("cik", "year", "quarter", "form", "filename", "path", "source_root", "index_timestamp", "source_window_id")
LABELS = ("Actionable", "Speculative", "Irrelevant")
