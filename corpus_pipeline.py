"""A training-data pipeline over ``documents``: quality classifier, quality rules, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
The two classifiers are fitted, in a task, on the bounded labelled sample of the documents table in ``sf_dir``. Near-duplicates
use operator 3's contract: distinct two-word shingles, similarity 0.8.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import op4_quality, op10_rules
from corpusloom.llm.common import Scratch, table
from corpusloom.llm.op3_neardup import keep_one_of_each
from corpusloom.llm.op5_packing import pack
from corpusloom.llm.op9_pii import sanitise
from corpusloom.llm.training import Sample, fit_on_sample, labelled_sample


def _sample(spark: SparkSession, sf_dir: str) -> Sample:
    return labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _fitted(spark: SparkSession, sf_dir: str, fit: Callable[[Sample], dict]) -> dict:
    return fit_on_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fit)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below 0.3 go."""
    return op4_quality.keep_scored(docs, _fitted(spark, sf_dir, lambda sample: op4_quality.fit(*sample)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or hold mostly boilerplate lines go."""
    return op10_rules.keep_content(docs, _fitted(spark, sf_dir, lambda sample: op10_rules.fit(sample.rows)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return keep_one_of_each(spark, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced; every document stays."""
    return sanitise(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return pack(spark, docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: SQL can't express the trained models, the components or the tokenizer; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each stage's rows are written to the shared folder and read again as the next one's."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
