"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import op6_topk, op7_licenses
from corpusloom.llm.common import table
from corpusloom.llm.op1_secrets import find_secrets
from corpusloom.llm.op2_chunks import encode_decode
from corpusloom.llm.op3_neardup import near_duplicates
from corpusloom.llm.op4_quality import quality_scores
from corpusloom.llm.op5_packing import pack
from corpusloom.llm.op8_binary import op8_binary_tokens
from corpusloom.llm.op9_pii import find_personal_data
from corpusloom.llm.op10_rules import quality_rules


def op1_secrets(spark, sf_dir):
    return find_secrets(spark, table(spark, sf_dir, "documents")).drop("found")


def op2_chunks(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents"))


def op3_neardup(spark, sf_dir):
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark, sf_dir):
    return pack(spark, table(spark, sf_dir, "documents"))


def op6_topk_ta(spark, sf_dir):
    return op6_topk.top_k_of_table(table(spark, sf_dir, "embeddings"))


def op7_licenses_tfidf(spark, sf_dir):
    """Documents as files: <source>/<thousand>/<hundred>/<name>; ids that end in 00 are their folder's LICENSE file."""
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id").cast("long")
    name = F.when(d % 1000 == 0, F.lit("LICENSE")).when(d % 100 == 0, F.concat((F.floor(d / 100)).cast("string"), F.lit("/LICENSE")))
    name = F.coalesce(name, F.concat(F.floor(d / 100).cast("string"), F.lit("/"), d.cast("string"), F.lit(".txt")))
    path = F.concat(F.lit("t"), F.floor(d / 1000).cast("string"), F.lit("/"), name)
    files = docs.select(d.alias("key"), path.alias("path"), "text")
    out = op7_licenses.license_scan(files)
    return out.select(F.col("key").alias("doc_id"), "path", "licence", "score", "found", "origin")


def op8_binary(spark, sf_dir):
    return op8_binary_tokens(spark, table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return find_personal_data(spark, table(spark, sf_dir, "documents")).drop("found")


def op10_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_chunks, op3_neardup, op4_quality, op5_packing, op6_topk_ta, op7_licenses_tfidf, op8_binary, op9_pii, op10_rules)}
SQL: dict[str, str] = {"op6_topk_ta": op6_topk.SQL, "op7_licenses_tfidf": op7_licenses.SQL}
