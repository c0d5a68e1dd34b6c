"""Sources: corpus trees, delimited and JSON tables, line formats, JDBC, documents, configuration."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.contracts import FILINGS_INDEX, resolve_column
from corpusloom.functions import text as T


def resolve_root(argument: str = "", environment: str = "CORPUS_SOURCE_DIR", hint_file: str = "") -> str:
    """Source root: the argument, else the environment, else the hint file's content, else an error."""
    if argument:
        return argument
    if os.environ.get(environment, "").strip():
        return os.environ[environment].strip()
    if hint_file and os.path.exists(hint_file):
        with open(hint_file, encoding="utf-8", errors="ignore") as f:
            if hint := f.read().strip():
                return hint
    raise ValueError(f"no source root: pass one, set {environment} or write {hint_file or 'a hint file'}")


def corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the *.txt files in <root>/<YYYY>/QTR[1-4]/, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    return files.select("path", "length").where(F.col("path").rlike(r"(?i)/\d{4}/QTR[1-4]/[^/]+\.txt$"))


def filings_index(files: DataFrame, source_root: str = "", stamp: str = "") -> tuple[DataFrame, DataFrame]:
    """(index in contract order, unmatched paths) of corpus files."""
    parts = files.withColumn("_p", T.filing_parts(F.col("path")))
    good = parts.where(F.col("_p.cik").isNotNull())
    index = good.select(
        F.col("_p.cik").alias("cik"),
        F.col("_p.year").alias("year"),
        F.col("_p.quarter").alias("quarter"),
        F.col("_p.form").alias("form"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        "path",
        F.lit(source_root).alias("source_root"),
        F.lit(stamp).alias("index_timestamp"),
        T.source_window(F.col("_p.year")).alias("source_window_id"),
    )
    return index.select(*FILINGS_INDEX), parts.where(F.col("_p.cik").isNull()).select("path")


def filing_filter(index: DataFrame, forms: list[str] | None = None, years: list[int] | None = None, window: str | None = None) -> DataFrame:
    """Only originals (no derived files), of the given forms, years and source window."""
    out = index.where(F.col("source_window_id") == window) if window else index
    for suffix in T.DERIVED_SUFFIXES:
        out = out.where(~F.col("filename").endswith(suffix))
    if forms:
        out = out.where(F.upper("form").isin(*[f.upper() for f in forms]))
    return out.where(F.col("year").isin(*years)) if years else out


def read_texts(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(path, text) of files that are valid UTF-8, and (path, error_type, error) of the others."""
    raw = spark.read.format("binaryFile").load(paths)
    ok = F.is_valid_utf8("content")
    return raw.where(ok).select("path", F.col("content").cast("string").alias("text")), raw.where(~ok).select("path", F.lit("UnicodeDecodeError").alias("error_type"), F.lit("not valid UTF-8").alias("error"))


def read_texts_lossy(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) with invalid bytes dropped."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select("path", F.replace(F.make_valid_utf8("content"), F.lit("�"), F.lit("")).alias("text"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", columns: list[str] | None = None, text_columns: tuple[str, ...] = ()) -> DataFrame:
    """Header CSV or TSV: a declared schema, else inferred types with ``text_columns`` kept as text; ``columns`` are pruned at the scan."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
    if schema:
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", True).csv(path)
        if text_columns:
            # a second look at the header with the text columns declared: "00123" must not turn into 123
            declared = ", ".join(f"`{n}` {'string' if n in text_columns else t}" for n, t in df.dtypes)
            df = reader.option("inferSchema", False).schema(declared).csv(path)
    return df.select(*columns) if columns else df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of non-blank lines, stripped."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), T.squeeze_ends(F.col("value")).alias("line")).where("line <> ''")


def parse_label_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """sentence and label of ``sentence | Label: X | ...`` lines; malformed lines are dropped."""
    rest = F.split(line, r" \| Label: ", 2)
    return lines.where(F.size(rest) == 2).select(*[c for c in lines.columns if c != line], rest[0].alias("sentence"), F.trim(F.split(rest[1], r" \|")[0]).alias("label")).where("label <> ''")


def parse_label_table(df: DataFrame) -> DataFrame:
    """sentence and label of a classified table: header case and blanks aside, label_pred before label; blanks dropped."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    found = resolve_column(df, ("label_pred", "label"))
    if found is None:
        raise ValueError("no label_pred or label column")
    rest = [c for c in df.columns if c not in ("label", "label_pred")]
    return df.select(*rest, F.trim(F.col(found)).alias("label")).where("label is not null and label <> ''")


def read_classified(spark: SparkSession, csv_path: str | None, txt_path: str | None) -> DataFrame:
    """(path, label) of classified CSV and legacy text files together."""
    parts = []
    if csv_path:
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(csv_path)
        parts.append(parse_label_table(raw.select("*", F.col("_metadata.file_path").alias("path"))).select("path", "label"))
    if txt_path:
        parts.append(parse_label_lines(read_lines(spark, txt_path)).select("path", "label"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefer_paths(files: DataFrame) -> DataFrame:
    """One path per base name: in a year folder first, then the shorter, then the first in order."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rank = F.struct(F.when(F.col("path").rlike(r"/\d{4}/[^/]+$"), 0).otherwise(1), F.length("path"), F.col("path"))
    return files.groupBy(name.alias("filename")).agg(F.min_by("path", rank).alias("path"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that can't be parsed are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(label, centroid) of a {label: [numbers]} JSON file."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<double>>").alias("m"))
    return raw.select(F.explode("m").alias("label", "centroid"))


def parse_vector(x: Column) -> Column:
    """Array of a stringified list of numbers, null if it isn't one."""
    return F.from_json(x, "array<double>")


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query on a JDBC source (driver on the class path); partition with partitionColumn, lowerBound, upperBound, numPartitions."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def company_table(companies: DataFrame) -> DataFrame:
    """gvkey, cik, tic, conm of a company table whose column set varies: the ticker upper-cased, blank ids "" instead of null.

    Where the table has no ``cik`` (the full projection fails there), the reduced one is taken and ``cik`` is "".
    """
    known = {c.lower(): c for c in companies.columns}
    text = lambda c: F.when(F.col(known[c]).isNull(), "").otherwise(F.trim(F.col(known[c]).cast("string"))) if c in known else F.lit("")
    if "gvkey" not in known:
        raise ValueError("a company table needs gvkey")
    return companies.select(F.col(known["gvkey"]).cast("string").alias("gvkey"), text("cik").alias("cik"), F.upper(text("tic")).alias("tic"), text("conm").alias("conm"))


def dated_pull(rows: DataFrame, date: str, first: str, last: str, columns: list[str] | None = None) -> DataFrame:
    """Rows dated ``first`` to ``last``, both included; the range reaches the scan as pushed filters."""
    out = rows.where(F.col(date).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))
    return out.select(*columns) if columns else out


def in_list(rows: DataFrame, key: str, values: DataFrame | list, first_year: int | None = None, last_year: int | None = None, year: str = "fyear") -> DataFrame:
    """A parameterised pull: rows whose key is one of ``values`` (a short list as a predicate, a table as a semi-join) in a year range."""
    out = rows if first_year is None else rows.where(F.col(year).between(first_year, last_year))
    if isinstance(values, list):
        return out.where(F.col(key).isin(*values)) if values else out.where(F.lit(False))
    return out.join(values.select(key).distinct(), key, "left_semi")


def fundamentals(facts: DataFrame, ids: DataFrame, key: str, first_year: int, last_year: int, fixed: dict[str, str]) -> DataFrame:
    """Yearly facts of the wanted entities: fixed attributes, a year range and a semi-join on the ids."""
    out = facts.where(F.col("fyear").between(first_year, last_year))
    for c, v in fixed.items():
        out = out.where(F.col(c) == v)
    return out.join(ids.select(key).distinct(), key, "left_semi")


def document_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of DOCX and Markdown files; a DOCX file is read through its XML, without further packages."""
    @F.pandas_udf("string")
    def body(names: pd.Series, content: pd.Series) -> pd.Series:
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        def one(name: str, data: bytes) -> str:
            if not name.lower().endswith(".docx"):
                return data.decode("utf-8", "ignore")
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
            paragraphs = ("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in root.iter() if p.tag.endswith("}p"))
            return re.sub(r"\n{3,}", "\n\n", "\n".join(paragraphs))

        return pd.Series([one(n, d) for n, d in zip(names, content, strict=True)])

    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", body("path", "content").alias("text"))
