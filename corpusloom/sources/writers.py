"""Sinks: CSV, Parquet, text, JSON reports, Markdown tables, audit lines, content fingerprints, idempotent writes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Sorted, with header. The parts are in order; small results come as one part by adaptive coalescing."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A line per non-null value. Without any the folder holds the writer's ``_SUCCESS`` marker and an empty part: done, and empty."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").write.mode("overwrite").text(path)


def review_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """First rows in order, a report feature (top-n without a full sort)."""
    return df.orderBy(*order).limit(n)


def json_report(one_row: DataFrame) -> str:
    """A one-row aggregate as a JSON document."""
    rows = one_row.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report needs exactly one row")
    return json.dumps(rows[0].asDict(recursive=True), indent=2, default=str)


def markdown_table(small: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; one of more than ``limit`` rows isn't a report and raises an error."""
    rows = small.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table has {limit} rows at most")
    head = "| " + " | ".join(small.columns) + " |\n|" + " --- |" * len(small.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def audit_line(payload: Column, at: Column) -> Column:
    """JSON line of an event with the SHA-256 of its payload."""
    return F.to_json(F.struct(at.alias("at"), payload.alias("payload"), F.sha2(F.to_json(payload), 256).alias("payload_sha256")))


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and an order-insensitive content hash (sums of two row hashes), without gathering the rows."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    h1, h2 = F.xxhash64(row, F.lit(1)).cast("decimal(38,0)"), F.xxhash64(row, F.lit(2)).cast("decimal(38,0)")
    one = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h1), F.lit(0)).alias("a"), F.coalesce(F.sum(h2), F.lit(0)).alias("b"))
    return one.select("rows", F.sha2(F.concat_ws("|", "rows", "a", "b"), 256).alias("fingerprint"))


def row_hash(columns: list[str]) -> Column:
    """Order-sensitive SHA-256 of a row's values."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def write_if(df: DataFrame, gate: DataFrame, path: str) -> str:
    """Write ``df`` as Parquet only if the one-row ``gate`` (see ``qa_gate``) has the status "pass"; returns the status."""
    status = gate.select("status").first()["status"]
    if status == "pass":
        write_parquet(df, path)
    return status


#: How the table formats mark head and cells.
_FORMATS = {
    "txt": ("", "  ".join, "", ""),
    "csv": ("", ",".join, "", ""),
    "md": ("", lambda c: "| " + " | ".join(c) + " |", "", ""),
    "tex": ("\\begin{tabular}{%s}", lambda c: " & ".join(c) + r" \\", "", "\\end{tabular}"),
    "html": ("<table>", lambda c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>", "", "</table>"),
}


def format_table(small: DataFrame, kind: str, limit: int = 1000) -> str:
    """A small result as txt, csv, md, tex or html; ``docx_table`` makes a document of it."""
    rows = small.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table has {limit} rows at most")
    cells = [list(small.columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    if kind == "csv":
        cells = [['"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n') else x for x in r] for r in cells]
    if kind == "html":
        cells = [[x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for x in r] for r in cells]
    if kind == "tex":
        cells = [["".join("\\" + c if c in "&%$#_{}" else c for c in x) for x in r] for r in cells]
    if kind == "txt":
        width = [max(len(r[k]) for r in cells) for k in range(len(cells[0]))]
        cells = [[x.ljust(w) for x, w in zip(r, width, strict=True)] for r in cells]
    first, line, _, last = _FORMATS[kind]
    body = [line(r).rstrip() for r in cells]
    if kind == "md":
        body.insert(1, "|" + " --- |" * len(small.columns))
    if kind == "tex":
        first = first % ("l" * len(small.columns))
    return "\n".join([x for x in (first, *body, last) if x])


def docx_table(small: DataFrame, path: str, limit: int = 1000) -> None:
    """A small result as a one-table DOCX file (plain WordprocessingML)."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    rows = small.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table has {limit} rows at most")
    cell = lambda v: f"<w:tc><w:p><w:r><w:t>{escape('' if v is None else str(v))}</w:t></w:r></w:p></w:tc>"
    body = "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in [small.columns, *rows])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl>{body}</w:tbl></w:body></w:document>')
    put_bytes(small.sparkSession, path, out.getvalue())


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file through Spark's own file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def not_done(work: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Work items without an output yet; all of them if forced."""
    return work if force else work.join(done.select(key).distinct(), key, "left_anti")


def stale(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Items whose output is missing or older than the input (columns key, modified)."""
    out = outputs.select(key, F.col("modified").alias("_out"))
    return inputs.join(out, key, "left").where("_out is null or modified > _out").drop("_out")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
