"""Files as sources: documents of a folder, CSV side inputs, their keys, hashes and texts.

PDF and DOCX are read with the standard library; other formats need a parser, which is a parameter.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolcraft.operators import facts
from poolcraft.sources import pdf

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def stem(name: Column) -> Column:
    """A file name without its folder and its last extension."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")


def stable_id(name: Column) -> Column:
    """The same number for the same file stem on every run, from 1,000,000 up."""
    return F.pmod(F.conv(F.substring(F.sha2(stem(name), 256), 1, 8), 16, 10).cast("bigint"), F.lit(900_000_000)) + 1_000_000


def documents(spark: SparkSession, folder: str, formats: tuple[str, ...] = ("pdf", "docx")) -> DataFrame:
    """(id, name, ext, sha256, content) of the files of a folder, subfolders aside; of equal stems the first format counts."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join([*formats, *(f.upper() for f in formats)]) + "}").load(folder)
    rows = raw.select(stem(F.col("path")).alias("name"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("ext"), "content")
    rank = F.array_position(F.lit(list(formats)), F.col("ext"))
    first = rows.groupBy("name").agg(F.min_by(F.struct("ext", "content"), rank).alias("f")).select("name", "f.ext", "f.content")
    return first.select(stable_id(F.col("name")).alias("id"), "name", "ext", F.sha2("content", 256).alias("sha256"), "content")


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file, one a line; empty when it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    lines = []
    for paragraph in root.iter(f"{_W}p"):
        parts = [("\n" if node.tag == f"{_W}br" else "\t" if node.tag == f"{_W}tab" else node.text or "") for node in paragraph.iter() if node.tag in (f"{_W}t", f"{_W}br", f"{_W}tab")]
        lines.append("".join(parts))
    return "\n".join(lines)


_SPANS = "array<struct<page:int,text:string,size:double,color:int,mode:int>>"
_META = "struct<producer:string,creator:string,created:string,modified:string>"


def _read(ext: str, content: bytes, readers: dict[str, Callable[[bytes], str]]) -> dict:
    if ext in readers:
        return {"markdown": readers[ext](content)}
    if ext == "pdf":
        return pdf.read(content) or {"markdown": ""}
    return {"markdown": docx_text(content) if ext == "docx" else None}


def parsed(files: DataFrame, parsers: dict[str, Callable[[bytes], str]] | None = None, min_chars: int = 200) -> DataFrame:
    """(id, markdown, sha256, text_chars, problem, meta, hidden_text, pages): texts of :func:`documents`; problem is ``unsupported_format``, ``unparseable`` (too short) or null.

    PDF and DOCX are read here; ``parsers`` replaces or adds formats by their extension. ``hidden_text`` has the spans of a PDF that a reader can't see (with why), and
    whether one of them says something; formats without drawn text have none, and no meta and pages.
    """
    readers = parsers or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_read(ext, content, readers) for ext, content in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            spans = pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string()), ("size", pa.float64()), ("color", pa.int32()), ("mode", pa.int32())]))
            meta = pa.struct([(name, pa.string()) for name in ("producer", "creator", "created", "modified")])
            columns = [pa.array([f.get(name) for f in found], kind) for name, kind in (("markdown", pa.string()), ("meta", meta), ("pages", pa.int32()), ("spans", spans))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["id", "sha256", "markdown", "meta", "pages", "spans"])

    texts = files.select("id", "ext", "sha256", "content").mapInArrow(run, f"id bigint, sha256 string, markdown string, meta {_META}, pages int, spans {_SPANS}")
    problem = F.when(F.col("markdown").isNull(), "unsupported_format").when(F.length("markdown") < min_chars, "unparseable")
    seen = F.transform(F.coalesce("spans", F.array().cast(_SPANS)), lambda s: F.struct(s["page"].alias("page"), facts.span_kind(s["color"], s["size"], s["mode"]).alias("kind"), F.substring(s["text"], 1, 200).alias("text"), s["size"].alias("size"), facts.says_something(s["text"]).alias("substantive")))
    hidden = F.filter(seen, lambda s: s["kind"].isNotNull())
    rows = texts.select("id", "markdown", "sha256", F.coalesce(F.length("markdown"), F.lit(0)).alias("text_chars"), problem.alias("problem"), "meta", hidden.alias("__hidden"), "pages")
    return rows.select(
        "id", "markdown", "sha256", "text_chars", "problem", "meta", F.struct(F.exists("__hidden", lambda s: s["substantive"]).alias("found"), F.col("__hidden").alias("spans")).alias("hidden_text"), "pages",
    )


def side_input(spark: SparkSession, path: str, key: str = "Name") -> DataFrame:
    """Rows of CSV files with a header, one per folded ``key``: the last one wins (of several files, in the last file by path), blank keys are dropped.

    A file with line breaks in values is read by one task, so its rows are numbered in order.
    """
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    folded = rows.withColumn("key", F.lower(F.trim(F.col(key)))).withColumn("__at", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"))).filter("key <> ''")
    columns = [c for c in rows.columns if c != "key"]
    return folded.groupBy("key").agg(F.max_by(F.struct(*columns), "__at").alias("r")).select("key", "r.*")


def write_snapshot(df: DataFrame, root: str, version: str) -> str:
    """Write one version of a table beside the others; a reader of another version is never disturbed."""
    path = f"{root}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def versions(spark: SparkSession, root: str) -> list[str]:
    """The versions of a table that are there; none where the folder isn't. Only the files' names are read."""
    try:
        marks = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(root).select("path")
        return sorted(r.v for r in marks.select(F.regexp_extract("path", "/version=([^/]+)/", 1).alias("v")).filter("v <> ''").distinct().collect())  # a row per version
    except AnalysisException:
        return []


def read_snapshot(spark: SparkSession, root: str, schema: str, version: str) -> DataFrame:
    """One version of a table; empty when there is none at all. A missing version beside others is an error: going on without it would forget all it held."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/version={version}")
    except AnalysisException:
        if there := versions(spark, root):
            raise FileNotFoundError(f"version {version} of {root} is missing; there are {', '.join(there[-3:])}") from None
        return spark.createDataFrame([], schema)
