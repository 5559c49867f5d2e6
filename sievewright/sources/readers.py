"""Readers: JSON documents, chunks, records and score sheets as DataFrames, with columns derived from paths."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import schemas


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Pretty-printed JSON files under a folder, with file_path; strict: a file that is no JSON fails the read."""
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    reader = reader.option("mode", "FAILFAST") if strict else reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.json(path).withColumn("file_path", F.url_decode(F.col("_metadata.file_path")))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """A row for each section of cleaned documents: files without doc_id or chunks are left out, and sections without text."""
    docs = read_json(spark, path, schemas.CLEANED).where("doc_id is not null and chunks is not null")
    rows = docs.select("*", F.posexplode("chunks").alias("split_index", "c")).where("c.text is not null")
    kind = F.when(T.source_type(F.col("file_path")) == "unknown", F.coalesce("source_type", F.lit("unknown"))).otherwise(T.source_type(F.col("file_path")))
    return rows.select(
        "doc_id", "created_date", F.coalesce("country", T.country(F.col("file_path"))).alias("country"), kind.alias("source_type"),
        T.case_name(F.col("file_path")).alias("case"), "file_path", F.col("split_index").cast("string").alias("split_index"),
        "c.heading", "c.text", "c.start_page", "c.end_page", "c.table_type",
    )


def chunks(spark: SparkSession, path: str, case: str | None = None) -> DataFrame:
    """A row for each retrieval chunk that is not blank; of one case, if its folder has any, else of all."""
    docs = read_json(spark, path, schemas.CHUNKED)
    rows = docs.select("file_path", F.explode("chunks").alias("c")).select("file_path", "c.text", "c.metadata.*")
    rows = rows.where(F.trim("text") != "").withColumn("case", T.case_name(F.col("file_path")))
    for flag in ("oversized_split", "merged"):
        rows = rows.withColumn(flag, F.coalesce(flag, F.lit(False)))
    if case is None or rows.where(F.col("case") == case).isEmpty():
        return rows
    return rows.where(F.col("case") == case)


def translations(spark: SparkSession, path: str) -> DataFrame:
    """The quality scores of every translated document, flat; the inner processing time counts where the outer one is missing."""
    docs = read_json(spark, path, schemas.CLEANED).where("_translation_metadata is not null")
    m = "_translation_metadata"
    q = f"{m}.quality_scores"
    return docs.select(
        "doc_id", "country", T.source_type(F.col("file_path")).alias("source_type"), T.case_name(F.col("file_path")).alias("case"),
        F.col(f"{m}.translation_decision").alias("decision"), F.col(f"{q}.overall").alias("overall"),
        *(F.col(f"{q}.linguistic.{c}").alias(c) for c in ("fluency", "accuracy", "consistency", "completeness", "linguistic_composite")),
        *(F.col(f"{q}.domain_specific.{c}").alias(c) for c in ("medical_terminology", "numerical_integrity", "statistical_terms", "unit_preservation", "domain_composite")),
        *(F.col(f"{q}.structural.{c}").alias(c) for c in ("format_preservation", "document_integrity", "information_architecture", "structural_composite")),
        F.coalesce(f"{m}.total_processing_time_seconds", f"{m}.translation_metadata.processing_time_seconds").alias("seconds"),
    )


def picos(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record; errors of the extraction have a column of their own."""
    rows = read_json(spark, path, schemas.PICOS, strict=True)
    rows = rows.select("file_path", "extraction_metadata.source_type", "extraction_metadata.indication", F.explode("picos_by_country").alias("country", "r"))
    return rows.select("file_path", "source_type", "indication", "country", "r.Error", F.explode_outer("r.PICOs").alias("p")).select("file_path", "source_type", "indication", "country", F.col("Error").alias("error"), "p.*")


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    rows = read_json(spark, path, schemas.OUTCOMES, strict=True)
    rows = rows.select("file_path", "extraction_metadata.source_type", "extraction_metadata.indication", F.explode("outcomes_by_country").alias("country", "r"))
    return rows.select("file_path", "source_type", "indication", "country", F.col("r.Outcomes").alias("outcomes"), F.col("r.Error").alias("error"))


def consolidated_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """category, subcategory and outcome, with the number that the file states; count the rows for the true one."""
    rows = read_json(spark, path, schemas.CONSOLIDATED_OUTCOMES, strict=True)
    rows = rows.select("file_path", "outcomes_metadata.*", F.explode("consolidated_outcomes").alias("category", "subs"))
    rows = rows.select("*", F.explode("subs").alias("subcategory", "names")).select("*", F.explode("names").alias("outcome"))
    return rows.drop("subs", "names")


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.url_decode("path").alias("path"), F.col("modificationTime").alias("modified"), "length", "content")


PAGES = "path string, page int, width double, words array<struct<text:string,x0:double,top:double,bottom:double,size:double,fontname:string>>, error string"


def pdf_words(spark: SparkSession, path: str, parse: Callable[[bytes], list[tuple[float, list[tuple]]]]) -> DataFrame:
    """Pages of all PDFs under a folder. parse turns a file's bytes into (width, words) by page; what it raises becomes error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    names = ("text", "x0", "top", "bottom", "size", "fontname")
                    for n, (width, words) in enumerate(parse(content), 1):
                        rows.append((name, n, width, [dict(zip(names, w, strict=True)) for w in words], None))
                except Exception as e:  # a damaged file is a row with an error, not a failed job
                    rows.append((name, 0, None, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page", "width", "words", "error"])

    return binary_files(spark, path, "*.pdf").select("path", "content").mapInPandas(run, PAGES)


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of a workbook, read from its XML parts."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet"):
            target = targets[sheet.get(link)]
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for n, row in enumerate(root.iter(f"{main}row"), 1):
                cells: list[str | None] = []
                for c in row.iter(f"{main}c"):
                    letters = re.match("[A-Z]+", c.get("r", "A"))[0]
                    at = 0
                    for letter in letters:
                        at = at * 26 + ord(letter) - 64
                    cells += [None] * (at - 1 - len(cells))
                    v, inline = c.find(f"{main}v"), c.find(f"{main}is")
                    text = "".join(t.text or "" for t in inline.iter(f"{main}t")) if inline is not None else v.text if v is not None else None
                    cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
                yield sheet.get("name"), n, cells


def scores(spark: SparkSession, path: str) -> DataFrame:
    """Score sheets <case>_PC_<scenario> and <case>_O_<scenario> in long form: rows whose first cell ends in _score, an
    element for each further column by its header, what is no number as 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                kind, header, numbers = name.rsplit("/", 1)[-1].rsplit(".", 1)[0].rsplit("_", 1)[-1], {}, {}
                for sheet, n, cells in sheet_rows(content):
                    found = re.fullmatch(r"(.+?)_(PC|O)_(.+)", sheet)
                    if not found or not cells:
                        continue
                    if n == 1:
                        header[sheet] = cells
                    elif (cells[0] or "").endswith("_score"):
                        number = numbers[sheet] = numbers.get(sheet, 0) + 1
                        for column, cell in zip(header.get(sheet, [])[1:], cells[1:], strict=False):
                            try:
                                value = float(cell)
                            except (TypeError, ValueError):
                                value = 0.0
                            rows.append((found[1], kind, found[3], column, number, value))
            yield pd.DataFrame(rows, columns=["case", "file_kind", "scenario", "element", "item_no", "score"])

    return binary_files(spark, path, "*.xlsx").select("path", "content").mapInPandas(run, schemas.SCORES)


def latest_file(files: DataFrame) -> DataFrame:
    """The path with the greatest modification time, the greatest path of equal ones."""
    return files.agg(F.max(F.struct("modified", "path")).alias("f")).select("f.path", "f.modified")


def available_cases(rows: DataFrame) -> DataFrame:
    return rows.where("case is not null").select("case").distinct()
